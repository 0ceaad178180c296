import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierline.llm import suffix_match as s


def brute(docs, items, window=10):
    out = []
    for _, text, _ in docs:
        w = s.split_words(text)
        hit, ids = set(), set()
        for item, t in items:
            x = s.split_words(t)
            n = min(window, len(x))
            for o in range(len(x) - n + 1) if n else ():
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == x[o : o + n]:
                        hit |= set(range(p, p + n))
                        ids.add(item)
        ids = {str(i) for i in ids if i is not None}
        out.append((len(w), len(hit), len(ids), s.items_digest(ids), bool(hit)))
    return out


def cases():
    rng = random.Random(5)
    words = [rng.choice("abcd") * rng.randint(1, 2) for _ in range(400)]
    items = [(i, " ".join(words[20 * i : 20 * i + rng.choice([3, 10, 14, 25])])) for i in range(8)]
    items += [(90, None), (91, ""), (92, "..."), (None, "Null Id here"), (3, items[3][1]), (93, "Émile ÉCOLE 7"), (94, "zz " * 12)]
    docs = [(0, None, "en"), (1, "", "en"), (2, "...", "en"), (3, items[2][1].upper() + "!", "en"), (3, "null id HERE", None)]
    docs += [(i, " ".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(60)) + " " + rng.choice(items)[1].__str__(), "en") for i in range(4, 30)]
    docs += [(40, "zz, " * 3000 + items[1][1], "en"), (41, "émile École 7", "de"), (41, "émile École 7", "de"), (42, "Émile École 7x", "de"), (None, items[0][1], "en")]
    return docs, items


@pytest.mark.parametrize("options", [{}, {"shard_words": 50}, {"block_bytes": 60}])
def test_against_brute_force(spark, documents, options):
    docs, items = cases()
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = s.score(documents(docs), bench, **options).drop("longest", "longest_at")
    want = [(d[0], *b) for d, b in zip(docs, brute(docs, items), strict=True)]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, want))
    clean = s.remove(documents(docs), bench, **options)
    assert clean.columns == documents([]).columns
    assert clean.count() == sum(not w[-1] for w in want)


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert s.score(documents([(1, "a b", "en")]), bench).where("contaminated").count() == 0
    assert s.score(documents([]), bench).count() == 0


def test_longest_match_and_its_place(spark, documents):
    item = " ".join(f"w{i}" for i in range(40))
    text = "x y " + " ".join(f"w{i}" for i in range(5, 30)) + " z " + " ".join(f"w{i}" for i in range(12))
    row = s.score(documents([(1, text, "en")]), spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (row.longest, row.longest_at, row.n_hit) == (25, 2, 37)


def test_suffix_array_sorts_suffixes():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 3, 300)
    codes[100:160] = 1
    key = lambda p: tuple(codes[p : p + 64].tolist() + [0])
    cut = lambda k: k[: k.index(0) + 1]
    places = [cut(key(p)) for p in s.suffix_array(codes, 64)]
    assert places == sorted(places) and len(places) == np.count_nonzero(codes)


def test_nothing_is_shuffled(spark, documents):
    docs, items = cases()
    found = s.score(documents(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert "Exchange" not in found.select(F.hash("*"))._jdf.queryExecution().executedPlan().toString()


def test_longest_matches_against_all_pairs():
    rng = random.Random(9)
    for k in range(60):
        words = "abc"[: 1 + k % 3]
        items = [(str(i), " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(4)]
        texts = [" ".join(rng.choices(words + "z", k=rng.randint(0, 50))) for _ in range(5)]
        tests = s.TestItems(items, 4)
        for text, own in zip(texts, zip(*s.match_shard(texts, tests), strict=True), strict=True):
            w, best = text.split(), (0, 1)
            for _, item in items:
                x = item.split()
                for p in range(len(w)):
                    for o in range(len(x)):
                        n = 0
                        while p + n < len(w) and o + n < len(x) and w[p + n] == x[o + n]:
                            n += 1
                        if n >= min(4, len(x)) and (n >= 4 or o == 0 and n == len(x)):
                            best = max(best, (n, -p))
            assert own[3] == ((best[0], -best[1]) if best[0] else (0, -1))


def test_one_word_repeated_costs_no_more_than_other_text():
    tests = s.TestItems([("i", "ha " * 1600)])
    codes = np.full(16_000, tests.vocabulary[b"ha"], np.int64)
    found = s.Search(codes, s.suffix_array(codes, 1600), tests)
    assert found.asked <= 1600 and len(found.windows) == 1
    counts, spans, items, longest = s.match_shard(["ha " * 16_000, "ha " * 9], tests)
    assert spans == [[(0, 16_000)], []] and items == [{"i"}, set()] and longest == [(1600, 0), (0, -1)]
