import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierline.llm import hamming_join as h


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return {tuple(w[i : i + min(k, len(w))]) for i in range(len(w) - min(k, len(w)) + 1)} if w else set()


def brute(rows, k):
    sets = [shingles(t, k) for _, t, _ in rows]
    head = list(range(len(rows)))

    def find(i):
        while head[i] != i:
            i = head[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                head[find(i)] = find(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = []
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            first = min(ids, default=None)
            out.append((rows[i][0], len(sets[i]), first, first is not None and rows[i][0] == first))
    return sorted(out, key=repr)


def corpus(seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    fresh = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    texts = [fresh(rng.randint(1, 120)) for _ in range(40)]
    for base in texts[:12]:
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 12))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(copy)
    chain = fresh(80)
    for i in range(0, 60, 3):  # each near the one before, far from the first
        chain = [*chain[:i], *fresh(3), *chain[i + 3 :]]
        texts.append(chain)
    crowd = fresh(100)
    for _ in range(60):  # one large group of near copies, and a second group that shares much with it
        texts.append([*crowd[: (i := rng.randrange(100))], "new", *crowd[i + 1 :]])
        texts.append([*crowd[:70], *["z" + w for w in crowd[70:-1]], str(rng.randrange(9))])
    rows = [(i, " ".join(t), "en") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    rows += [(900, None, None), (901, "", None), (902, " \n", None), (903, "one", None), (904, "ONE", None), (905, "one two", None), (906, "Ünï two", None), (907, "ünï two", None)]
    rows += [rows[0], rows[0], (None, rows[1][1], None), (None, "only null ids here", None), (None, "only null ids here", None), (908, "w " * 50_000, None), (909, "a b c", None)]
    return rows


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(spark, documents, k):
    rows = corpus(k)
    got = h.classify(documents(rows), k=k).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, k)


def test_keep_one(spark, documents):
    rows = corpus(3)
    path_docs = documents(rows)
    kept = h.keep_one(path_docs)
    assert kept.columns == path_docs.columns
    want = brute(rows, 5)
    ids = sorted(str(r.doc_id) for r in kept.collect())
    empty = [str(i) for i, n, *_ in want if n == 0]
    heads = {str(first) for _, n, first, _ in want if n and first is not None}
    assert ids == sorted([*empty, *heads, "None"])  # the group of null ids keeps one row


def test_keep_one_leaves_columns_of_any_name_alone(spark, documents):
    docs = documents([(1, "a b c d e f", "en"), (1, "a b c d e f", "en"), (2, "a b c d e f", "en")])
    docs = docs.withColumn("row", F.lit("own")).withColumn("row_", F.lit(7)).withColumn("tkey", F.lit("k"))
    assert [tuple(r) for r in h.keep_one(docs).collect()] == [(1, "a b c d e f", "en", "s", 11, "x", "own", 7, "k")]


def test_empty_table(spark, documents):
    assert h.classify(documents([])).count() == 0
    assert h.keep_one(documents([])).count() == 0


def test_pairs_under_the_distance_always_share_a_key():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a = rng.integers(0, 1 << 16, h.CHUNKS * h.SLOTS)
        b = a.copy()
        wrong = rng.choice(len(a), h.CHUNKS * (h.ERRORS + 1) - 1, replace=False)
        b[wrong] = rng.integers(0, 1 << 16, len(wrong))
        assert set(h.bucket_keys(a)) & set(h.bucket_keys(b))
    assert len(set(h.bucket_keys(a))) == h.CHUNKS * h.SLOTS


def test_signature_estimates_similarity():
    rng = np.random.default_rng(2)
    seeds = h._seeds(h.CHUNKS * h.SLOTS)
    agree = []
    for _ in range(200):
        x = rng.integers(0, 1 << 63, 180).astype(np.uint64)
        a, b = np.unique(x[:150]), np.unique(x[30:])  # similarity 120 / 180
        agree.append((h.signature(a, seeds) == h.signature(b, seeds)).mean())
    assert abs(np.mean(agree) - 2 / 3) < 0.02


@pytest.mark.parametrize("small,block", [(2, 8), (1, 3), (10**9, 8)])
def test_families_and_pairs_agree_with_brute_force(spark, documents, monkeypatch, small, block):
    monkeypatch.setattr(h, "SMALL", small)
    monkeypatch.setattr(h.family_links, "__defaults__", (block,))
    rows = corpus(11)
    got = h.classify(documents(rows), k=2).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2)


def test_links_between_sets():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50))).astype(np.uint64) for _ in range(40)]
    own = np.arange(40)
    for left in (None, 15):
        pairs = [(i, j) for i in range(40) for j in range(40) if i < j and (left is None or i < left <= j)]
        true = {(i, j) for i, j in pairs if 100 * len(set(sets[i]) & set(sets[j])) >= 40 * len(set(sets[i]) | set(sets[j]))}
        found = {tuple(sorted(x)) for x in h.links_between(sets, own, left, 40)}
        assert found <= true

        def groups(links):
            head = list(range(40))
            for _ in range(40):
                for i, j in links:
                    head[i] = head[j] = min(head[i], head[j])
            return head

        assert groups(found) == groups(true)
    assert h.links_between(sets, np.zeros(40, np.int64), None, 40) == []


def test_slots_apart(spark):
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(50):
        a = rng.integers(0, 1 << 16, 40)
        b = np.where(rng.random(40) < 0.4, rng.integers(0, 1 << 16, 40), a)
        rows.append((h.packed(a).tolist(), h.packed(b).tolist(), int((a != b).sum())))
    df = spark.createDataFrame(rows, "a array<long>, b array<long>, n int")
    assert df.where(h.slots_apart("a", "b") != df["n"]).count() == 0


def test_a_crowd_makes_no_quadratic_pairs(spark, documents, monkeypatch):
    rng = random.Random(7)
    crowd = [f"w{i}" for i in range(200)]
    # half the crowd hangs together; the other half is near it, but linked with nothing
    change = lambda n, i: [f"n{i}x{p}" if p in at else w for at in [set(rng.sample(range(200), n))] for p, w in enumerate(crowd)]
    rows = [(i, " ".join(change(1 if i % 2 else 30, i)), "en") for i in range(400)]
    docs = documents(rows)
    pairs = []
    real = h.confirm
    monkeypatch.setattr(h, "confirm", lambda p, t, k: (pairs.append(p.count()), real(p, t, k))[1])
    got = h.classify(docs, k=2).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows, 2)
    assert sum(pairs) < 400 * h.CHUNKS * h.SLOTS


def test_pairs_of_a_small_bucket_are_confirmed_whatever_their_signatures(spark):
    """Links at similarity 0.3: such pairs differ in far more slots than pairs at 0.8."""
    shared = [f"s{i}" for i in range(30)]
    own = lambda i: shared + [f"t{i}x{j}" for j in range(30)]
    texts = {i: " ".join(own(i)) for i in (1, 2)} | {0: "another text altogether"}
    sets = {i: h.shingle_set(t, 1, h.WordHashes()) for i, t in texts.items()}
    seeds = h._seeds(h.CHUNKS * h.SLOTS)
    apart = sum((h.signature(sets[1], seeds) != h.signature(sets[2], seeds)).tolist())
    assert apart > 24
    rest = spark.createDataFrame([(7, i, len(sets[i]), 0, 3, i) for i in (1, 2)], "key long, id long, n long, centre long, members long, component long")
    confirmed = spark.createDataFrame([(i, 0, 0, 63) for i in (1, 2)], "a long, b long, common long, together long")
    found = h.small_links(rest, confirmed, spark.createDataFrame(list(texts.items()), "id long, text string"), 1, 30)
    assert [tuple(r) for r in found.collect()] == [(2, 1)]
