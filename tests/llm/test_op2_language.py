import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tierline.llm import ppm

SYLLABLES = {"aa": ["the", "and", "of", "ing", "tion", "er"], "bb": ["der", "und", "ein", "sch", "ung", "ß"], "cc": ["le", "é", "eau", "que", "ment", "oi"]}


def text(rng, lang, n=60):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(n))


def table(rng, n=40):
    return [(i, text(rng, lang := rng.choice(list(SYLLABLES))), lang) for i in range(n)]


def plain_bits(train: dict[str, list[bytes]], lang: str, data: bytes, least: int) -> float:
    """PPM without tables: counts of every context, escapes spelled out."""
    grams: dict[tuple, int] = {}
    everywhere: dict[str, dict[tuple, int]] = {}
    for name, texts in train.items():
        own = everywhere.setdefault(name, {})
        for t in texts:
            b = [256] * 3 + list(t)
            for i in range(3, len(b)):
                own[tuple(b[i - 3 : i + 1])] = own.get(tuple(b[i - 3 : i + 1]), 0) + 1
    grams = {g: n for g, n in everywhere[lang].items() if n >= least}
    seen = {g[-1] for own in everywhere.values() for g, n in own.items() if n >= least}

    def code(x, pad_ok=True):
        return x if x in seen or (x == 256 and pad_ok) else "other"

    def bits(context, byte):
        for order in range(3, -1, -1):
            want = [code(x) for x in context[3 - order :]]
            counts: dict = {}
            for g, n in grams.items():
                if [code(x) for x in g[3 - order : 3]] == want:
                    counts[g[-1]] = counts.get(g[-1], 0) + n
            total, kinds = sum(counts.values()), len(counts)
            if not total:
                continue
            if byte in counts:
                return spent[0] - math.log2(counts[byte] / (total + kinds))
            spent[0] -= math.log2(kinds / (total + kinds))
        return spent[0] + 8

    out, b = 0.0, [256] * 3 + list(data)
    for i in range(3, len(b)):
        spent = [0.0]
        out += bits(b[i - 3 : i], b[i])
    return out


def test_code_lengths_are_exact(spark):
    rng = random.Random(2)
    rows = [(text(rng, lang, 12), lang) for lang in SYLLABLES for _ in range(3)]
    counts = ppm.count_grams(spark.createDataFrame(rows, "text string, lang string")).where("n >= 2").toPandas()
    trees = ppm.ContextTrees(counts)
    train = {lang: [t.encode() for t, x in rows if x == lang] for lang in SYLLABLES}
    for data in (b"t", b"", "the und éau ÿz".encode(), text(rng, "bb", 4).encode()):
        want = [plain_bits(train, lang, data, 2) for lang in trees.langs]
        assert np.allclose(trees.code_lengths(data), want, atol=1e-3), data


def test_pieces_do_not_change_the_length(monkeypatch):
    rng = random.Random(3)
    data = text(rng, "aa", 300).encode()
    gram, n = np.unique(ppm._grams(data), return_counts=True)
    trees = ppm.ContextTrees(pd.DataFrame({"lang": "aa", "gram": gram, "n": n}))
    whole = trees.code_lengths(data)
    monkeypatch.setattr(ppm, "PIECE", 17)
    assert np.allclose(trees.code_lengths(data), whole)


def test_pruned_contexts_end_one_order_lower():
    rng = random.Random(3)
    gram, n = np.unique(ppm._grams(text(rng, "aa", 300).encode()), return_counts=True)
    trees = ppm.ContextTrees(pd.DataFrame({"lang": "aa", "gram": gram, "n": n}), max_contexts=5)
    assert np.isfinite(trees.bits).all() and len(trees.bits) < trees.m * len(gram)


def test_rare_language_keeps_its_contexts_among_many():
    rng = random.Random(7)
    frames = []
    for k in range(40):
        alphabet = [chr(0x100 + 40 * k + j) for j in range(24)]
        spoken = "".join(rng.choices(alphabet, k=4000 if k else 60))
        gram, n = np.unique(ppm._grams(spoken.encode()), return_counts=True)
        frames.append(pd.DataFrame({"lang": f"l{k:02}", "gram": gram, "n": n}))
        if not k:
            rare = spoken.encode()
    every = pd.concat(frames, ignore_index=True)
    assert every["gram"].floordiv(ppm.BASE).nunique() > 16384
    own = ppm.ContextTrees(frames[0]).code_lengths(rare)[0]
    got = ppm.ContextTrees(every).code_lengths(rare)
    assert np.isclose(got[0], own, rtol=1e-5) and got.argmin() == 0
    # all grams of a text are learned, so it needs far less than 8 bits a byte
    assert own < 3 * len(rare)


def test_language_without_a_repeated_gram_is_learned(spark):
    rng = random.Random(8)
    rows = [(i, text(rng, "aa"), "aa") for i in range(20)] + [(50, "żółw pchnąć", "rare")]
    trees = ppm.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert trees.langs == ["aa", "rare"] and trees.code_lengths("pchnąć żółw".encode()).argmin() == 1


def test_held_out_accuracy_and_edges(spark, documents):
    rows = table(random.Random(4), 120)
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 34 !?", None), (903, text(random.Random(1), "bb", 30_000), None), (None, "the and of", None)]
    docs = documents([*rows, *odd, rows[0], rows[0]])
    got = ppm.identify(docs).collect()
    assert len(got) == len(rows) + len(odd) + 2
    lang = {i: x for i, _, x in rows}
    held = [r for r in got if r.held_out and r.doc_id in lang]
    assert len(held) > 10 and all(r.lang_pred == lang[r.doc_id] for r in held)
    by = {r.doc_id: r for r in got}
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "bb"]
    assert all(0 <= r.score <= 1 for r in got) and by[900].score == 0
    import zlib

    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_labels_of_held_out_rows_are_not_used(spark, documents):
    rows = table(random.Random(5), 60)
    docs = documents(rows)
    wrong = docs.withColumn("lang", F.when(ppm.held_out(F.col("doc_id")), "zz").otherwise(F.col("lang")))
    assert sorted(ppm.identify(docs).collect()) == sorted(ppm.identify(wrong).collect())


def test_nothing_learned_and_empty(spark, documents):
    assert ppm.identify(documents([(1, "the", None)])).first().lang_pred == "und"
    assert ppm.identify(documents([])).count() == 0


def test_rejects_only_texts_in_no_language(spark, documents):
    rows = table(random.Random(6), 80)
    docs = documents([*rows, (500, "漢字" * 40, None), (501, None, None), (502, "123", None)])
    kept = ppm.keep_known(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [i for i, *_ in rows]
