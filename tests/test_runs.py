"""Token runs: the filter against brute force, and mentions without a shuffle of texts or runs."""

import random

import numpy as np
import pytest

from tierline.functions import runs
from tierline.operators import matching


def _texts(rng, n, words):
    return [" ".join(f"w{rng.randint(0, words)}" for _ in range(rng.randint(0, 40))) for _ in range(n)]


@pytest.mark.parametrize("enough", [None, 2])
def test_filter_gives_every_key_that_a_text_holds(monkeypatch, enough):
    monkeypatch.setattr(runs, "CHUNK", 200)
    rng = random.Random(3)
    texts = [*_texts(rng, 200, 12), None, "", "w1"]
    keys = sorted({" ".join(f"w{rng.randint(0, 12)}" for _ in range(rng.choice([2, 2, 3, 4, 5, 9]))) for _ in range(120)})
    bits = 1 << 18
    table = np.zeros(bits // 8, np.uint8)
    for b in runs.key_bits(keys, bits).tolist():
        table[b // 8] |= 1 << b % 8
    known = runs.RunFilter(table, sorted({k.count(" ") + 1 for k in keys}), [k.encode() for k in keys[:60]])
    found = list(known.named(texts, enough))
    assert len(found) == len(set(found))
    got = {(i, r.decode()) for i, r in found if r.decode() in keys}
    for i, t in enumerate(texts):
        held = [k for k in keys if f" {k} " in f" {t or ''} "]
        first = [k for k in held if k in keys[:60]]
        want = first[:enough] if enough and len(first) >= enough else held
        assert {r for j, r in got if j == i} == set(want)


def test_mentions_let_few_runs_of_texts_leave_their_task(spark, monkeypatch):
    monkeypatch.setattr(matching, "FIRST", 3)
    rng = random.Random(5)
    texts = [" ".join(f"word{rng.randint(0, 3000)}" for _ in range(400)) for _ in range(60)]
    words = [t.split() for t in texts]
    names = [f"{w[i]} {w[i + 1]}" for w in words for i in range(0, 20, 5)] + [f"{texts[0].split()[7]} absent{i}" for i in range(300)]
    names.append(" ".join(words[9][30:42]))
    d = spark.createDataFrame([(i, n, True) for i, n in enumerate(names)], "id int, name string, in_scope boolean")
    a = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "a int, t string")
    found = matching.match_mentions(a, d, "a", "t")
    got = {(r.a, r.institution_id) for r in found.collect()}
    assert got == {(i, j) for i, t in enumerate(texts) for j, n in enumerate(names) if f" {n} " in f" {t} "}
    # 24,000 tokens hold some 240 names; every run of up to eight tokens was dealt out by its first two before
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    keys = matching.lowest_ids(matching.mention_index(d), None)
    assert matching._named_runs(a, keys, None).count() < 2 * len(got)


def test_mentions_of_no_names_and_null_ids(spark):
    d = spark.createDataFrame([(None, "alpha skills", True), (2, "alpha skills", True), (1, "north skills", True)], "id int, name string, in_scope boolean")
    a = spark.createDataFrame([(None, "alpha skills"), (7, "the alpha skills of north skills"), (7, "alpha skills"), (8, None)], "a int, x string")
    key = lambda r: (r.a or 0, r.institution_id or 0)
    assert sorted(map(key, matching.match_mentions(a, d, "a", "x", 2).collect())) == [(0, 0), (0, 2), (7, 0), (7, 1)]
    assert matching.match_mentions(a, d.where("id > 9"), "a", "x", 2).count() == 0
