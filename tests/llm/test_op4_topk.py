import math
import random

import numpy as np
import pytest

from tierline.llm import topk as t

SCHEMA = "vec_id long, embedding array<float>, score long"


def brute(rows, every, k=5):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.setdefault(i, []).append([math.floor(256 * float(np.float32(x))) for x in v])
    out = []
    for q, vs in good.items():
        if q % every == 0:
            for v in {tuple(v) for v in vs}:
                scores = [(sum(a * b for a, b in zip(v, u, strict=True)), i) for i, us in good.items() for u in us if i != q and len(u) == len(v)]
                out += [(q, n + 1, i, s) for n, (s, i) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:k])]
    return sorted(out)


def vectors(n, dim=12, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) * rng.choice([0.05, 0.1, 1]) for _ in range(dim)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(60)]  # one very common vector
    rows += [(n + 100, None), (n + 101, [None] * dim), (n + 102, [float("nan")] * dim), (n + 103, [float("inf")] * dim), (None, rows[1][1]), (n + 104, [0.0] * dim)]
    rows += [(n + 105, [1.0, 2.0]), (n + 106, [3.0, -1.0]), (0, [5.0, 5.0]), (n + 107, [1e30] * dim)]
    return rows


def run(spark, rows, every, **options):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)
    return sorted(map(tuple, t.top_k(df, df.where(f"vec_id % {every} = 0"), **options).collect()))


@pytest.mark.parametrize("options", [{}, {"block_vectors": 16, "block_queries": 5}])
def test_against_brute_force(spark, options):
    rows = vectors(300)
    assert run(spark, rows, 7, **options) == brute([r for r in rows if r[1] is None or max(map(abs, filter(None, r[1])), default=0) < 1e20 or not math.isfinite(r[1][0])], 7)


def test_empty_and_alone(spark):
    assert run(spark, [], 1) == []
    assert run(spark, [(0, [1.0])], 1) == []
    assert run(spark, [(0, [1.0]), (1, [-1.0]), (1, [-1.0])], 1) == [(0, 1, 1, -65536), (0, 2, 1, -65536), (1, 1, 0, -65536)]


def test_pruning_is_exact_and_prunes(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(t, "LOCAL_BUCKET", 32)
    base = rng.normal(size=(6, 16))
    for spread, must in ((0.1, "coordinate"), (2.0, None)):
        v = np.floor(64 * (base[rng.integers(0, 6, 800)] + spread * rng.normal(size=(800, 16)))).astype(np.int64)
        v[::3] *= rng.integers(1, 9, (len(v[::3]), 1))
        ids, seen = np.arange(800), {}
        q = v[:60]
        got = t.search_block(ids[:60], q, np.full(60, -np.inf), ids, v, 5, seen)
        for i in range(60):
            scores = v @ q[i]
            others = ids[ids != i]
            best = others[np.lexsort((others, -scores[others]))[:5]]
            assert sorted((a, b) for j, a, b in got if j == i) == sorted((int(x), int(scores[x])) for x in best)
        assert must is None or seen.get(must, 0) > 0
        assert seen.get("skipped", 0) > 0


def test_large_integers_stay_exact():
    a = np.array([[2**40, 3]], np.int64)
    assert t.products(a, np.array([[2**20, 1]], np.int64))[0][0] == 2**60 + 3


def test_scores_beyond_a_long_are_cut_and_tie(spark):
    big, most = 2.0**26, 2**63 - 1
    rows = [(0, [big, big]), (1, [big, 2.0**20]), (2, [big, big]), (3, [-big, -big]), (4, [1.0, 1.0]), (5, [2.0**32, 0.0]), (6, [-(2.0**32), 1.0])]
    want = [(q, r, i, min(max(x, -most), most)) for q, r, i, x in brute(rows, 2, k=7)]
    cut = sorted({(q, i): x for q, _, i, x in want}.items())
    ranked = [(q, sorted(((-x, i) for (p, i), x in cut if p == q))) for q in (0, 2, 4, 6)]
    want = [(q, n + 1, i, -x) for q, own in ranked for n, (x, i) in enumerate(own[:5])]
    assert run(spark, rows, 2) == want
