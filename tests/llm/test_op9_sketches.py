"""Sketches: no link is ruled out, and pairs that meet by chance need no texts."""

import random

import numpy as np
import pytest

from tierline.llm import hamming_join as h


def _sets(rng, sizes, shared):
    common = rng.integers(0, 1 << 63, max(sizes)).astype(np.uint64)
    return [np.unique(np.concatenate((common[: int(n * shared)], rng.integers(0, 1 << 63, n - int(n * shared)).astype(np.uint64)))) for n in sizes]


@pytest.mark.parametrize("percent", [30, 80])
def test_a_sketch_rules_out_no_link_and_most_others(spark, percent):
    rng = np.random.default_rng(8)
    sets = [s for n in (1, 5, 63, 70, 400, 520) for share in (0, 0.4, 0.86, 0.95, 1) for s in _sets(rng, [n, n, n + n // 9], share)]
    sets.append((np.arange(40) * 64).astype(np.uint64))  # all on one place: no sketch
    sketches = [h.sketch(s) for s in sets]
    assert sketches[-1] is None and None not in sketches[:-1]
    link = lambda a, b: 100 * len(set(a.tolist()) & set(b.tolist())) >= percent * len(set(a.tolist()) | set(b.tolist()))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    links = {(i, j) for i, j in pairs if link(sets[i], sets[j])}
    rows = [(i, j, len(sets[i]), len(sets[j]), sketches[i], sketches[j]) for i, j in pairs]
    left = {(r.a, r.b) for r in h.possible(spark.createDataFrame(rows, "a long, b long, n long, m long, x binary, y binary"), percent).collect()}
    size = np.array([len(s) for s in sets])
    between = {(j, i) for i, j in h.possible_between(size, sketches, np.arange(len(sets)), None, percent)}
    assert links and links <= left and links <= between <= left
    cut = 20
    halves = {(j, i) for i, j in h.possible_between(size, sketches, np.arange(len(sets)), cut, percent)}
    assert halves == {(i, j) for i, j in between if j < cut <= i}
    if percent == 80:
        assert len({x for x in left if x[0] < len(sets) - 1} - links) < len(pairs) / 10


@pytest.mark.parametrize("small", [64, 1])
def test_texts_that_meet_by_chance_are_not_read(spark, documents, monkeypatch, small):
    monkeypatch.setattr(h, "SMALL", small)
    rng = random.Random(4)
    head = " ".join(f"h{i}" for i in range(120))
    # a third of the shingles of any two is common: most of them share a bucket, none is linked
    texts = [head + " " + " ".join(f"o{i}x{rng.randint(0, 10**6)}" for _ in range(120)) for i in range(80)]
    read = []
    real = h.confirm
    monkeypatch.setattr(h, "confirm", lambda p, t, k: (read.append((p.count(), t.count())), real(p, t, k))[1])
    got = h.classify(documents([(i, t, "en") for i, t in enumerate(texts)]), k=2).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(i, i) for i in range(80)]
    assert sum(p for p, _ in read) < 8 and sum(t for _, t in read) < 16
