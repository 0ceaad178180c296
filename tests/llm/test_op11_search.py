import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from tierline.llm import posting_rmq as p

DOCS = "doc_id long, text string, rank int, item string, n string, part int"
ITEMS = "item_id long, text string, score double, terms string"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return WORD.findall(low)


def plain(docs, items, k):
    """Every document scored for every item."""
    counted = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    df = Counter(w for _, c in counted for w in c)
    n_docs, words = len(counted), sum(sum(c.values()) for _, c in counted)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scored = []
        for doc, c in counted:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 20 * m)) for w in own if w in c)
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored, key=lambda s: s[:3])[:k], 1)]
    return sorted(out, key=str)


def run(spark, docs, items, **options):
    d = spark.createDataFrame([(i, t, 1, "x", "y", 3) for i, t in docs], DOCS).repartition(3)
    b = spark.createDataFrame([(i, t, 0.5, "z") for i, t in items], ITEMS)
    return sorted([tuple(r) for r in p.top_documents(d, b, **options).collect()], key=str)


@pytest.mark.parametrize("postings", [40, 1 << 20])
def test_against_all_scores(spark, postings):
    """Frequent and rare words, copies of many sizes, several shards in a task."""
    rng = random.Random(postings)
    words = [f"W{i}" for i in range(60)] + ["é", "日本", "a-b", "x.y"]
    some = lambda n: " ".join(rng.choices(words, [1 / (j + 1) for j in range(len(words))], k=n))
    texts = [some(rng.randint(1, 60)) for _ in range(150)]
    docs = list(enumerate(texts + [texts[0]] * 40 + [texts[1]] * 3))
    rng.shuffle(docs)
    items = [(i, some(rng.randint(1, 20))) for i in range(12)]
    assert run(spark, docs, items, k=7, postings=postings) == plain(docs, items, 7)


def test_nulls_ties_repeats_and_blocks_of_items(spark):
    docs = [(None, "b c"), (None, None), (1, ""), (2, "... \n"), (3, "A b"), (3, "A b"), (2**60, "a b"), (-5, "a B"), (7, "B " * 50_000 + "c")]
    items = [(None, "b"), (1, "a"), (1, "c"), (1, "a"), (2, None), (3, ""), (4, "zzz"), (5, "a A b")]
    assert run(spark, docs, items, k=4, block_bytes=1) == plain(docs, items, 4)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, None)], [(1, "a")]) == []


def test_range_maxima():
    rng = np.random.default_rng(3)
    values = rng.integers(0, 9, 100)
    table = p._Range(values, 100)
    first = rng.integers(0, 100, 500)
    end = first + 1 + rng.integers(0, 100 - first)
    best = table.best(first, end)
    assert all(a <= at < b and values[at] == values[a:b].max() for a, b, at in zip(first, end, best, strict=True))


def test_search_leaves_most_documents_unscored():
    """A rare word in few documents: the bounds close the rest without a look."""
    n = 5000
    sizes = np.array([2 if i % 500 == 0 else 1 for i in range(n)])
    terms_ = np.array([t for s in sizes for t in ([0, 1] if s == 2 else [0])])
    known = p.Corpus(n, 10 * n, np.array([n // 2, 10]))
    shard = p.Shard(known, np.arange(n), np.full(n, 10), sizes, terms_, np.ones(len(terms_), np.int64))
    items = p.Items(["x"], [["common rare"]])
    seen = []
    take = p._Pool.take
    p._Pool.take = lambda self, start, size: seen.append(len(start)) or take(self, start, size)
    try:
        _, _, docs = shard.search(items, np.ones(1, np.int64), (np.zeros(0, np.int64),) * 3, 5)
    finally:
        p._Pool.take = take
    assert docs.tolist() == [0, 500, 1000, 1500, 2000]
    assert sum(seen) < 100
