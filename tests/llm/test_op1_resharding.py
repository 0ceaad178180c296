import itertools
import random

import pytest
from pyspark.sql import functions as F

from tierline.llm import resharding as r
from tierline.llm.common import scratch_dir


def brute_least_bytes(old: list[list[int]], capacities) -> int:
    """The fewest bytes moved over all numbers of rows that each old shard may keep; it moves its smallest rows."""
    rows, best = sum(map(len, old)), None
    m = len(capacities)
    options = [range(min(len(s), capacities[i][1] if i < m else 0) + 1) for i, s in enumerate(old)]
    for keep in itertools.product(*options):
        free = rows - sum(keep)
        least = sum(max(0, lo - (keep[j] if j < len(keep) else 0)) for j, (lo, _) in enumerate(capacities))
        most = sum(hi - (keep[j] if j < len(keep) else 0) for j, (_, hi) in enumerate(capacities))
        if least <= free <= most:
            moved = sum(sum(sorted(s)[: len(s) - k]) for s, k in zip(old, keep, strict=True))
            best = moved if best is None else min(best, moved)
    return best


def blocks_of(old, capacities):
    out = []
    for i, s in enumerate(map(sorted, old)):
        least, most = capacities[i] if i < len(capacities) else (0, 0)
        cut = sorted({0, max(0, len(s) - most), max(0, len(s) - least), len(s)})
        out += [r.Block(i, b - a, sum(s[a:b])) for a, b in zip(cut, cut[1:], strict=False)]
    return out


def test_solve_moves_the_fewest_bytes():
    rng = random.Random(3)
    for _ in range(150):
        old = [[rng.randint(1, 50) for _ in range(rng.choice([0, 1, 3, 7]))] for _ in range(rng.randint(1, 4))]
        capacities = r.even_rows(sum(map(len, old)), rng.randint(1, 5))
        blocks = blocks_of(old, capacities)
        transfers = r.solve(blocks, capacities)
        into = [0] * len(capacities)
        for _, j, f in transfers:
            into[j] += f
        assert all(lo <= x <= hi for x, (lo, hi) in zip(into, capacities, strict=True))
        moved = sum(blocks[i].bytes * f / blocks[i].rows for i, j, f in transfers if j != blocks[i].shard)
        assert round(moved) == brute_least_bytes(old, capacities)


def test_capacities_that_cannot_hold_all():
    with pytest.raises(ValueError):
        r.solve([r.Block(0, 5, 10)], [(0, 2), (0, 2)])


def rows_of(documents, n=90):
    rng = random.Random(1)
    rows = [(i, "x" * rng.choice([0, 3, 3, 50]), "en") for i in range(n)]
    return documents([*rows, *rows[:6], (None, None, None), (None, "é", None), (500, "y" * 200_000, "en")])


@pytest.mark.parametrize("shards", [3, 7, 40])
def test_rewrite_keeps_every_row(spark, documents, shards):
    docs = rows_of(documents)
    path = scratch_dir(spark, "t")
    hot = F.when(F.coalesce(F.col("doc_id"), F.lit(0)) % 3 == 0, 0).otherwise(F.coalesce(F.col("doc_id") % 6, F.lit(5)))
    r.write_layout(docs, hot, path)
    layout = r.reshard(spark, path, docs.schema, shards)
    stored = layout.read(spark)
    assert sorted(map(repr, stored.drop(r.OLD).collect())) == sorted(map(repr, docs.collect()))
    got = r.manifest(spark, layout).collect()
    counts = [sum(x.shard == i for x in got) for i in range(shards)]
    assert max(counts) - min(counts) <= 1 and sum(counts) == docs.count()
    for i in range(shards):
        assert sorted(x.slot for x in got if x.shard == i) == list(range(counts[i]))
    assert {x.size for x in got if x.doc_id == 500} == {200_016} and min(x.size for x in got) == 16
    before = spark.read.schema(stored.schema).parquet(path)
    moved = before.exceptAll(stored)
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 16)
    assert (moved.agg(size).first()[0] or 0) <= layout.moved_bytes


def test_shards_that_lose_nothing_keep_their_files(spark, documents):
    docs = documents([(i, "abc", "en") for i in range(40)])
    path = scratch_dir(spark, "t")
    r.write_layout(docs, F.when(F.col("doc_id") < 30, 0).otherwise(1), path)
    layout = r.reshard(spark, path, docs.schema, 2)
    assert layout.kept == [1] and layout.moved_rows == 10
    assert r.reshard(spark, path, docs.schema, [(30, 30), (10, 10)]).moved_rows == 0


def test_empty_table(spark, documents):
    path = scratch_dir(spark, "t")
    r.write_layout(documents([]), F.lit(0), path)
    assert r.manifest(spark, r.reshard(spark, path, documents([]).schema, 4)).count() == 0
