"""Connected components and first-come choice against plain loops."""

import random

import pytest

from tierline.operators import components as c


def loop(rows):
    """Row numbers that create, read in order."""
    seen, out = (set(), set()), set()
    for n, *keys in sorted(rows):
        own = [(s, k) for s, k in zip(seen, keys, strict=True) if k is not None]
        if own and not any(k in s for s, k in own):
            out.add(n)
            for s, k in own:
                s.add(k)
    return out


def chosen(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "row_no long, urn string, ukprn string, component string").repartition(3)
    return {r.row_no for r in c.first_come(df, ("urn", "ukprn"), "row_no").collect()}


def random_rows(seed, n, keys):
    rng = random.Random(seed)
    return [(i, rng.choice([None, *map(str, range(keys))]), rng.choice([None, *map(str, range(keys))])) for i in rng.sample(range(10 * n), n)]


@pytest.mark.parametrize("one_task", [100_000, 0])
@pytest.mark.parametrize("keys", [5, 40])
def test_first_come_equals_the_row_loop(spark, monkeypatch, one_task, keys):
    monkeypatch.setattr(c, "ONE_TASK", one_task)
    rows = random_rows(keys, 80, keys)
    assert chosen(spark, rows) == loop(rows)


def test_one_key_with_most_rows(spark):
    rows = [(i, "hot" if i % 3 else str(i), None if i % 2 else str(i % 7)) for i in range(300)]
    assert chosen(spark, rows) == loop(rows)


@pytest.mark.parametrize("one_task", [100_000, 0])
def test_a_chain_of_ten_thousand_rows_takes_few_rounds(spark, monkeypatch, one_task):
    """(A, X), (B, X), (B, Y), (C, Y), ...: every row depends on the one before."""
    stored = []
    store = c.cut_lineage
    monkeypatch.setattr(c, "cut_lineage", lambda df, label: stored.append(label) or store(df, label))
    monkeypatch.setattr(c, "ONE_TASK", one_task)
    rows = [(i, f"u{(i + 1) // 2}", f"k{i // 2}") for i in range(10_000)]
    assert chosen(spark, rows) == set(range(0, 10_000, 2)) == loop(rows)
    assert stored.count("components") <= 2 * 20
    assert stored.count("first-come-chains") <= 20 and stored.count("first-come-new") <= 1


def test_components_of_paths_stars_and_cycles(spark):
    rng = random.Random(1)
    ids = list(range(1000, 1600))
    rng.shuffle(ids)
    edges = list(zip(ids[:200], ids[1:200], strict=False)) + [(ids[200], i) for i in ids[201:400]]
    edges += [(a, b) for a, b in zip(ids[400:450], [*ids[401:450], ids[400]], strict=True)] + [(ids[450], ids[450]), (ids[451], ids[452])] * 2
    got = {r.id: r.component for r in c.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for group in (ids[:200], ids[200:400], ids[400:450], ids[451:453]):
        want |= dict.fromkeys(group, min(group))
    assert got == want
    assert c.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
