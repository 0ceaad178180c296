"""Connected components, and first-come choice among rows that share keys."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .joins import spread_null

#: Rows of a component up to which one task reads it in order.
ONE_TASK = 100_000


def connected_components(edges: DataFrame, label: str = "components") -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` (a, b) reaches.

    Large-star and small-star steps in turn (Kiveris et al., 2014): each node's
    larger neighbours, then its smaller ones, are linked to its smallest. Both
    are a minimum by node and a join, so a node with very many links is merged
    in the map tasks and split by AQE like any skewed key; the number of steps
    grows with the logarithm of the longest path. Edges are stored after each.
    """
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    down, before = cut_lineage(down, label), None
    while down.limit(1).count():
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut_lineage(larger.where("u != v").distinct(), label)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        smaller = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = cut_lineage(smaller.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), label)
        # the steps end when every node hangs on its component's smallest: nothing changes then
        now = down.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38, 0)")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    own = down.select(F.col("v").alias("id"), F.col("v").alias("component"))
    return down.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(own).distinct()


def first_come(rows: DataFrame, keys: tuple[str, str], order: str) -> DataFrame:
    """The ``order`` numbers of the rows that are taken when rows are read in order.

    A row is taken unless a row that was taken before it has one of its two
    keys; a null key is shared with nobody. ``order`` is unique and whole.

    Rows that share no key are taken at once. The others fall into components;
    those of up to ``ONE_TASK`` rows are each read in order in one task, larger
    ones are settled by :func:`_in_rounds`.
    """
    a, b = keys
    pairs = rows.groupBy(a, b).agg(F.min(order).alias("n")).where(F.col(a).isNotNull() | F.col(b).isNotNull())
    pairs = cut_lineage(pairs.select("n", F.col(a).alias("a"), F.col(b).alias("b")), "first-come")
    links = [
        _with_first(pairs, k).where(f"first_{k} < n").select(F.col("n").alias("a"), F.col(f"first_{k}").alias("b")) for k in ("a", "b")
    ]
    parts = cut_lineage(connected_components(links[0].unionByName(links[1])), "first-come")
    alone = pairs.join(parts, pairs["n"] == parts["id"], "left_anti").select("n")
    linked = pairs.join(parts, pairs["n"] == parts["id"]).select("n", "a", "b", "component")
    sizes = cut_lineage(parts.groupBy("component").agg(F.count("*").alias("size")), "first-come")
    small = linked.join(sizes.where(f"size <= {ONE_TASK}"), "component", "left_semi")

    def read(group: pd.DataFrame) -> pd.DataFrame:
        seen, taken = (set(), set()), []
        for row in group.sort_values("n")[["n", "a", "b"]].itertuples(index=False):
            own = [(s, k) for s, k in zip(seen, row[1:], strict=True) if k is not None]
            if not any(k in s for s, k in own):
                taken.append(row[0])
                for s, k in own:
                    s.add(k)
        return pd.DataFrame({"n": pd.Series(taken, dtype="int64")})

    out = alone.unionByName(small.groupBy("component").applyInPandas(read, "n long"))
    if sizes.where(f"size > {ONE_TASK}").limit(1).count():
        large = linked.join(sizes.where(f"size > {ONE_TASK}"), "component", "left_semi").select("n", "a", "b")
        out = out.unionByName(_in_rounds(large))
    return out.select(F.col("n").alias(order))


def _with_key(rows: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """``rows`` with the facts (one row for each ``__k``) of one of their keys; rows without the key are spread."""
    return rows.join(facts, spread_null(F.col(key), F.col("n")) == F.col("__k"), "left").drop("__k")


def _with_first(rows: DataFrame, key: str) -> DataFrame:
    facts = rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__k")).agg(F.min("n").alias(f"first_{key}"))
    return _with_key(rows, key, facts)


def _earlier(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with how many rows come before under ``key`` (0, 1 or 2 for more) and, if one does, which."""
    first = cut_lineage(_with_first(rows, key), "first-come")
    facts = first.where(f"n > first_{key}").groupBy(F.col(key).alias("__k")).agg(F.min("n").alias("second"))
    place = F.when(F.col(f"first_{key}").isNull() | (F.col("n") == F.col(f"first_{key}")), 0).when(F.col("n") == F.col("second"), 1).otherwise(2)
    return (
        _with_key(first, key, facts)
        .withColumn(f"before_{key}", place)
        .withColumn(f"only_{key}", F.when(F.col(f"before_{key}") == 1, F.col(f"first_{key}")))
        .drop("second", f"first_{key}")
    )


def _in_rounds(rows: DataFrame) -> DataFrame:
    """First-come choice over (n, a, b) without reading a component in one task.

    A row with no open row before it under either key is taken. A row with one
    such row is taken if that one is not: chains of these are halved by pointer
    jumping until each knows its chain's head and the number of steps to it.
    Rows with more wait for the next round, when what the taken rows decide is
    out of the way.
    """
    left, taken = cut_lineage(rows, "first-come-open"), []
    while left.limit(1).count():
        known = _earlier(_earlier(left, "a"), "b")
        count: Column = F.col("before_a") + F.col("before_b")
        chains = known.select(
            "n",
            F.when(count == 1, F.coalesce("only_a", "only_b")).otherwise(F.col("n")).alias("up"),
            F.when(count == 1, 1).otherwise(0).cast("long").alias("steps"),
            F.when(count == 0, True).when(count > 1, False).alias("free"),
        )
        chains = cut_lineage(chains, "first-come-chains")
        while chains.where("free IS NULL").limit(1).count():
            heads = chains.select(F.col("n").alias("up"), F.col("up").alias("top"), F.col("steps").alias("more"), F.col("free").alias("head_free"))
            open_ = chains.where("free IS NULL").drop("free").join(heads, "up")
            moved = open_.select("n", F.col("top").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), F.col("head_free").alias("free"))
            chains = cut_lineage(chains.where("free IS NOT NULL").unionByName(moved), "first-come-chains")
        new = cut_lineage(left.join(chains.where("free AND steps % 2 = 0").select("n"), "n", "left_semi"), "first-come-new")
        taken.append(new.select("n"))
        for key in ("a", "b"):
            used = new.where(F.col(key).isNotNull()).select(F.col(key).alias("__k"))
            left = left.join(used, spread_null(F.col(key), F.col("n")) == F.col("__k"), "left_anti")
        left = cut_lineage(left.join(new.select("n"), "n", "left_anti"), "first-come-open")
    return reduce(DataFrame.unionByName, taken)
