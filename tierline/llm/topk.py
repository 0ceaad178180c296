"""Exact top-k inner products over norm-bucketed vectors.

Vectors are grouped by length into buckets (each ``STEP`` times the next) and dealt into blocks of about
``BLOCK_VECTORS``. A block is sorted by falling length and cut into local buckets. For a query q whose k-th best score
so far is s, a bucket with greatest length l can only help where the cosine is at least t = s / (|q| l): if t > 1 the
bucket and all after it are left out; if t is small, only vectors long enough are verified (length pruning); if t is
large, a vector must also lie in the range that t allows for q's largest coordinates (coordinate pruning). What
remains is verified with exact integer products.

Before that every query is held against one block of the longest vectors, so a whole block that cannot reach a
query's threshold is never paired with it. Queries and vectors meet in (query block, vector block) pairs of bounded
size, and only each pair's k best rows per query move on.

Defined results: vectors that are null, hold null or non-finite components, or whose scaled components leave the 52-bit range
take no part; a score that a long cannot hold is given as 2**63 - 1 or its negative, and such scores tie; empty vectors score 0; only vectors of equal dimension meet. Rows with the query's own id are never its
candidates; equal query rows are asked once, and of different vectors with one id each is a query of its own. Ties go
to the smaller id. Empty tables give no rows. Only vec_id and embedding are read, whatever other columns there are.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K = 5
#: The greatest score; its negative is the smallest.
MOST = 2**63 - 1
STEP = 1.02
BLOCK_VECTORS = 4096
BLOCK_QUERIES = 1024
LOCAL_BUCKET = 256
SEED_VECTORS = 512
#: Coordinates looked at by coordinate pruning, and the cosine above which it is chosen.
FOCUS, COORDINATE_FROM = 6, 0.6


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(id, v, dim, norm): floor(scale * x) of each component, of the vectors that take part."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.coalesce(
        F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float(1 << 52) / scale))), F.lit(False)
    )
    v = F.transform("embedding", lambda c: F.floor(F.lit(float(scale)) * c.cast("double")).cast("long"))
    square = F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double"))
    return (
        vectors.select(F.col("vec_id").alias("id"), F.when(finite, F.col("embedding")).alias("embedding"))
        .where("embedding IS NOT NULL")
        .select("id", v.alias("v"))
        .select("id", "v", F.size("v").alias("dim"), F.sqrt(square).alias("norm"))
    )


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0), np.int64)


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Integer products, exact up to ``MOST`` in size and cut there: as doubles while every sum stays below 2**53, else
    as integers of any size."""
    most = (np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * max(1, queries.shape[1])
    if most < 2.0**53:
        return (queries.astype(np.float64) @ vectors.astype(np.float64).T).astype(np.int64)
    exact = [[sum(int(a) * int(b) for a, b in zip(q, v, strict=True)) for v in vectors] for q in queries]
    return np.array([[min(max(x, -MOST), MOST) for x in row] for row in exact], np.int64).reshape(len(queries), len(vectors))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search_block(
    qid: np.ndarray, q: np.ndarray, floor: np.ndarray, vid: np.ndarray, v: np.ndarray, k: int = K, seen: dict | None = None
) -> list[tuple[int, int, int]]:
    """(place of query, vector id, score): at most k for each query, none below the query's ``floor``."""
    length = np.sqrt((v.astype(np.float64) ** 2).sum(1))
    order = np.lexsort((vid, -length))
    vid, v, length = vid[order], v[order], length[order]
    unit = v / np.maximum(length, 1e-300)[:, None]
    qlen = np.sqrt((q.astype(np.float64) ** 2).sum(1))
    out = []
    for i in range(len(q)):
        direction = q[i] / max(qlen[i], 1e-300)
        focus = np.argsort(-np.abs(direction))[:FOCUS]
        have_s, have_id, bar = np.zeros(0, np.int64), np.zeros(0, np.int64), floor[i]
        for at in range(0, len(v), LOCAL_BUCKET):
            end = min(at + LOCAL_BUCKET, len(v))
            reach = qlen[i] * length[at]
            # the floor may be minus infinity; a tiny slack keeps rounding from pruning an exact tie
            t = (bar / reach if reach > 0 else math.copysign(2.0, bar) if bar else 0.0) - 1e-9
            if t > 1:
                if seen is not None:
                    seen["skipped"] = seen.get("skipped", 0) + len(v) - at
                break
            here = np.arange(at, end)
            if t > 0:
                if t >= COORDINATE_FROM:
                    # a unit vector within the angle of cosine t of q has its coordinate f within this range, d being q's
                    d = direction[focus]
                    spread = np.sqrt((1 - d * d).clip(0) * max(0.0, 1 - t * t)) + 1e-9
                    low, high = np.where(d <= -t, -1.1, d * t - spread), np.where(d >= t, 1.1, d * t + spread)
                    inside = unit[at:end][:, focus]
                    here = here[((inside >= low) & (inside <= high)).all(1)]
                    if seen is not None:
                        seen["coordinate"] = seen.get("coordinate", 0) + end - at - len(here)
                else:
                    here = here[qlen[i] * length[here] >= bar * (1 - 1e-9)]
            here = here[vid[here] != qid[i]]
            if not len(here):
                continue
            scores = products(q[i : i + 1], v[here])[0]
            good = scores >= bar
            have_s, have_id = np.concatenate([have_s, scores[good]]), np.concatenate([have_id, vid[here][good]])
            top = _best(have_s, have_id, k)
            have_s, have_id = have_s[top], have_id[top]
            if len(have_s) == k:
                bar = max(bar, float(have_s[-1]))
        out += [(i, int(a), int(b)) for a, b in zip(have_id, have_s, strict=True)]
    return out


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int = K, scale: int = 256, block_vectors: int = BLOCK_VECTORS, block_queries: int = BLOCK_QUERIES
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best rows of ``vectors`` for each row of ``queries``.

    Both have (vec_id, embedding). Vectors without an id take no part.
    """
    from .common import cut_lineage

    stored = cut_lineage(quantised(vectors, scale).where("id IS NOT NULL"), "vectors")
    asked = cut_lineage(quantised(queries, scale).where("id IS NOT NULL").distinct(), "queries")
    # lengths differ by less than STEP within a bucket; a bucket with many vectors is dealt into blocks
    bucket = F.when(F.col("norm") < 1, -1).otherwise(F.floor(F.log("norm") / math.log(STEP))).cast("int")
    stored = stored.withColumn("bucket", bucket)
    sizes = cut_lineage(
        stored.groupBy("dim", "bucket")
        .agg(F.count("*").alias("n"), F.max("norm").alias("reach"))
        .withColumn("blocks", F.ceil(F.col("n") / block_vectors).cast("int")),
        "buckets",
    )
    dims = [r.dim for r in asked.select("dim").distinct().collect()]
    seeds = [
        (d, stored.where(F.col("dim") == d).orderBy(F.desc("norm"), "id").limit(SEED_VECTORS).toPandas()) for d in dims
    ]  # at most SEED_VECTORS rows for each dimension
    floors = _with_floor(asked, {d: (s["id"].to_numpy(np.int64), _matrix(s["v"])) for d, s in seeds}, k)
    many = asked.count()
    split = max(1, math.ceil(many / block_queries))
    asked = floors.withColumn("qblock", F.pmod(F.xxhash64("id", "v"), F.lit(split)).cast("int"))
    asked = asked.withColumn("query", F.monotonically_increasing_id())  # drawn once, as the table is written
    asked = cut_lineage(asked, "asked")
    # which (query block, vector block) pairs can meet: a block whose longest vector stays below every threshold is left out
    need = asked.groupBy("dim", "qblock").agg(F.min(F.when(F.col("norm") > 0, F.col("floor") / F.col("norm")).otherwise(F.lit(-math.inf))).alias("need"))
    pairs = cut_lineage(
        need.join(sizes, "dim")
        .where(F.col("reach") >= F.col("need") * (1 - 1e-9))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select("dim", "qblock", "bucket", "block"),
        "pairs",
    )
    dealt = stored.join(sizes.select("dim", "bucket", "blocks"), ["dim", "bucket"]).withColumn(
        "block", F.pmod(F.xxhash64("id", "v"), F.col("blocks")).cast("int")
    )
    key = ["dim", "qblock", "bucket", "block"]
    left = dealt.join(pairs, ["dim", "bucket", "block"]).select(*key, "id", "v")
    right = asked.join(pairs, ["dim", "qblock"]).select(*key, "query", "id", "v", "floor")

    columns = ["query", "query_id", "vec_id", "score"]

    def search(vs: pd.DataFrame, qs: pd.DataFrame) -> pd.DataFrame:
        if not len(vs) or not len(qs):
            return pd.DataFrame({c: [] for c in columns}).astype("int64")
        qid = qs["id"].to_numpy(np.int64)
        found = search_block(qid, _matrix(qs["v"]), qs["floor"].to_numpy(float), vs["id"].to_numpy(np.int64), _matrix(vs["v"]), k)
        query = qs["query"].to_numpy(np.int64)
        return pd.DataFrame([(query[i], qid[i], a, b) for i, a, b in found], columns=columns).astype("int64")

    local = (
        left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(search, ", ".join(f"{c} long" for c in columns))
    )
    place = F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id)")
    return (
        local.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )


def _with_floor(asked: DataFrame, seeds: dict, k: int) -> DataFrame:
    """Each query with its k-th best score among the seeds: no result can be below it."""
    sent = asked.sparkSession.sparkContext.broadcast(seeds)

    @F.pandas_udf("double")
    def floor(ids: pd.Series, vs: pd.Series) -> pd.Series:
        out = []
        for i, q in zip(ids, vs, strict=True):
            vid, v = sent.value.get(len(q), (np.zeros(0, np.int64), np.zeros((0, 0))))
            others = vid != i
            if others.sum() < k:
                out.append(-math.inf)
                continue
            out.append(float(np.sort(products(np.asarray(q)[None, :], v[others])[0])[-k]))
        return pd.Series(out, dtype="float64")

    return asked.withColumn("floor", floor("id", "v"))
