"""Resharding by minimum-cost flow.

From the rows of the old shards and the capacities of the new ones, a flow of blocks of rows is solved that moves the
fewest bytes; then only the affected shards' files are rewritten.

Each old shard is cut, by rising row size, into at most three blocks: the rows that must leave whatever the plan, the
rows that leave or stay according to the plan, and the rest. Keeping a row costs nothing, moving it costs its bytes.
Moving costs the same to any place, so all moves go through one node and the network has a few arcs for each shard,
not one for each pair. Blocks and shards are all that reaches the driver. With capacities that leave at most one row
of play for each shard (as in ``even_rows``) the blocks' costs are exact, so no other plan moves fewer bytes.

A row's new shard follows from its place in the old shard's order, by comparing its sort key with a few cuts, so texts
are not shuffled to find it. Shards that lose no row keep their files; rows that come in are added beside them.

Defined results: a null text has no bytes; null ids sort first; repeated rows are rows of their own (their place in
the files tells them apart); an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ranked, scratch_dir

#: Bytes that a row takes besides its text.
ROW_BYTES = 16
OLD = "__shard"
KEY = ["size", "doc_id", "file", "row"]


class Block(NamedTuple):
    shard: int  # where it lies
    rows: int
    bytes: int


def min_cost_flow(arcs: list[tuple[int, int, int, int]], source: int, sink: int) -> list[int]:
    """The flow on each arc (from, to, capacity, cost) of a maximum flow of least cost: successive shortest paths.

    Costs may be negative where no cycle is.
    """
    to, room, cost, out = [], [], [], defaultdict(list)
    for a, b, most, price in arcs:
        for x, y, r, c in ((a, b, most, price), (b, a, 0, -price)):
            out[x].append(len(to))
            to.append(y)
            room.append(r)
            cost.append(c)
    nodes = set(out) | set(to)
    potential = dict.fromkeys(nodes, 0)
    for _ in nodes:  # Bellman-Ford, once, for the negative costs
        changed = False
        for x in nodes:
            for e in out[x]:
                if room[e] and potential[x] + cost[e] < potential[to[e]]:
                    potential[to[e]] = potential[x] + cost[e]
                    changed = True
        if not changed:
            break
    while True:
        near, by, heap = {source: 0}, {}, [(0, source)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > near[x]:
                continue
            for e in out[x]:
                step = d + cost[e] + potential[x] - potential[to[e]]
                if room[e] and step < near.get(to[e], step + 1):
                    near[to[e]], by[to[e]] = step, e
                    heapq.heappush(heap, (step, to[e]))
        if sink not in near:
            return [room[2 * i + 1] for i in range(len(arcs))]
        for x in nodes:
            potential[x] += min(near.get(x, near[sink]), near[sink])
        path, x = [], sink
        while x != source:
            path.append(by[x])
            x = to[by[x] ^ 1]
        push = min(room[e] for e in path)
        for e in path:
            room[e] -= push
            room[e ^ 1] += push


def solve(blocks: list[Block], capacities: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Transfers (block, new shard, rows) that move the fewest bytes; every shard ends within its (least, most) rows."""
    n, m = len(blocks), len(capacities)
    source, sink, moving = n + m, n + m + 1, n + m + 2
    filled = -(sum(b.bytes for b in blocks) + 1)  # no saving outweighs a shard below its least
    arcs = []
    for i, b in enumerate(blocks):
        arcs.append((source, i, b.rows, 0))
        arcs.append((i, moving, b.rows, round(b.bytes / b.rows)))
        if b.shard < m:
            arcs.append((i, n + b.shard, b.rows, 0))
    for j, (least, most) in enumerate(capacities):
        arcs += [(moving, n + j, most, 0), (n + j, sink, least, filled), (n + j, sink, most - least, 0)]
    flow = min_cost_flow(arcs, source, sink)
    if sum(f for (a, *_), f in zip(arcs, flow, strict=True) if a == source) != sum(b.rows for b in blocks):
        raise ValueError("the new shards cannot hold all rows")
    stays, leaves, comes = [], [], []
    for (a, b, *_), f in zip(arcs, flow, strict=True):
        if f and a < n and b != moving:
            stays.append((a, b - n, f))
        elif f and b == moving:
            leaves.append([a, f])
        elif f and a == moving:
            comes.append([b - n, f])
    transfers = stays
    while leaves and comes:  # any pairing moves as many bytes; this one makes few transfers
        f = min(leaves[0][1], comes[0][1])
        transfers.append((leaves[0][0], comes[0][0], f))
        for side in (leaves, comes):
            side[0][1] -= f
            if not side[0][1]:
                side.pop(0)
    return transfers


def even_rows(rows: int, shards: int) -> list[tuple[int, int]]:
    """Capacities that put counts at most one apart."""
    return [(rows // shards, rows // shards + (rows % shards > 0))] * shards


def write_layout(docs: DataFrame, shard, path: str) -> None:
    """``docs`` as one folder of files for each shard; a shard that holds a third of the rows is cut into several files."""
    docs.withColumn(OLD, shard.cast("int")).hint("rebalance", OLD).write.partitionBy(OLD).option("compression", "zstd").parquet(path)


class Layout(NamedTuple):
    """Where the rows lie: ``kept`` shards in the old folder, all the rest in the new one."""

    old: str
    new: str
    kept: list[int]
    moved_rows: int
    moved_bytes: int
    schema: T.StructType

    def read(self, spark: SparkSession) -> DataFrame:
        old = spark.read.schema(self.schema).parquet(self.old).where(F.col(OLD).isin(self.kept))
        return old.unionByName(spark.read.schema(self.schema).parquet(self.new))


def _size():
    return (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size")


def reshard(spark: SparkSession, path: str, schema: T.StructType, capacities: list[tuple[int, int]] | int) -> Layout:
    """Move the rows of the layout at ``path`` (columns of ``schema`` and ``OLD``) into shards of these capacities in rows.

    ``capacities``: (least, most) of each shard, or a number of shards for counts at most one apart.
    """
    schema = T.StructType([*schema.fields, T.StructField(OLD, T.IntegerType())])
    stored = spark.read.schema(schema).parquet(path)
    where = [F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")]
    places = ranked(stored.select(OLD, _size(), "doc_id", *where), OLD, KEY).select(OLD, "rank", *KEY)
    total = {r[0]: r[1] for r in places.groupBy(OLD).count().collect()}  # one number for each shard
    if isinstance(capacities, int):
        capacities = even_rows(sum(total.values()), capacities)
    edges = {}
    for shard, rows in total.items():
        least, most = capacities[shard] if shard < len(capacities) else (0, 0)
        edges[shard] = sorted({0, max(0, rows - most), max(0, rows - least), rows})
    steps = spark.createDataFrame(
        [(s, a, b) for s, e in edges.items() for a, b in zip(e, e[1:], strict=False)], f"{OLD} int, first long, end long"
    )
    sums = places.join(F.broadcast(steps), OLD).where("rank >= first AND rank < end")  # three rows for each shard
    sums = sums.groupBy(OLD, "first").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")).orderBy(OLD, "first").collect()
    blocks = [Block(r[OLD], r["rows"], r["bytes"]) for r in sums]
    transfers = solve(blocks, capacities)
    # a block's leaving rows are its smallest: within each old shard, order the parts by block, movers first
    parts = defaultdict(list)
    for i, to, f in sorted(transfers, key=lambda x: (x[0], blocks[x[0]].shard == x[1])):
        parts[blocks[i].shard].append((to, f))
    ends, moved = [], 0
    for shard, dealt in parts.items():
        at = 0
        for to, f in dealt:
            at += f
            moved += f * (to != shard)
            ends.append((shard, at, to))
    cut = spark.createDataFrame(ends, f"{OLD} int, rank long, to int")
    known = places.join(F.broadcast(cut.select(OLD, "rank")), [OLD, "rank"]).collect()  # one row for each transfer
    key_at = {(r[OLD], r["rank"]): tuple(r[k] for k in KEY) for r in known}
    kind = "size: bigint, doc_id: bigint, file: string, row: bigint"
    cuts = spark.createDataFrame(
        [
            (s, [(key_at.get((s, e)), t) for e, t in sorted((e, t) for x, e, t in ends if x == s)])
            for s in {x for x, _, _ in ends}
        ],
        f"__of int, __cuts array<struct<before: struct<{kind}>, to: int>>",
    )
    key = F.struct(_size(), F.col("doc_id").cast("long").alias("doc_id"), *where)
    keyed = stored.withColumn("__key", key).join(F.broadcast(cuts), F.col(OLD) == F.col("__of"))  # one row for each shard
    dealt = F.filter("__cuts", lambda c: c["before"].isNull() | (F.col("__key") < c["before"]))[0]["to"]
    keyed = keyed.withColumn("__to", dealt)
    losing = sorted({s for s, _, t in ends if s != t})
    kept = sorted(set(total) - set(losing))
    new = scratch_dir(spark, "reshard")
    changed = keyed.where(F.col(OLD).isin(losing) | (F.col("__to") != F.col(OLD))).withColumn(OLD, F.col("__to"))
    changed.drop("__key", "__of", "__cuts", "__to").hint("rebalance", OLD).write.partitionBy(OLD).option("compression", "zstd").parquet(new)
    gone = defaultdict(int)
    for i, to, f in transfers:
        gone[i] += f * (to != blocks[i].shard)
    moved_bytes = sum(round(blocks[i].bytes * f / blocks[i].rows) for i, f in gone.items())
    return Layout(path, new, kept, moved, moved_bytes, schema)


def manifest(spark: SparkSession, layout: Layout) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row as it lies in the files."""
    rows = layout.read(spark).select(
        "doc_id", _size(), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), F.col(OLD).alias("shard")
    )
    return ranked(rows, "shard", ["doc_id", "size", "text_crc32"], "slot")
