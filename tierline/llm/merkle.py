"""Merkle dataset manifest by cogrouped subtree exchange.

Each document is a leaf; the leaves of a source form a tree in which every run of ``FAN`` consecutive nodes becomes
their hash, and the sources' roots form one more such tree. No tree is ever held in one place:

* up: nodes are grouped by superblock (``block`` consecutive ranks of a tree) and each superblock is reduced to its top
  node; the tops are the nodes of the next, ``block`` times smaller table, until every tree has one node;
* down: the nodes of a superblock are cogrouped with the one row that says what lies outside of it (the siblings on the
  way from its top to the root). The cogroup finishes the local reduction, joins the inner siblings of each node to the
  outer ones, and, for leaves, folds what was presented up to the root.

A superblock holds at most ``block`` nodes, whatever share of the documents its source owns, so a source with a third
of all rows is cut like any other. Texts are hashed where they are read; only digests are shuffled and stored.

Defined results: a null field is ``-``, so null and empty text differ, and a null source is a source of its own, the
first one; a null doc_id comes first in its source; rows with equal source and doc_id are ordered by their leaf, and
equal rows are leaves side by side; an empty table gives no rows; a lone leaf is its source's root, and a lone source's
root the root, with no siblings and the digest of nothing as proof. Texts of any length count whole. Only the five
columns of a leaf are read; whatever else the table holds, also under names used in here, plays no part.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, ranked

FAN = 3
#: Nodes of a superblock: a power of ``FAN``.
BLOCK = FAN**6
NODE = "tree long, rank long, n long, digest string"
#: What lies outside of a node: its siblings on each level up to the root, lowest first. A step is the node's place in
#: its run (one digit), then its siblings' digests.
OUTER = "tree long, rank long, path array<string>, subroot string, root string"


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def leaf(text: Column) -> Column:
    """The leaf of a document if it had this ``text``: the digest of its fields, each with its length in bytes."""

    def field(value: Column) -> Column:
        value = value.cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text]
    return F.sha2(F.concat(*map(field, fields)).cast("binary"), 256)


def levels_of(nodes: list[str], n: int, block: int) -> list[list[str]]:
    """The levels of a superblock, its ``nodes`` first and its top last, in a tree that has ``n`` nodes on their level."""
    levels, width = [nodes], 1
    while n > 1 and width < block:
        below = levels[-1]
        levels.append([digest("".join(below[i : i + FAN])) for i in range(0, len(below), FAN)])
        n, width = -(-n // FAN), width * FAN
    return levels


def inner_paths(levels: list[list[str]]) -> list[list[str]]:
    """For each of a superblock's nodes its steps up to the superblock's top."""
    paths: list[list[str]] = [[] for _ in levels[0]]
    width = 1
    for level in levels[:-1]:
        steps = []
        for i in range(len(level)):
            run, at = i - i % FAN, i % FAN
            steps.append(f"{at}{''.join(level[run:i])}{''.join(level[i + 1 : run + FAN])}")
        for i, path in enumerate(paths):
            path.append(steps[i // width])
        width *= FAN
    return paths


def fold(node: str, path: list[str]) -> str:
    """The root that ``node`` leads to with the siblings of ``path``."""
    for step in path:
        at = 1 + 64 * int(step[0])
        node = digest(step[1:at] + node + step[at:])
    return node


def proof(path: list[str]) -> str:
    return digest("".join(step[1:] for step in path))


def _by_block(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"rank div {block}"))


def reduce_up(nodes: DataFrame, block: int = BLOCK) -> list[DataFrame]:
    """``nodes`` (tree, rank, n, digest; n: nodes of the tree on this level), then the tables of superblocks' tops, the
    last with one node for each tree. Each table is stored."""

    def top(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        n = int(group["n"].iloc[0])
        levels = levels_of(group["digest"].tolist(), n, block)
        left = -(-n // FAN ** (len(levels) - 1))
        row = (group["tree"].iloc[0], group["block"].iloc[0], left, levels[-1][0])
        return pd.DataFrame([row], columns=["tree", "rank", "n", "digest"])

    tables = [nodes]
    while tables[-1].where("n > 1").limit(1).count():
        grouped = _by_block(tables[-1].select("tree", "rank", "n", "digest"), block).groupBy("tree", "block")
        tables.append(cut_lineage(grouped.applyInPandas(top, NODE), "merkle-tops"))
    return tables


def _exchange(nodes: DataFrame, outer: DataFrame, block: int, finish, schema: str) -> DataFrame:
    """The nodes of each superblock with the row of ``outer`` that belongs to its top, in one cogroup."""

    def join(inside: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        inside = inside.sort_values("rank")
        paths = inner_paths(levels_of(inside["digest"].tolist(), int(inside["n"].iloc[0]), block))
        above = outside.iloc[0]
        whole = [path + list(above["path"]) for path in paths]
        return finish(inside, whole, above["subroot"], above["root"])

    left = _by_block(nodes, block).groupBy("tree", "block")
    return left.cogroup(outer.groupBy("tree", "rank")).applyInPandas(join, schema)


def _paths(inside: pd.DataFrame, paths: list[list[str]], subroot: str, root: str) -> pd.DataFrame:
    out = inside[["tree", "rank"]].copy()
    out["path"], out["subroot"], out["root"] = paths, subroot, root
    return out


def _verdicts(inside: pd.DataFrame, paths: list[list[str]], subroot: str, root: str) -> pd.DataFrame:
    out = inside[["doc_id", "digest"]].rename(columns={"digest": "leaf"})
    out["subroot"], out["root"] = subroot, root
    out["proof_sha256"] = [proof(path) for path in paths]
    out["folded_root"] = [fold(node, path) for node, path in zip(inside["presented"], paths, strict=True)]
    out["verified"] = out["folded_root"] == root
    return out


def reach_down(tables: list[DataFrame], outer: DataFrame, block: int = BLOCK) -> DataFrame:
    """What lies outside of each node of ``tables[1]`` (or of the trees' roots, if there is no such table)."""
    for nodes in tables[:0:-1]:
        if nodes is not tables[-1]:
            outer = cut_lineage(_exchange(nodes, outer, block, _paths, OUTER), "merkle-outer")
    return outer


def manifest(docs: DataFrame, presented: Column, block: int = BLOCK) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) for each row of ``docs``.

    ``presented`` is the text that is to be verified: its leaf is folded with the siblings of the document's own leaf.
    """
    hashed = docs.select("doc_id", "source", leaf(F.col("text")).alias("digest"), leaf(presented).alias("presented"))
    # hashed once: the exchange by range samples its input and then reads it again
    hashed = cut_lineage(hashed, "merkle-leaves")
    leaves = ranked(hashed, "source", ["doc_id", "digest"])
    sources = hashed.groupBy("source").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    sources = cut_lineage(
        ranked(sources, "all", ["source"], "tree").select(F.col("source").alias("name"), "n", "tree"), "merkle-sources"
    )
    nodes = cut_lineage(
        leaves.join(sources, F.col("source").eqNullSafe(F.col("name"))).select(
            # as text: pandas has no whole numbers with nulls
            "tree", "rank", "n", "digest", "presented", F.col("doc_id").cast("string").alias("doc_id")
        ),
        "merkle-nodes",
    )
    trees = reduce_up(nodes, block)
    subroots = trees[-1].select("tree", F.col("digest").alias("subroot"))

    count = sources.count()
    forest = reduce_up(
        subroots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("rank"), F.lit(count).alias("n"), F.col("subroot").alias("digest")),
        block,
    )
    empty = F.array().cast("array<string>")
    above = forest[-1].select("tree", "rank", empty.alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    if len(forest) > 1:
        above = _exchange(forest[0], reach_down(forest, above, block), block, _paths, OUTER)
    above = above.select(F.col("rank").alias("tree"), "path", "root")
    outer = subroots.join(above, "tree").select("tree", F.lit(0).cast("long").alias("rank"), "path", "subroot", "root")

    id_type = docs.schema["doc_id"].dataType
    verdict = "doc_id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    out = _exchange(nodes, reach_down(trees, cut_lineage(outer, "merkle-outer"), block), block, _verdicts, verdict)
    return out.withColumn("doc_id", F.col("doc_id").cast(id_type))
