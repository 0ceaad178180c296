from hashlib import sha256
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from tierline.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, rank long, tree string, digest int, block string"


def h(x):
    return sha256(x.encode()).hexdigest()


def plain(rows, shown):
    """The manifest with whole trees in memory, one node after the other."""

    def leaf(row, text):
        fields = [row[0], row[1], row[2], row[3], text]
        return h("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([h("".join(below[i : i + 3])) for i in range(0, len(below), 3)])
        return levels

    def steps(levels, i):
        for level in levels[:-1]:
            run = i - i % 3
            yield level[run:i], level[i + 1 : run + 3]
            i //= 3

    by_source = {}
    for row in rows:
        by_source.setdefault(row[1], []).append((row[0] is not None, row[0] or 0, leaf(row, row[4]), leaf(row, shown(row)), row[0]))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names}
    top = tree([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, (_, _, own, other, doc) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            path = [*steps(trees[s], i), *steps(top, k)]
            node = other
            for left, right in path:
                node = h("".join(left) + node + "".join(right))
            proof = h("".join("".join(left + right) for left, right in path))
            out.append((doc, own, trees[s][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def without_breaks(row):
    even = row[0] is not None and crc32(str(row[0]).encode()) % 2 == 0
    return row[4].replace("\n", "") if even and row[4] is not None else row[4]


def tampered():
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    return F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))


def compare(spark, rows, block):
    docs = spark.createDataFrame([(*r, 7, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in merkle.manifest(docs, tampered(), block).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(got, key=key) == sorted(plain(rows, without_breaks), key=key)


@pytest.mark.parametrize("block", [3, 9, 729])
def test_trees_of_many_sizes(spark, block):
    """Sources of 1 to 100 documents: full runs, short runs, runs of one, several levels of superblocks."""
    rows = [(s * 1000 + i, f"s{s}", "en", i, f"a\n{i}é") for s, n in enumerate([1, 2, 3, 4, 10, 28, 100]) for i in range(n)]
    compare(spark, rows, block)


def test_nulls_repeats_and_long_texts(spark):
    rows = [
        (None, None, None, None, None), (None, None, None, None, ""), (1, None, "en", 3, "a\nb"), (1, None, "en", 3, "a\nb"),
        (2, "", "", 0, ""), (2, "", "", 0, None), (2, "", "", 0, "\n" * 5), (-7, "ü", "de", 1, "x\n" * 200_000),
        (9007199254740993, "z", "de", 1, "x"), (9007199254740992, "z", "de", 1, "x"), (2**62, "Z", "de", 1, "1:x-"),
    ]
    compare(spark, rows, 3)


def test_one_and_no_document(spark):
    compare(spark, [(5, "a", "en", 1, "x\n")], 9)
    compare(spark, [], 9)


def test_a_changed_sibling_is_seen():
    levels = merkle.levels_of([h(str(i)) for i in range(20)], 20, 27)
    for node, path in zip(levels[0], merkle.inner_paths(levels), strict=True):
        assert merkle.fold(node, path) == levels[-1][0]
        assert merkle.fold(h("other"), path) != levels[-1][0]
