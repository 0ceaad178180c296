"""Quoted CSV files read by all tasks, although a quoted value may hold line breaks.

Spark's text source cuts a file into blocks and gives each line to the block it begins in. Whether a line begins inside
a quoted value depends on all lines before it, but on little of them: a block either keeps the state it begins with,
turns it round, or ends in one state whatever it began with. So one pass finds each block's effect, a running sum over
the blocks (one row for each) gives each block's true first state, and a second pass cuts the blocks into records. The
few records that lie across blocks are put together from their pieces. Records go to Spark's own ``from_csv``.

What the cut follows are the rules of Spark's reader: a value is quoted if it begins with ``"``, ``""`` in it is one
quote, and after its closing quote anything up to the comma belongs to it. A file's lines all end as its header does,
in LF or in CRLF. A value that a file never closes ends before the file's last line break.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"
_BOM_BYTES = BOM.encode()
#: States in which a line may begin: between records, or inside a quoted value.
BETWEEN, INSIDE = 0, 1
_CLOSED = rb'"(?:[^"]|"")*+"'
_FIELDS = re.compile(rb'(?:(?:' + _CLOSED + rb'[^,]*+|(?!")[^,]*+)(?:,|\Z))*+')
_REST = re.compile(rb'(?:[^"]|"")*+"[^,]*+(?:,|\Z)')


def state_after(line: bytes, state: int) -> int:
    """The state in which the next line begins."""
    at = 0
    if state == INSIDE:
        closing = _REST.match(line)
        if closing is None:
            return INSIDE
        at = closing.end()
        if at == len(line) and not line.endswith(b","):
            return BETWEEN
    return BETWEEN if _FIELDS.match(line, at).end() == len(line) else INSIDE


def _lines(spark: SparkSession, path) -> DataFrame:
    """(file, block, line): raw bytes; the file as a hash of its path, the block as its first byte."""
    return spark.read.text(path, lineSep="\n").select(
        F.xxhash64("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("value").cast("binary").alias("line"),
    )


def _runs(batches) -> Iterator[tuple[int, int, bool, pa.Array]]:
    """(file, block, is its beginning, lines): a task's lines, those of one block after the other."""
    before = None
    for batch in batches:
        if not batch.num_rows:
            continue
        change = pc.or_(*(pc.not_equal(batch.column(c).slice(1), batch.column(c).slice(0, batch.num_rows - 1)) for c in (0, 1)))
        cuts = [0, *(i + 1 for i in pc.indices_nonzero(change).to_pylist()), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            here = batch.column(0)[a].as_py(), batch.column(1)[a].as_py()
            lines = batch.column(2).slice(a, b - a)
            if here != before and here[1] == 0 and lines[0].as_py().startswith(_BOM_BYTES):
                lines = pa.concat_arrays([pa.array([lines[0].as_py()[len(_BOM_BYTES) :]], pa.binary()), lines.slice(1)])
            yield *here, here != before, lines
            before = here


def _quoted(lines: pa.Array) -> list[int]:
    """Places of the lines that hold a quote; no other line changes the state."""
    return pc.indices_nonzero(pc.match_substring(lines, '"')).to_pylist()


def block_effects(lines: DataFrame) -> DataFrame:
    """(file, block, from_between, from_inside): in which state each block ends."""

    def effects(batches):
        held = None
        for file, block, begins, lines in _runs(batches):
            if begins:
                if held:
                    yield held
                held = [file, block, BETWEEN, INSIDE]
            for i in _quoted(lines):
                line = lines[i].as_py()
                met = held[2] == held[3]
                held[2] = state_after(line, held[2])
                held[3] = held[2] if met else state_after(line, held[3])
        if held:
            yield held

    def rows(batches):
        for held in effects(batches):
            yield pa.RecordBatch.from_pylist([dict(zip(names, held, strict=True))], schema)

    names = ["file", "block", "from_between", "from_inside"]
    schema = pa.schema([pa.field("file", pa.int64()), pa.field("block", pa.int64()), pa.field(names[2], pa.int32()), pa.field(names[3], pa.int32())])
    return lines.mapInArrow(rows, "file long, block long, from_between int, from_inside int")


def first_states(effects: DataFrame) -> DataFrame:
    """``effects`` with ``state``, in which each block begins: the last fixed end before it, turned round by the blocks since."""
    return (
        effects.withColumn("turns", F.expr("int(from_between > from_inside)"))
        .withColumn("turned", F.expr("sum(turns) OVER (PARTITION BY file ORDER BY block)"))
        .withColumn("fixed", F.expr("CASE WHEN from_between = from_inside THEN struct(from_between AS ends, turned) END"))
        .withColumn("last", F.expr("last(fixed, true) OVER (PARTITION BY file ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"))
        .withColumn("state", F.expr("int((coalesce(last.ends, 0) + turned - turns - coalesce(last.turned, 0)) % 2)"))
        .select("file", "block", "state", "from_between", "from_inside")
    )


RECORDS = "file long, block long, first boolean, opens boolean, record binary"


def _cut(lines: DataFrame, inside: set[tuple[int, int]], pieces: bool) -> DataFrame:
    """The records that lie in one block, or, with ``pieces``, the parts of those that do not.

    ``inside`` lists the blocks that begin in a quoted value. ``opens`` tells the piece in which a record begins.
    """
    sent = lines.sparkSession.sparkContext.broadcast(inside)

    def block_records(runs):
        """(file, block, is the file's first, opens, closes, lines) of one block's records."""
        state = held = where = None
        for file, block, begins, lines in runs:
            if begins:
                if held:
                    yield (*where, True, held)
                state = INSIDE if (file, block) in sent.value else BETWEEN
                where, held = (file, block, block == 0 and state == BETWEEN, state == BETWEEN), []
            quoted = iter(_quoted(lines))
            following = next(quoted, None)
            at = 0
            while at < len(lines):
                if state == BETWEEN and not held:
                    plain = (following if following is not None else len(lines)) - at
                    if plain > 1 and not where[2]:  # lines without a quote: each is a record
                        yield (*where, False, lines.slice(at, plain))
                        at += plain
                        continue
                line = lines[at].as_py()
                if at == following:
                    state, following = state_after(line, state), next(quoted, None)
                held.append(line)
                at += 1
                if state == BETWEEN:
                    yield (*where, False, held)
                    where, held = (file, block, False, True), []
        if held:
            yield (*where, True, held)

    def cut(batches):
        rows: list[tuple] = []

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
            rows.clear()
            return out

        for file, block, first, opens, unfinished, own in block_records(_runs(batches)):
            whole = opens and not unfinished
            if whole == pieces:
                continue
            if isinstance(own, pa.Array):
                if rows:
                    yield flush()
                n = len(own)
                same = [pa.array([x] * n, t) for x, t in zip((file, block, first, opens), kinds, strict=False)]
                yield pa.RecordBatch.from_arrays([*same, own], names)
                continue
            rows.append((file, block, first, opens, b"\n".join(own)))
            if len(rows) >= 1024:
                yield flush()
        if rows:
            yield flush()

    names = ["file", "block", "first", "opens", "record"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary()]
    return lines.mapInArrow(cut, RECORDS)


def records(spark: SparkSession, path, text) -> DataFrame:
    """(file, first, record): every record of the files as text; ``first`` marks each file's first.

    What goes to the tasks is the list of blocks that begin inside a quoted value: at most one pair of numbers for each
    block of the input (``spark.sql.files.maxPartitionBytes``), and none for files without such values.
    """
    lines = _lines(spark, path)
    inside = first_states(block_effects(lines)).where(F.col("state") == INSIDE)
    across = {(r["file"], r["block"]) for r in inside.select("file", "block").toLocalIterator()}
    whole = _cut(lines, across, pieces=False).select("file", "first", text(F.col("record")).alias("record"))
    if not across:
        # an open record can then only be a file's last one
        ends = _cut(lines, across, pieces=True)
        return whole.unionByName(ends.select("file", "first", text(F.col("record")).alias("record")))
    parts = _cut(lines, across, pieces=True).withColumn(
        "begun", F.expr("last(CASE WHEN opens THEN block END, true) OVER (PARTITION BY file ORDER BY block, opens ROWS UNBOUNDED PRECEDING)")
    )
    joined = parts.groupBy("file", "begun").agg(
        F.max("first").alias("first"),
        F.array_sort(F.collect_list(F.struct("block", "opens", text(F.col("record")).alias("piece")))).alias("pieces"),
    )
    return whole.unionByName(joined.select("file", "first", F.array_join("pieces.piece", "\n").alias("record")))


def read_quoted_csv(spark: SparkSession, path, encoding: str) -> DataFrame:
    """CSV files with a header, every column as text; short rows end in nulls, long ones are cut.

    All files must have the same header and line ends. Empty lines are no records.
    """
    options = {"quote": '"', "escape": '"', "mode": "PERMISSIVE", "multiLine": "true"}

    def text(data: Column) -> Column:
        return data.cast("string") if encoding.upper().replace("-", "") == "UTF8" else F.decode(data, encoding)

    found = records(spark, path, text)
    heads = found.where("first").groupBy("record").count().limit(2).collect()
    if not heads:
        return spark.createDataFrame([], "value string").drop("value")
    if len(heads) > 1:
        raise ValueError(f"files with different headers: {heads[0]['record']!r} and {heads[1]['record']!r}")
    head = heads[0]["record"]
    if head.endswith("\r"):  # every line ends in CRLF; inside a value it is one line break too
        head = head[:-1].replace("\r\n", "\n")
        found = found.withColumn("record", F.regexp_replace(F.replace("record", F.lit("\r\n"), F.lit("\n")), "\\r\\z", ""))
    lines = spark.createDataFrame([(head,)], "value string")
    names = spark.read.csv(lines.rdd.map(lambda r: r[0]), header=True, quote='"', escape='"').columns
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = found.where("NOT first AND record != ''").select(F.from_csv("record", schema, options).alias("r"))
    return rows.select("r.*")
