"""Incremental news merge.

Each micro-batch appends the new state of the rows it touched; the table is
the newest state per key. Nothing is rewritten in place, and a batch that is
retried replaces its own folder, so the result is exactly-once. Of several
sights of a row the one seen last wins, whatever batch it came in; no sight is
dropped for being late.

Layout under the table's folder: ``log/batch=<n>/bucket=<b>`` holds states by
batch and key bucket; ``base/upto=<n>/bucket=<b>`` holds the folded states of
the batches after ``since`` up to n, written by ``compact`` and valid once
``bases`` names it with its ``since``, which is the base before it (-1: none).
A base folds in the bases before it that cover no more batches than itself, so
a state is written again only as often as its base doubles. A batch reads only
the buckets it touches, of the newest base, of those before it and of the
batches after it.

``stream_feeds`` is the whole way from landed feed files to that table: each
batch of items is matched to the institutions of a stored key index and
merged, and every so many batches the log is folded first.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ingest import merge_news
from ..operators.matching import lowest_ids, match_indexed, mention_index
from ..operators.ranking import top_n_per
from ..schemas import NEWS_ITEMS
from ..session import cut_lineage
from ..sources.feeds import read_feed_stream

KEYS = ["url", "institution_id"]
BUCKETS = 64
#: Tasks that write the buckets, each bucket as one file.
WRITERS = 16
PER_ARTICLE = 3
#: Columns of :func:`mention_index` as they are stored.
INDEX = "id bigint, k string, n_tokens int, head string, lead string"
STATE = f"{NEWS_ITEMS}, seen_at timestamp"


def _bucket():
    return F.pmod(F.xxhash64(*KEYS), F.lit(BUCKETS)).cast("int")


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).option("basePath", folder).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _named(spark: SparkSession, table: str) -> dict[int, int]:
    """The bases that count: upto -> since (one number per base)."""
    rows = _read(spark, f"{table}/bases", "upto bigint, since bigint").distinct().collect()
    return {r.upto: -1 if r.since is None else r.since for r in rows}


def _chain(named: dict[int, int], upto: int) -> list[int]:
    """The base ``upto`` and those before it, newest first."""
    out = []
    while upto in named:
        out.append(upto)
        upto = named[upto]
    return out


def _states(spark: SparkSession, table: str, before: int | None = None) -> DataFrame:
    """All stored states that count, with their batch and bucket."""
    named = _named(spark, table)
    log = _read(spark, f"{table}/log", f"{STATE}, batch bigint, bucket int")
    if before is not None:
        log = log.where(F.col("batch") < before)
    if not named:
        return log
    upto = max(named)
    base = _read(spark, f"{table}/base", f"{STATE}, upto bigint, bucket int").where(F.col("upto").isin(_chain(named, upto)))
    return log.where(F.col("batch") > upto).unionByName(base.withColumnRenamed("upto", "batch"))


def _write(states: DataFrame, path: str) -> None:
    states.repartition(WRITERS, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)


def _newest(states: DataFrame) -> DataFrame:
    return top_n_per(states, KEYS, [F.col("batch").desc()], 1)


def current_news(spark: SparkSession, table: str) -> DataFrame:
    """Newest state of every news row (empty before the first batch)."""
    return _newest(_states(spark, table)).drop("bucket", "seen_at")


def merge_batch(table: str, trade_feed: bool = True):
    """foreachBatch function that folds found rows into the table."""

    def run(found: DataFrame, batch_id: int) -> None:
        spark = found.sparkSession
        touched = found.select(*KEYS).distinct()
        buckets = [r[0] for r in touched.select(_bucket()).distinct().collect()]  # at most BUCKETS numbers
        # pruned to the batch's buckets and keys before states are compared
        mine = _states(spark, table, before=batch_id).where(F.col("bucket").isin(buckets)).join(touched, KEYS, "left_semi")
        # stored: the merge reads it twice, the table once
        known = cut_lineage(_newest(mine).drop("batch", "bucket"), "known")
        held = known.select(*KEYS, F.col("seen_at").alias("__held"))
        newer = found.join(held, KEYS, "left").where(F.col("__held").isNull() | (F.col("seen_at") >= F.col("__held")))
        # the order of sights is a fact of the rows, not of tasks: a retry folds them alike
        place = F.struct("seen_at", F.xxhash64(*[c for c in found.columns if c != "seen_at"]))
        ordered = newer.drop("__held").withColumn("row_no", place)
        merged = merge_news(known.drop("seen_at"), ordered.drop("seen_at"), trade_feed)
        last = newer.groupBy(*KEYS).agg(F.max("seen_at").alias("seen_at"))
        # keys whose sights are all older than the stored state keep that state
        out = merged.join(last, KEYS).withColumn("bucket", _bucket())
        _write(out, f"{table}/log/batch={batch_id}")

    return run


def compact(spark: SparkSession, table: str, before: int | None = None, clean: bool = False) -> None:
    """Fold the stored batches (those below ``before``) into a base. Run it between batches, not beside one.

    Bases before it that cover no more batches are folded in as well. A base
    that is named is never written again. With ``clean`` the log and the bases
    that the last base but one had already replaced are deleted; who still
    reads from that one finds its files.
    """
    named = _named(spark, table)
    last = max(named, default=-1)
    states = _states(spark, table, before)
    upto = states.where(F.col("batch") > last).agg(F.max("batch")).first()[0]
    if upto is not None:
        since = last
        while since in named and since - named[since] <= upto - since:
            since = named[since]
        _write(_newest(states.where(F.col("batch") > since)).drop("batch"), f"{table}/base/upto={upto}")
        row = spark.range(1).select(F.lit(upto).cast("bigint").alias("upto"), F.lit(since).cast("bigint").alias("since"))
        row.write.mode("append").parquet(f"{table}/bases")
        named[upto] = since
    if clean and len(named) > 1:
        replaced, newest = sorted(named)[-2:]
        kept = {*_chain(named, newest), *_chain(named, replaced)}
        _delete(spark, f"{table}/log", "batch", lambda n: n <= replaced)
        _delete(spark, f"{table}/base", "upto", lambda n: n < replaced and n not in kept)


def _delete(spark: SparkSession, folder: str, key: str, gone: Callable[[int], bool]) -> None:
    """Delete the folders ``key=<n>`` of the numbers that are ``gone``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(path) if files.exists(path) else []:
        number = re.fullmatch(rf"{key}=([0-9]+)", status.getPath().getName())
        if number and gone(int(number[1])):
            files.delete(status.getPath(), True)


def stream_merge_news(found: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Start the merge on a streaming frame of matched news rows.

    ``found`` carries url, institution_id, source, title, excerpt,
    published_at, relevance, content_hash and the event time ``seen_at``. The
    merge is idempotent, so no state is kept to drop repeats.
    """
    return (
        found.writeStream.foreachBatch(merge_batch(table))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def store_mention_index(dimension: DataFrame, path: str) -> None:
    """Write the key index that :func:`stream_feeds` matches against; run it anew when the dimension changes.

    Of institutions that share a key only those are stored that an item can be given.
    """
    lowest_ids(mention_index(dimension), PER_ARTICLE).selectExpr(*(f"CAST({c.split()[0]} AS {c.split()[1]})" for c in INDEX.split(", "))).write.mode("overwrite").parquet(path)


def match_items(items: DataFrame, index: DataFrame) -> DataFrame:
    """Feed items -> found news rows: up to three institutions for each item, the lowest ids first.

    Title and summary are read as one text. Equal items of one sight count once.
    """
    facts = ["source", "title", "summary", "link", "published_at", "content_hash", "seen_at"]
    one = items.select(*facts).distinct()
    keyed = one.withColumn("item", F.sha2(F.to_json(F.struct(*facts)), 256))
    keyed = keyed.withColumn("words", F.concat_ws("\n", "title", "summary"))
    hits = match_indexed(keyed, index, "item", "words", PER_ARTICLE)
    return keyed.join(hits, "item").select(
        F.col("link").alias("url"), "institution_id", "source", "title", F.col("summary").alias("excerpt"),
        "published_at", "relevance", "content_hash", "seen_at",
    )


def stream_feeds(
    spark: SparkSession,
    folder: str,
    index: str,
    table: str,
    checkpoint: str,
    kind: str = "rss",
    files_per_batch: int | None = None,
    compact_every: int = 50,
) -> StreamingQuery:
    """Start the way from feed files (:func:`read_feed_stream`) to the table of news.

    Each batch joins its items to the index stored at ``index`` and merges what
    is found. Before every ``compact_every``-th batch the batches below it are
    folded into a base and log files that no base needs are deleted; a batch
    that is run again finds that base and folds nothing. A batch in which no
    item names an institution writes no state.
    """
    merge = merge_batch(table)

    def run(items: DataFrame, batch_id: int) -> None:
        session = items.sparkSession
        if batch_id and batch_id % compact_every == 0:
            compact(session, table, before=batch_id, clean=True)
        found = cut_lineage(match_items(items, session.read.schema(INDEX).parquet(index)), "found")
        merge(found, batch_id)

    return (
        read_feed_stream(spark, folder, kind, files_per_batch)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
