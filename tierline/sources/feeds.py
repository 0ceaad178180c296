"""RSS and Atom feeds through the built-in XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.news import clean_excerpt, content_hash
from ..functions.text import non_blank, strip

RSS_SCHEMA = "title string, description string, `content:encoded` string, link string, pubDate string"
ATOM_SCHEMA = "title string, summary string, link array<struct<_href: string>>, updated string"


def _text(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit("")))


def rss_date(col: Column) -> Column:
    """RFC 822 date -> ISO day in UTC (weekday names are dropped first)."""
    bare = F.regexp_replace(strip(col), r"^[A-Za-z]+,\s*", "")
    bare = F.regexp_replace(bare, r"\s+(?:GMT|UTC|UT|Z)\z", " +0000")
    at = F.coalesce(
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")),
        F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm Z")),
        bare.try_cast("timestamp"),
    )
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd")


def _items(df: DataFrame, *keep: str) -> DataFrame:
    return df.where((F.col("title") != "") & (F.col("link") != "")).select(
        *keep, "title", "summary", "link", "published_at", content_hash(F.col("link"), F.col("title")).alias("content_hash")
    )


def shape_rss(raw: DataFrame, *keep: str) -> DataFrame:
    body = F.coalesce(non_blank(_text("description")), _text("content:encoded"))
    shaped = raw.select(
        *keep,
        _text("title").alias("title"),
        clean_excerpt(body).alias("summary"),
        _text("link").alias("link"),
        rss_date(non_blank(_text("pubDate"))).alias("published_at"),
    )
    return _items(shaped, *keep)


def shape_atom(raw: DataFrame, *keep: str) -> DataFrame:
    shaped = raw.select(
        *keep,
        _text("title").alias("title"),
        clean_excerpt(_text("summary")).alias("summary"),
        F.coalesce(F.get("link", F.lit(0))["_href"], F.lit("")).alias("link"),
        F.substring(non_blank(_text("updated")), 1, 10).alias("published_at"),
    )
    return _items(shaped, *keep)


def read_rss(spark: SparkSession, path) -> DataFrame:
    """Feed items: title, summary, link, published_at, content_hash."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(RSS_SCHEMA).load(path)
    return shape_rss(raw)


def read_atom(spark: SparkSession, path) -> DataFrame:
    raw = spark.read.format("xml").option("rowTag", "entry").schema(ATOM_SCHEMA).load(path)
    return shape_atom(raw)


def read_feed_stream(spark: SparkSession, folder: str, kind: str = "rss", files_per_batch: int | None = None) -> DataFrame:
    """Feed files as they land under ``folder/source=<name>/``: items with ``source`` and ``seen_at``.

    ``kind`` is rss or atom. An item counts as seen when its file was written;
    a file is read once, so a feed fetched again lands as a new file.
    """
    tag, schema, shape = {"rss": ("item", RSS_SCHEMA, shape_rss), "atom": ("entry", ATOM_SCHEMA, shape_atom)}[kind]
    reader = spark.readStream.format("xml").option("rowTag", tag).schema(f"{schema}, source string")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    raw = reader.load(folder).withColumn("seen_at", F.col("_metadata.file_modification_time"))
    return shape(raw, "source", "seen_at")
