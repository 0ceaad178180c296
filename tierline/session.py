"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings the plans are written for. All can be set on a live session.
RECOMMENDED = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # One institution, name or source may own a third of a table: let AQE cut
    # such partitions even where that costs one more exchange downstream.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # What a join sends to all tasks passes through the driver. Sizes guessed
    # from files know neither their compression nor what a generator adds, so
    # only small guesses count; AQE goes by the sizes it has measured.
    "spark.sql.autoBroadcastJoinThreshold": "1m",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m",
    # Aggregates of texts and top-n cuts sort what a map task reads, and its
    # share of a large table must fit the task's memory: 20 MB of a stored
    # table were 370 to 620 MB of rows to sort, the usual 128 MB spilled.
    "spark.sql.files.maxPartitionBytes": "24m",
    "spark.sql.session.timeZone": "UTC",
    # Building a wide plan makes thousands of column calls; do not look up the
    # Python call site of each.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def _bytes(size: str) -> int:
    """Bytes of a size as Spark writes it (``10485760b``, ``256k``, ``-1``)."""
    number, unit = re.fullmatch(r"(-?[0-9]+)\s*([a-z]?)[a-z]*", size.strip().lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit or "b")


def tune(spark: SparkSession) -> SparkSession:
    """Apply ``RECOMMENDED`` to a live session and return it.

    Broadcast limits and the size of splits are only ever lowered: one that the
    session sets lower, or turns off, stays.
    """
    asked = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    measured = spark.conf.get("spark.sql.adaptive.autoBroadcastJoinThreshold", None)
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": asked,
        "spark.sql.adaptive.autoBroadcastJoinThreshold": asked if measured is None else measured,
        "spark.sql.files.maxPartitionBytes": spark.conf.get("spark.sql.files.maxPartitionBytes"),
    }
    for key, value in RECOMMENDED.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, min(limits.get(key, value), value, key=_bytes) if key in limits else value)
    return spark


def local_session(name: str = "tierline", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    for key, value in RECOMMENDED.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder for intermediate tables.

    On a cluster it lies under the shared folder named by
    ``spark.checkpoint.dir``. Only a local session, where driver and executors
    are one process, may fall back to a temporary folder.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        shared = tempfile.mkdtemp(prefix="tierline-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/tierline/{label}-{uuid.uuid4().hex}"


def cut_lineage(df, label: str):
    """Write ``df`` to the scratch folder and read it back.

    Used where a result feeds several consumers: a written table survives the
    loss of executors, unlike cached blocks, and is computed once.
    """
    path = scratch_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
