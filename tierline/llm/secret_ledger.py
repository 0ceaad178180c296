"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is addressed by the SHA-256 of its text. The ledger holds, for each blob, which rule
versions have looked at it and what they found. A scan sends only those (blob, rule version) pairs to the rules that
the ledger does not know, appends the outcome, and joins findings back to all paths and versions that hold the blob.

Matches are found from left to right without overlap. Their places come from the lengths of the text between them:
``split`` gives the gaps, ``regexp_extract_all`` the matches, and a running sum over both gives offsets in code points.

Defined results: a null text is the empty blob; equal texts are one blob, scanned once; rows without a path are joined
like any other; an empty table scans nothing. A text without a match has no rows in ``findings``.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from .common import scratch_dir


class Rule(NamedTuple):
    """``group`` of each match must have ``least`` characters, else the match is dropped (its text stays consumed)."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 0

    @property
    def key(self) -> str:
        return f"{self.kind}:{self.version}"


#: Fixed patterns. The least lengths of access and hex stand in the pattern: a run that is too short holds no longer one.
RULES = (
    Rule(
        "assign",
        1,
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    ),
    Rule("access", 1, r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", 1, r"[0-9a-f]{32,}"),
)
HIT = "array<struct<rule:string,place:int,gap:int,length:int,checked:int>>"


def blob(text: str) -> Column:
    """The address of a version: SHA-256 of its text in UTF-8, as 32 bytes."""
    return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")).cast("binary"), 256))


def _hits(rule: Rule) -> Column:
    """Relative places of one rule's matches in ``text``; an empty array where the rule does not match or is not due."""
    pattern = F.lit(rule.pattern)
    zipped = F.arrays_zip(
        F.split("text", rule.pattern, -1).alias("gap"),
        F.regexp_extract_all("text", pattern, 0).alias("hit"),
        F.regexp_extract_all("text", pattern, rule.group).alias("checked"),
    )
    found = F.transform(
        zipped,
        lambda x, i: F.struct(
            F.lit(rule.key).alias("rule"),
            i.alias("place"),
            F.length(x["gap"]).alias("gap"),
            F.length(x["hit"]).alias("length"),
            F.length(x["checked"]).alias("checked"),
        ),
    )
    due = F.array_contains("due", rule.key) & F.col("text").rlike(rule.pattern)
    return F.when(due, F.filter(found, lambda x: x["length"].isNotNull()).cast(HIT)).otherwise(F.array().cast(HIT))


def read_ledger(spark: SparkSession, ledger: str) -> DataFrame | None:
    """(blob, rules, hits) rows, or None while there is no ledger at this place."""
    try:
        return spark.read.parquet(ledger)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Bring the ledger up to date with all texts of ``versions`` (text).

    Copies meet as one row in each task before the exchange, so a text that very many paths share is no hot group.
    """
    spark = versions.sparkSession
    blobs = versions.select(blob("text").alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
    blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"))
    wanted = F.array(*(F.lit(r.key) for r in rules))
    known = read_ledger(spark, ledger)
    if known is None:
        due = blobs.withColumn("due", wanted)
    else:
        seen = known.select("blob", F.explode("rules").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("seen"))
        due = (
            blobs.join(seen, "blob", "left")
            .withColumn("due", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>"))))
            .where("size(due) > 0")
        )
    due.select("blob", F.col("due").alias("rules"), F.concat(*map(_hits, rules)).alias("hits")).write.mode("append").parquet(ledger)


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(blob, kind, kind_no, start, end) of these rule versions, one row for each match that counts."""
    kind = F.create_map(*(x for r in rules for x in (F.lit(r.key), F.lit(r.kind))))
    number = F.create_map(*(x for i, r in enumerate(rules) for x in (F.lit(r.key), F.lit(i))))
    least = F.create_map(*(x for r in rules for x in (F.lit(r.key), F.lit(r.least))))
    hits = read_ledger(spark, ledger).select("blob", F.inline("hits")).where(F.col("rule").isin([r.key for r in rules]))
    end = F.expr(
        "sum(gap + length) OVER (PARTITION BY blob, rule ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    return (
        hits.dropDuplicates(["blob", "rule", "place"])
        .withColumn("end", end.cast("long"))
        .where(F.col("checked") >= least[F.col("rule")])
        .select(
            "blob",
            kind[F.col("rule")].alias("kind"),
            number[F.col("rule")].alias("kind_no"),
            (F.col("end") - F.col("length")).alias("start"),
            "end",
        )
    )


def by_blob(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row for each blob with findings: ``spans`` in order of start, then kind; ``n_<kind>``."""
    counts = [F.count_if(F.col("kind") == r.kind).alias(f"n_{r.kind}") for r in rules]
    spans = F.array_sort(F.collect_list(F.struct("start", "kind_no", "kind", "end")))
    return found.groupBy("blob").agg(spans.alias("spans"), *counts)


def span_text(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan_paths(docs: DataFrame, path: str = "doc_id", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(path, n_<kind>..., spans) for every row of ``docs`` (path, text), through the ledger."""
    ledger = ledger or scratch_dir(docs.sparkSession, "secret-ledger")
    scan(docs, ledger, rules)
    found = by_blob(findings(docs.sparkSession, ledger, rules), rules)
    paths = docs.select(F.col(path), blob("text").alias("blob"))
    joined = paths.join(found, "blob", "left")
    counts = [F.coalesce(f"n_{r.kind}", F.lit(0)).cast("long").alias(f"n_{r.kind}") for r in rules]
    return joined.select(path, *counts, F.coalesce(span_text("spans"), F.lit("")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[secret]", ledger: str | None = None, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with every finding's span replaced by ``mask``; touching and overlapping spans become one mask.

    ``n_chars``, if there, follows the new text. Texts without findings stay as they are.
    """
    ledger = ledger or scratch_dir(docs.sparkSession, "secret-ledger")
    scan(docs, ledger, rules)
    before = "max(end) OVER (PARTITION BY blob ORDER BY start, end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    island = "sum(opens) OVER (PARTITION BY blob ORDER BY start, end ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    merged = (
        findings(docs.sparkSession, ledger, rules)
        .withColumn("opens", F.when(F.col("start") <= F.expr(before), 0).otherwise(1))
        .withColumn("island", F.expr(island))
        .groupBy("blob", "island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .groupBy("blob")
        .agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("cut"))
        .select(F.col("blob").alias("__blob"), F.col("cut").alias("__cut"))
    )
    starts = F.transform("__cut", lambda c: c["start"])
    gaps = F.arrays_zip(
        F.concat(F.array(F.lit(0).cast("long")), F.transform("__cut", lambda c: c["end"])).alias("a"),
        F.concat(starts, F.array(F.length("text").cast("long"))).alias("b"),
    )
    kept = F.transform(gaps, lambda g: F.substring(F.col("text"), (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int")))
    text = F.when(F.col("__cut").isNull(), F.col("text")).otherwise(F.array_join(kept, mask))
    out = docs.withColumn("__blob", blob("text")).join(merged, "__blob", "left").withColumn("text", text)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__cut").isNull(), F.col("n_chars")).otherwise(F.length("text")))
    return out.select(*docs.columns)
