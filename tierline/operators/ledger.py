"""Incremental extraction: a ledger says which texts were read under which rules, so only the rest is read.

A text is known by its SHA-256, a rule set by a version: for sections a digest of the markers, for findings that and the
phrase library's digest. ``done`` holds (kind, rules, text, run); ``results/kind=/rules=/run=`` what a run found. A run
writes its results first and then enters its texts, so what a broken run left behind is never read, and of two runs
that read one text the first by name counts.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.phrases import Library
from .findings import extract_findings
from .sections import END_MARKERS, MIN_BODY, MIN_PROVISION_BODY, MIN_SUMMARY_PREFIX, MIN_TEXT, SECTION_MARKERS, sectionise
from .upsert import wide_id

DONE = "kind string, rules string, text_hash string, run string"


def section_rules() -> str:
    """Version of the rules that cut a text into sections."""
    rules = (SECTION_MARKERS, END_MARKERS, MIN_TEXT, MIN_SUMMARY_PREFIX, MIN_BODY, MIN_PROVISION_BODY)
    return hashlib.sha256(repr(rules).encode()).hexdigest()


@dataclass(frozen=True)
class Ledger:
    spark: SparkSession
    folder: str

    def _read(self, path: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def done(self, kind: str, rules: str) -> DataFrame:
        """(text_hash, run) of the texts that were read under these rules, each once."""
        rows = self._read(f"{self.folder}/done", DONE).where((F.col("kind") == kind) & (F.col("rules") == rules))
        return rows.groupBy("text_hash").agg(F.min("run").alias("run"))

    def process(self, texts: DataFrame, kind: str, rules: str, extract: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, int]:
        """(results, number of texts read now): ``extract`` sees only rows of texts that are not done.

        ``texts`` has ``text_hash`` and any columns, and may have several rows
        of one text (they are read together); the results keep ``text_hash``.
        All results of the texts asked for are returned, from whichever run.
        """
        asked = texts.select("text_hash").where("text_hash IS NOT NULL").distinct()
        unseen = cut_lineage(asked.join(self.done(kind, rules), "text_hash", "left_anti"), "ledger-unseen")
        count = unseen.count()
        path = f"{self.folder}/results/kind={kind}/rules={rules}"
        found = extract(texts.join(unseen, "text_hash", "left_semi"))
        schema = ", ".join(f"{c} {t}" for c, t in found.dtypes)
        if count:
            run = uuid.uuid4().hex
            found.write.parquet(f"{path}/run={run}")
            entered = unseen.select(F.lit(kind).alias("kind"), F.lit(rules).alias("rules"), "text_hash", F.lit(run).alias("run"))
            entered.write.mode("append").parquet(f"{self.folder}/done")
        own = asked.join(self.done(kind, rules), "text_hash")
        return self._read(path, f"{schema}, run string").join(own, ["text_hash", "run"], "left_semi").drop("run"), count


def extract_incrementally(inspections: DataFrame, library: Library, folder: str) -> tuple[DataFrame, DataFrame, dict[str, int]]:
    """(sections, findings, texts read for each) of inspections (inspection_id, institution_id, report_text).

    Equal texts are read once; a text is cut again only if the markers changed
    and matched again only if the markers or the library did. Inspections with
    no text have no rows.
    """
    ledger = Ledger(inspections.sparkSession, folder)
    owned = cut_lineage(
        inspections.where(F.col("report_text") != "").select(
            "inspection_id", "institution_id", F.sha2(F.col("report_text").cast("binary"), 256).alias("text_hash"), "report_text"
        ),
        "ledger-texts",
    )
    owner = owned.drop("report_text")
    texts = owned.select("text_hash", "report_text").dropDuplicates(["text_hash"])
    cuts, cut_now = ledger.process(texts, "sections", section_rules(), lambda new: sectionise(new, "report_text", keep=("text_hash",)))

    def match(new: DataFrame) -> DataFrame:
        as_sections = new.select(
            F.col("text_hash").alias("inspection_id"), F.lit(None).cast("long").alias("institution_id"), "section_key", "order_index", "multiplier", "section_text"
        )
        return extract_findings(as_sections, library.phrases).drop("institution_id", "id").withColumnRenamed("inspection_id", "text_hash")

    rules = hashlib.sha256(f"{section_rules()} {library.sha256}".encode()).hexdigest()
    hits, matched_now = ledger.process(cuts, "findings", rules, match)
    sections = owner.select("inspection_id", "text_hash").join(cuts, "text_hash").drop("text_hash")
    findings = (
        owner.join(hits, "text_hash")
        .drop("text_hash")
        .withColumn("id", wide_id("finding", "inspection_id", "order_index", "phrase_id", "quote_start", "quote_end"))
    )
    return sections, findings, {"sections": cut_now, "findings": matched_now}
