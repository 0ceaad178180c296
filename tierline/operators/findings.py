"""Phrase findings: matches, sentence quotes, guards, curricula."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeeze
from ..functions.walk import Walk
from ..sources.phrases import Phrase
from .upsert import wide_id

QUOTE_RADIUS = 200
MATCH_WEIGHT = 1.0
#: Sections that a worker holds at a time.
ROWS = 256
_ENDS = re.compile("[.!?]")
FACTS = {"phrase_id": "string", "phrase_pattern": "string", "base_severity": "int", "curricula": "array<string>", "guards": "array<string>"}


def quote_spans(text: str, walk: Walk) -> Iterator[tuple[int, int, int]]:
    """(phrase, from, to): the quotes of all phrases in one text.

    A quote is a hit with 200 characters on both sides, grown outward to the
    next of . ! ? or the text's end; offsets are code points. Hits of one
    phrase that grow to one span count once.
    """
    ends, seen = None, set()
    for i, at, end in walk.all(text):
        if ends is None:
            ends = [m.start() for m in _ENDS.finditer(text)]
        before = bisect_left(ends, max(0, at - QUOTE_RADIUS))
        after = bisect_left(ends, min(len(text), end + QUOTE_RADIUS))
        start = ends[before - 1] + 1 if before else 0
        stop = ends[after] + 1 if after < len(ends) else len(text)
        if (i, start, stop) not in seen:
            seen.add((i, start, stop))
            yield i, start, stop


def _facts(phrases: Sequence[Phrase]) -> pa.Table:
    texts = pa.list_(pa.string())
    return pa.table(
        {
            "phrase_id": pa.array([p.id for p in phrases], pa.string()),
            "phrase_pattern": pa.array([p.pattern for p in phrases], pa.string()),
            "base_severity": pa.array([p.severity for p in phrases], pa.int32()),
            "curricula": pa.array([list(p.curricula) for p in phrases], texts),
            "guards": pa.array([list(p.guards) for p in phrases], texts),
        }
    )


def extract_findings(sections: DataFrame, phrases: Sequence[Phrase], guard: bool = True) -> DataFrame:
    """Sections x phrases -> one row per distinct quote span.

    ``sections`` has inspection_id, institution_id, section_key, section_text,
    multiplier, order_index. Sections of weight 0 are skipped. The library is
    sent once as one automaton, and each section is walked once whatever the
    number of phrases; nothing is joined or shuffled. A null text has no hits.
    """
    kept = ["inspection_id", "institution_id", "section_key", "order_index", "multiplier"]
    weighty = sections.where(F.col("multiplier") != 0.0).select(*kept, "section_text")
    regex = [("(?i)" + p.pattern if p.regex else p.pattern, p.regex) for p in phrases]
    sent = sections.sparkSession.sparkContext.broadcast((Walk(regex), _facts(phrases)))
    types = dict(weighty.dtypes)
    schema = ", ".join(f"{c} {t}" for c, t in [*((c, types[c]) for c in kept), *FACTS.items(), ("quote_start", "int"), ("quote_end", "int"), ("raw", "string")])

    def find(batches):
        walk, facts = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                texts = batch.column("section_text").to_pylist()
                hits = [(row, *hit) for row, text in enumerate(texts) if text for hit in quote_spans(text, walk)]
                if not hits:
                    continue
                rows, numbers, starts, stops = (pa.array(x, pa.int32()) for x in zip(*hits, strict=True))
                raw = pa.array([texts[row][start:stop] for row, _, start, stop in hits], pa.string())
                owned = [batch.column(c).take(rows) for c in kept]
                own = facts.take(numbers).combine_chunks()
                columns = [*owned, *(own.column(c).combine_chunks() for c in FACTS), starts, stops, raw]
                yield pa.RecordBatch.from_arrays(columns, [*kept, *FACTS, "quote_start", "quote_end", "raw"])

    out = (
        weighty.mapInArrow(find, schema)
        .withColumn("source_quote", squeeze(F.col("raw")))
        .withColumn("final_severity", F.col("base_severity") * F.col("multiplier"))
        .withColumn(
            "id", wide_id("finding", "inspection_id", "order_index", "phrase_id", "quote_start", "quote_end")
        )
        .drop("raw")
    )
    return apply_guards(out) if guard else out


def apply_guards(findings: DataFrame) -> DataFrame:
    """``suppressed`` and its reason: the first guard (list order) in the quote."""
    low = F.lower("source_quote")
    hit = F.get(F.filter("guards", lambda g: low.contains(F.lower(g))), F.lit(0))
    # The reason carries the words as they stand in the quote.
    return findings.withColumn("__hit", hit).select(
        *findings.columns,
        F.col("__hit").isNotNull().alias("suppressed"),
        F.when(
            F.col("__hit").isNotNull(),
            F.concat(
                F.lit("guard: "),
                F.col("source_quote").substr(F.position(F.lower("__hit"), low), F.length("__hit")),
            ),
        ).alias("suppression_reason"),
    )


def explode_curricula(findings: DataFrame) -> DataFrame:
    """finding x curriculum bridge of the findings that were not suppressed."""
    return findings.where(~F.col("suppressed")).select(
        F.col("id").alias("finding_id"),
        "institution_id",
        F.explode("curricula").alias("curriculum"),
        F.lit(MATCH_WEIGHT).alias("weight"),
    )
