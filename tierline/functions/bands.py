"""Bands and buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: (lower bound, label), highest first ---------------------
SCORE_BANDS = [(90, "Critical"), (70, "High"), (50, "Worth a look"), (float("-inf"), "Skip")]
SEVERITY_BANDS = [(90, "severe"), (70, "strong"), (50, "moderate"), (float("-inf"), "minor")]
SIZE_BANDS = [(50, "50+ (very large)"), (15, "15-49 (large)"), (5, "5-14 (medium)"), (1, "1-4 (niche)")]
UNKNOWN_SIZE = "0 (unknown)"
SKIP_SIZE_BANDS = [(10, "large skip"), (3, "medium skip"), (1, "niche skip")]
SKIP_UNKNOWN_SIZE = "tiny / unknown"
TRIGGER_BANDS = [
    (90, "90+ (immediate trigger)"),
    (70, "70-89 (warm trigger)"),
    (40, "40-69 (mild trigger)"),
    (float("-inf"), "<40 (no trigger)"),
]
# ---------------------------------------------------------------------------


def band(col: Column, cuts: Sequence[tuple[float, str]], otherwise: str | None = None) -> Column:
    """Label of the first cut whose lower bound is reached."""
    out: Column | None = None
    for low, label in cuts:
        cond = col.isNotNull() if low == float("-inf") else col >= F.lit(low)
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out if otherwise is None else out.otherwise(otherwise)


def score_band(col: Column) -> Column:
    return band(col, SCORE_BANDS, "No signal")


def bucket(col: Column, width: int) -> Column:
    """Histogram bucket: the value cut (towards zero) to a multiple of width."""
    return (F.floor(F.abs(col) / F.lit(width)) * width * F.signum(col)).cast("bigint")


def critical_reason(urgency: Column, pipeline: Column) -> Column:
    """Why a provider sits in the critical tier."""
    return (
        F.when(urgency >= 90, "urgency 90+ (Inadequate / safeguarding fail / 2+ critical signals)")
        .when(urgency >= 70, "urgency 70-89 (RI signals)")
        .when(urgency.between(50, 69), "urgency 50-69 (weaker signal)")
        .when(pipeline >= 90, "pipeline 90+ (no inspection urgency, big provider)")
        .when(pipeline.between(70, 89), "pipeline 70-89")
        .otherwise("other")
    )
