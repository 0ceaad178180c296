"""Dashboard bundles: a dict of DataFrames, each run on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import with_evidence
from .lists import cohort_ranking, rank_by_tier, signal_feed
from .profiles import _has_email, distinct_flagged, tier_counts
from .tables import Tables

#: Rows and signals that the dashboards show.
SIGNALS_SHOWN, HIGH_SHOWN, OUTSTANDING_SHOWN, MAJOR_SHOWN = 3, 30, 20, 25


def actionable_scored(t: Tables, type_: str, min_standards: int | None = None) -> DataFrame:
    scope = t.scored().where((F.col("type") == type_) & F.col("in_scope"))
    df = with_evidence(scope, *t.evidence())
    keep = F.col("actionable")
    if min_standards is not None:
        keep = keep | F.coalesce(F.col("apprenticeship_standards") >= min_standards, F.lit(False))
    return df.where(keep)


def shorten_signals(df: DataFrame, n: int = SIGNALS_SHOWN) -> DataFrame:
    """The first ``n`` signals, for display; the stored scores keep all of them."""
    return df.withColumn("critical_signals", F.slice("critical_signals", 1, n))


def universe_counts(t: Tables, type_: str) -> DataFrame:
    """Total, actionable, with a mailbox, and the sum of standards of a type."""
    scope = t.institutions.where((F.col("type") == type_) & F.col("in_scope"))
    flagged = with_evidence(scope, *t.evidence())
    return flagged.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("actionable")).alias("actionable"),
        F.count_if(_has_email()).alias("with_email"),
        F.coalesce(F.sum("apprenticeship_standards"), F.lit(0)).alias("total_standards"),
    )


def provider_dashboard(t: Tables, as_of: str) -> dict[str, DataFrame]:
    """Training providers. ``as_of`` fixes the twelve-month window."""
    spark = t.institutions.sparkSession
    since = spark.range(1).select(F.add_months(F.lit(as_of).cast("date"), -12).cast("string")).scalar()
    return {
        "universe": universe_counts(t, "itp"),
        "tiers": tier_counts(actionable_scored(t, "itp")),
        "flagged": distinct_flagged(t, "itp", since),
        "critical": shorten_signals(cohort_ranking(t, "critical")),
        "high": shorten_signals(cohort_ranking(t, "high", HIGH_SHOWN)),
        "outstanding": shorten_signals(cohort_ranking(t, "outstanding", OUTSTANDING_SHOWN)),
        "major": shorten_signals(cohort_ranking(t, "major", MAJOR_SHOWN)),
        "all": shorten_signals(rank_by_tier(t)),
        "notices": signal_feed(t, "itp", "notices", 20),
        "news": signal_feed(t, "itp", "news", 20),
    }


def university_dashboard(t: Tables, as_of: str) -> dict[str, DataFrame]:
    return {
        "universe": universe_counts(t, "university"),
        "tiers": tier_counts(actionable_scored(t, "university", min_standards=5)),
        "flagged": distinct_flagged(t, "university", as_of),
        "all": shorten_signals(cohort_ranking(t, "universities")),
        "notices": signal_feed(t, "university", "notices", 10),
        "news": signal_feed(t, "university", "news", 15),
    }
