"""Coverage, quality and distribution reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import bands
from ..functions.news import has_trigger
from ..functions.text import half_up
from ..operators.joins import FLAGS, MIN_NEWS_SIGNAL, with_counts, with_evidence, with_latest
from ..operators.ranking import list_position, top_n_per
from ..schemas import TIERS
from .tables import Tables

EVIDENCE_TYPES = ["itp", "university", "fe_college", "sixth_form_college", "employer"]
WEAK_GRADES = ["requires_improvement", "inadequate"]
SEGMENT_ORDER = [
    "state_school", "independent_school", "sixth_form_college", "fe_college", "itp", "employer", "other",
]


def _has_email() -> Column:
    return F.col("general_email").isNotNull() | F.col("head_email").isNotNull()


def one_row(spark: SparkSession, *aggregates: DataFrame) -> DataFrame:
    """The one-row aggregates side by side (scalar subqueries, no joins): one scan for each."""
    packed = [df.select(F.struct(*df.columns)).scalar().alias(f"__{i}") for i, df in enumerate(aggregates)]
    return spark.range(1).select(*packed).select(*[f"__{i}.*" for i in range(len(aggregates))])


def _count(name: str, cond: Column | None = None) -> Column:
    return (F.count(F.lit(1)) if cond is None else F.count_if(cond)).alias(name)


def segments(t: Tables) -> DataFrame:
    """Per type: institutions in scope, scored, scored at least 60, coverage %.

    Both keys are unique, so the distinct counts are plain counts.
    """
    scored = t.scores.select(F.col("institution_id").alias("id"), "score")
    df = t.institutions.where(F.col("in_scope")).select("id", "type").join(scored, "id", "left")
    return df.groupBy("type").agg(
        F.count(F.lit(1)).alias("institutions"),
        F.count("score").alias("scored"),
        F.count_if(F.col("score") >= 60).alias("high"),
        half_up(F.count("score") / F.count(F.lit(1)) * 100).alias("coverage_pct"),
    )


def kpis(t: Tables) -> DataFrame:
    inst, scores = t.institutions, t.scores
    scope = F.col("in_scope")
    return one_row(
        inst.sparkSession,
        inst.agg(_count("in_scope", scope), _count("with_email", scope & _has_email())),
        t.inspections.agg(_count("inspections")),
        t.findings.agg(_count("findings", ~F.col("suppressed"))),
        scores.agg(
            _count("scored"),
            _count("score_60", F.col("score") >= 60),
            _count("score_80", F.col("score") >= 80),
            _count("critical", F.col("tier") == "critical"),
        ),
    ).select("in_scope", "inspections", "findings", "scored", "score_60", "score_80", "critical", "with_email")


def coverage_summary(t: Tables) -> DataFrame:
    """News and notice coverage in one row."""
    inst, news, notices = t.institutions, t.news, t.notices
    # Facts are folded per institution first, so distinct ones are plain counts.
    by_news = news.groupBy("institution_id").agg(
        _count("n"),
        _count("extracted", F.col("angle").isNotNull()),
        _count("high", F.col("trigger_severity") >= 70),
        _count("signals", F.col("trigger_severity") >= MIN_NEWS_SIGNAL),
    )
    by_notice = notices.groupBy("institution_id").agg(_count("n", F.col("withdrawn_at").isNull()))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    known = F.col("institution_id").isNotNull()
    return one_row(
        inst.sparkSession,
        inst.agg(_count("total_itps", (F.col("type") == "itp") & F.col("in_scope"))),
        by_news.agg(
            total("n").alias("news_items_total"),
            total("extracted").alias("news_items_extracted"),
            total("high").alias("news_items_high_signal"),
            _count("institutions_with_news_signal", known & (F.col("signals") > 0)),
        ),
        by_notice.agg(
            total("n").alias("compliance_active"), _count("institutions_with_compliance", known & (F.col("n") > 0))
        ),
    )


def universe_summary(t: Tables) -> DataFrame:
    """In-scope institutions per provider type, one row."""
    scope = t.institutions.where(F.col("in_scope"))
    return scope.agg(
        F.count_if(F.col("type") == "itp").alias("itps"),
        F.count_if(F.col("type") == "university").alias("universities"),
        F.count_if(F.col("type") == "fe_college").alias("fe_colleges"),
        F.count_if(F.col("type") == "sixth_form_college").alias("sixth_form_colleges"),
        F.count_if(F.col("type") == "employer").alias("employers"),
    )


def tier_counts(df: DataFrame) -> DataFrame:
    """Rows per tier with zero fill; ``df`` has a ``tier`` column."""
    counted = df.where(F.col("tier").isin(*TIERS)).groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    tiers = df.sparkSession.createDataFrame([(x,) for x in TIERS], "tier string")
    return tiers.join(counted, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))


def distinct_flagged(t: Tables, type_: str, since: str) -> DataFrame:
    """Distinct institutions of a type with a notice, a weak recent grade, news."""
    of_type = t.institutions.where(F.col("type") == type_).select(F.col("id").alias("institution_id"))

    def distinct(name: str, df: DataFrame) -> DataFrame:
        ids = df.select("institution_id").distinct()
        return ids.join(of_type, "institution_id").agg(_count(name))

    recent = (F.col("publication_date") >= since) & F.col("overall_grade").isin(*WEAK_GRADES)
    trigger = (F.col("trigger_severity") >= 70) & (F.col("relevance") >= 60)
    return one_row(
        t.institutions.sparkSession,
        distinct("active_compliance", t.notices.where(F.col("withdrawn_at").isNull())),
        distinct("recent_weak", t.inspections.where(recent)),
        distinct("active_news_trigger", t.news.where(trigger)),
    )


def evidence_coverage(t: Tables) -> DataFrame:
    """Per provider type, how many institutions have each kind of evidence."""
    scope = t.institutions.where(F.col("in_scope") & F.col("type").isin(*EVIDENCE_TYPES)).select("id", "type")
    flagged = with_evidence(scope, *t.evidence())
    return flagged.groupBy("type").agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.col(f)).alias(f) for f in [*FLAGS, "actionable"]]
    )


def band_distribution(df: DataFrame, band: Column, measure: str, label: str = "band") -> DataFrame:
    """Rows per band with the least value in it, smallest first."""
    return (
        df.select(band.alias(label), measure)
        .groupBy(label)
        .agg(F.count(F.lit(1)).alias("n"), F.min(measure).alias("lowest"))
        .orderBy("lowest")
    )


def size_distribution(t: Tables) -> DataFrame:
    scope = t.institutions.where((F.col("type") == "itp") & F.col("in_scope"))
    size = F.coalesce("apprenticeship_standards", F.lit(0))
    return band_distribution(
        scope.withColumn("standards", size), bands.band(F.col("standards"), bands.SIZE_BANDS, bands.UNKNOWN_SIZE), "standards"
    )


def skip_sizes(t: Tables) -> DataFrame:
    """Sizes inside the skip tier of training providers."""
    df = t.scored().where((F.col("type") == "itp") & F.col("in_scope") & (F.col("tier") == "skip"))
    df = df.withColumn("standards", F.coalesce("apprenticeship_standards", F.lit(0)))
    label = bands.band(F.col("standards"), bands.SKIP_SIZE_BANDS, bands.SKIP_UNKNOWN_SIZE)
    return band_distribution(df, label, "standards", "size_band")


def trigger_distribution(t: Tables) -> DataFrame:
    rated = t.news.where(F.col("angle").isNotNull())
    return band_distribution(rated, bands.band(F.col("trigger_severity"), bands.TRIGGER_BANDS), "trigger_severity")


def critical_reasons(t: Tables) -> DataFrame:
    df = t.scored().where((F.col("type") == "itp") & F.col("in_scope") & (F.col("tier") == "critical"))
    reason = bands.critical_reason(F.col("urgency_score"), F.col("pipeline_value_score"))
    return df.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("itps"))


def score_histogram(t: Tables, width: int = 5) -> DataFrame:
    df = t.scored().where((F.col("type") == "itp") & F.col("in_scope"))
    return df.groupBy(bands.bucket(F.col("score"), width).alias("score_band")).agg(F.count(F.lit(1)).alias("itps"))


def score_by_grade(t: Tables, type_: str = "itp") -> DataFrame:
    """Headline score statistics by latest grade."""
    df = t.scored().where((F.col("type") == type_) & F.col("in_scope")).select("id", "score")
    graded = with_latest(df, t.inspections)
    return graded.groupBy(F.coalesce("latest_grade", F.lit("no_inspection")).alias("grade")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("score"), 0).alias("avg_score"),
        F.max("score").alias("max_score"),
        F.min("score").alias("min_score"),
    )


def tier_distribution(t: Tables, type_: str = "itp") -> DataFrame:
    """Tiers of a type (unscored shown) with average scores."""
    df = t.scored("left").where((F.col("type") == type_) & F.col("in_scope"))
    return df.groupBy(F.coalesce("tier", F.lit("unscored")).alias("tier")).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("score"), 1).alias("avg_score"),
        F.round(F.avg("urgency_score"), 1).alias("avg_urgency"),
        F.round(F.avg("pipeline_value_score"), 1).alias("avg_pipeline"),
    )


def grade_distribution(t: Tables, type_: str = "itp") -> DataFrame:
    df = with_latest(t.institutions.where((F.col("type") == type_) & F.col("in_scope")).select("id"), t.inspections)
    return df.groupBy(F.coalesce("latest_grade", F.lit("no_inspection")).alias("latest_grade")).agg(
        F.count(F.lit(1)).alias("n")
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("dups")).where(F.col("dups") > 1)


def duplicate_summary(news: DataFrame) -> DataFrame:
    """Total rows against distinct (url, institution) and (title, institution)."""
    # Counted per distinct pair, so an institution with very much news is no hot group.
    by_url = news.groupBy("url", "institution_id").agg(_count("n"))
    by_title = news.groupBy("title", "institution_id").agg(_count("n"))
    return one_row(
        news.sparkSession,
        by_url.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"), _count("distinct_url_inst")),
        by_title.agg(_count("distinct_title_inst")),
    )


def uncovered(t: Tables, type_: str) -> DataFrame:
    """In-scope institutions of a type without a single news item."""
    parents = t.institutions.where((F.col("type") == type_) & F.col("in_scope"))
    have = t.news.select(F.col("institution_id").alias("id")).distinct()
    return parents.join(have, "id", "left_anti").select("id", "name", "apprenticeship_standards")


def total_standards(t: Tables, type_: str) -> DataFrame:
    scope = t.institutions.where((F.col("type") == type_) & F.col("in_scope"))
    return scope.agg(F.sum("apprenticeship_standards").alias("total_standards"))


def status_counts(register: DataFrame) -> DataFrame:
    """Register rows by type and status, with the total of each status."""
    cells = register.groupBy(
        F.coalesce(F.trim("application_type"), F.lit("")).alias("application_type"),
        F.coalesce(F.trim("status"), F.lit("")).alias("status"),
    ).agg(F.count(F.lit(1)).alias("n"))
    totals = cells.groupBy("status").agg(F.sum("n").alias("status_total"))
    return cells.join(totals, "status")


def status_samples(register: DataFrame, n: int) -> DataFrame:
    """The first rows of every status, in file order."""
    keyed = register.withColumn("status", F.coalesce(F.trim("status"), F.lit("")))
    return top_n_per(keyed, ["status"], [F.col("row_no").asc()], n)


def notice_profile(notices: DataFrame) -> DataFrame:
    return notices.groupBy("notice_body", "notice_type").agg(
        F.count(F.lit(1)).alias("notices"),
        F.round(F.avg("severity"), 0).alias("avg_severity"),
        F.count_if(F.col("withdrawn_at").isNull()).alias("active"),
    )


def news_profile(news: DataFrame) -> DataFrame:
    return news.groupBy("source").agg(
        F.count(F.lit(1)).alias("items"),
        F.round(F.avg("relevance"), 0).alias("avg_relevance"),
        F.count_if(F.col("trigger_severity") >= 70).alias("high_severity"),
    )


def news_by_type(t: Tables) -> DataFrame:
    """Institutions with news and items per type (items counted before the join)."""
    per = t.news.groupBy(F.col("institution_id").alias("id")).agg(F.count(F.lit(1)).alias("items"))
    return (
        per.join(t.institutions.select("id", "type"), "id")
        .groupBy("type")
        .agg(F.count(F.lit(1)).alias("institutions_with_news"), F.sum("items").alias("news_items"))
    )


def completeness(t: Tables, type_: str = "itp") -> DataFrame:
    """Filled contact fields of a type."""
    df = t.institutions.where(F.col("type") == type_)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("in_scope")).alias("in_scope"),
        F.count("ukprn").alias("with_ukprn"),
        F.count("website").alias("with_website"),
        F.count("general_email").alias("with_general_email"),
        F.count("head_email").alias("with_head_email"),
        F.count_if(F.col("apprenticeship_standards") > 0).alias("with_standards"),
    )


def report_coverage(t: Tables, type_: str = "itp") -> DataFrame:
    """Inspections of a type with link and text (counted before the join)."""
    per = t.inspections.groupBy(F.col("institution_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.count("report_text").alias("texts"), F.count("report_url").alias("urls")
    )
    df = per.join(t.institutions.where(F.col("type") == type_).select("id"), "id")
    return df.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_inspections"),
        F.coalesce(F.sum("texts"), F.lit(0)).alias("with_report_text"),
        F.coalesce(F.sum("urls"), F.lit(0)).alias("with_report_url"),
    )


def extract_progress(news: DataFrame) -> DataFrame:
    return news.agg(
        F.count("angle").alias("extracted"),
        F.count_if(F.col("angle").isNull()).alias("pending"),
        F.count(F.lit(1)).alias("total"),
    )


def withdrawn_progress(notices: DataFrame, body: str) -> DataFrame:
    return notices.where(F.col("notice_body") == body).agg(
        F.count_if(F.col("withdrawn_at").isNull()).alias("active"),
        F.count("withdrawn_at").alias("withdrawn"),
        F.count(F.lit(1)).alias("total"),
    )


def type_counts(t: Tables) -> DataFrame:
    return t.institutions.groupBy("type").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("in_scope")).alias("in_scope")
    )


def evaluate_gate(news: DataFrame) -> DataFrame:
    """What the keyword gate would skip and keep, and high-severity rows lost."""
    hit, high = has_trigger(F.col("title"), F.col("excerpt")), F.col("trigger_severity") >= 70
    return news.select(hit.alias("hit"), high.alias("high")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("hit")).alias("would_extract"),
        F.count_if(~F.col("hit")).alias("would_skip"),
        F.count_if(F.col("hit") & F.col("high")).alias("kept_high"),
        F.count_if(~F.col("hit") & F.col("high")).alias("lost_high"),
    )


def gate_losses(news: DataFrame) -> DataFrame:
    """High-severity rows the gate would lose."""
    lost = (F.col("trigger_severity") >= 70) & ~has_trigger(F.col("title"), F.col("excerpt"))
    return news.where(lost).select("id", "title", "trigger_severity", "angle")


def news_counts(t: Tables, type_: str, n: int | None = None) -> DataFrame:
    """News and signal items per institution of a type, most signals first."""
    per = t.news.groupBy(F.col("institution_id").alias("id")).agg(
        F.count(F.lit(1)).alias("news_count"), F.count_if(F.col("trigger_severity") >= 50).alias("signal_count")
    )
    scope = t.institutions.where((F.col("type") == type_) & F.col("in_scope")).select("id", "name")
    df = scope.join(per, "id", "left").fillna(0, ["news_count", "signal_count"])
    df = df.orderBy(F.col("signal_count").desc(), F.col("news_count").desc(), "id")
    return df if n is None else df.limit(n)


def cohort_counts(t: Tables) -> DataFrame:
    """Institutions the news job would look at, by type and tier."""
    keep = F.col("tier").isin("critical", "high") | ((F.col("tier") == "worth_a_look") & (F.col("type") == "itp"))
    df = t.scored().where(F.col("in_scope") & keep)
    return df.groupBy("type", "tier").agg(F.count(F.lit(1)).alias("n"))


def landscape(t: Tables, since: str, type_: str = "itp") -> DataFrame:
    """Inspections of a type: recent, weak, dropped, unsafe (counted before the join)."""
    per = t.inspections.groupBy(F.col("institution_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("publication_date") >= since).alias("recent"),
        F.count_if(F.col("overall_grade").isin(*WEAK_GRADES)).alias("weak"),
        F.count_if(F.col("grade_dropped")).alias("dropped"),
        F.count_if(~F.col("safeguarding_effective")).alias("unsafe"),
    )
    df = per.join(t.institutions.where(F.col("type") == type_).select("id"), "id")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return df.agg(
        total("n").alias("inspections"),
        total("recent").alias("last_12m"),
        total("weak").alias("ri_or_inadequate"),
        total("dropped").alias("grade_dropped"),
        total("unsafe").alias("safeguarding_not_met"),
    )


def news_coverage(t: Tables) -> DataFrame:
    """Institutions per type with and without news (left join to counted children)."""
    df = with_counts(t.institutions.where(F.col("in_scope")).select("id", "type"), t.news, "institution_id", "news_count")
    return df.groupBy("type").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("news_count") > 0).alias("with_news"),
        F.count_if(F.col("news_count").isNull()).alias("no_news_yet"),
    )


def segment_position(type_: Column) -> Column:
    """Display position of a segment."""
    return list_position(type_, SEGMENT_ORDER)
