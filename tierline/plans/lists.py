"""Ranked lists, queues, feeds and the wide export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grades import grade_label
from ..operators.joins import with_evidence, with_latest, with_reference_inspection, with_top_finding
from ..operators.pages import RankedTable
from ..operators.ranking import list_position, page
from ..schemas import TIERS
from .tables import Tables

PAGE_SIZE = 30
PROVIDER_TYPES = ["itp", "university", "fe_college", "sixth_form_college", "employer"]
COHORT_COLUMNS = [
    "id", "name", "ukprn", "postcode", "general_email", "apprenticeship_standards", "tier", "score",
    "urgency_score", "pipeline_value_score", "top_curriculum", "critical_signals",
]


def filter_opportunities(df: DataFrame, **params) -> DataFrame:
    """List filter over institutions joined to scores.

    Parameters (all optional): q (substring of name or postcode, ASCII case
    ignored), region, type, curriculum, tier, min_score, max_score, has_email.
    """
    keep: list[Column] = []
    if params.get("q"):
        like = f"%{params['q']}%"
        keep.append(F.col("name").ilike(like) | F.col("postcode").ilike(like))
    for param, column in (("region", "region"), ("type", "type"), ("curriculum", "top_curriculum"), ("tier", "tier")):
        if params.get(param):
            keep.append(F.col(column) == params[param])
    if params.get("min_score") is not None:
        keep.append(F.col("score") >= params["min_score"])
    if params.get("max_score") is not None:
        keep.append(F.col("score") <= params["max_score"])
    if params.get("has_email"):
        keep.append(F.col("general_email").isNotNull() | F.col("head_email").isNotNull())
    for cond in keep:
        df = df.where(cond)
    return df


def list_order() -> list[Column]:
    return [
        F.coalesce("score", F.lit(-1)).desc(),
        F.coalesce("inspection_count", F.lit(0)).desc(),
        F.col("name").asc(),
        F.col("id").asc(),
    ]


def opportunity_matches(t: Tables, show_all: bool = False, **params) -> DataFrame:
    """Everything a list request matches, not yet paged.

    With a type the unscored institutions are listed too. Provider types are
    restricted to those with evidence unless ``show_all``.
    """
    df = t.institutions.where(F.col("in_scope"))
    scored = t.scores.withColumnRenamed("institution_id", "id")
    df = filter_opportunities(df.join(scored, "id", "left" if params.get("type") else "inner"), **params)
    if not show_all and (not params.get("type") or params["type"] in PROVIDER_TYPES):
        df = with_evidence(df, *t.evidence()).where(F.col("actionable"))
    return df


def opportunity_ranking(t: Tables, path: str, show_all: bool = False, **params) -> RankedTable:
    """The whole ranked list, stored once; its pages are seeks."""
    return RankedTable.build(opportunity_matches(t, show_all, **params), list_order(), path)


def opportunity_list(t: Tables, number: int = 1, show_all: bool = False, ranking: RankedTable | None = None, **params) -> DataFrame:
    """One page of the ranked list with reference inspection and top finding.

    The page is cut first, from a stored ``ranking`` of the same parameters if
    there is one; inspections and findings are then looked up for its thirty
    rows only.
    """
    if ranking is None:
        rows = page(opportunity_matches(t, show_all, **params), number, list_order(), PAGE_SIZE)
    else:
        rows = ranking.page(number, PAGE_SIZE)
    keep = [
        "id", "name", "type", "region", "postcode", "head_name", "head_email", "general_email", "score", "tier",
        "raw_score", "top_curriculum", "top_finding_id", "finding_count", "last_inspection_id", "inspection_count",
    ]
    ids = rows.select(*keep)
    inst = ids.select(*[c for c in keep if c in t.institutions.columns])
    scores = ids.select(
        F.col("id").alias("institution_id"), *[c for c in keep if c not in t.institutions.columns]
    )
    fields = ["inspection_start_date", "overall_grade", "previous_overall_grade", "report_url", "grade_dropped"]
    history = t.inspections.join(ids.select(F.col("id").alias("institution_id")), "institution_id", "left_semi")
    full = with_reference_inspection(inst, scores, history, fields)
    if not params.get("type"):
        # The default list shows the scored inspection only.
        unscored = F.col("last_inspection_id").isNull()
        full = full.withColumns({f: F.when(~unscored, F.col(f)) for f in fields})
    return with_top_finding(full, t.findings).orderBy(*list_order())


def opportunity_total(t: Tables, show_all: bool = False, **params) -> DataFrame:
    return opportunity_matches(t, show_all, **params).agg(F.count(F.lit(1)).alias("total"))


def _asked(rows: DataFrame, key: str) -> DataFrame:
    """Each id with each value it has of a foreign key, once."""
    return rows.where(F.col(key).isNotNull()).select("id", key).distinct()


def _answered(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """What was found for the pairs of :func:`_asked`, joined in by id.

    The foreign key is compared inside an array, which is no join key: rows
    that are dealt out by id are not dealt out again by both.
    """
    side = facts.withColumnsRenamed({"id": "__id", key: "__key"})
    same = (F.col("id") == F.col("__id")) & F.array_contains(F.array(key), F.col("__key"))
    return rows.join(side, same, "left").drop("__id", "__key")


def opportunity_export(t: Tables, limit: int | None = None, **params) -> DataFrame:
    """The 38 columns of the CSV export, best first; all rows unless ``limit`` names a number.

    A limit cuts the rows before the wide lookups, and the child tables are
    reduced to those institutions before they are aggregated. Inspections and
    findings are looked up for ids alone and come back by institution, like the
    bags: the wide rows are dealt out once.
    """
    df = filter_opportunities(t.scored(), **params)
    order = [F.col("score").desc(), F.col("raw_score").desc(), F.col("id").asc()]
    rows = df if limit is None else df.orderBy(*order).limit(limit)
    ids = rows.select(F.col("id").alias("institution_id"))

    def children(child: DataFrame, cond: Column) -> DataFrame:
        return child.where(cond).join(ids, "institution_id", "left_semi")

    notices = children(t.notices, F.col("withdrawn_at").isNull())
    worst = F.struct("severity", "id")
    n_bag = notices.groupBy(F.col("institution_id").alias("id")).agg(
        F.count(F.lit(1)).alias("active_compliance_count"),
        F.max_by("subject", worst).alias("compliance_top_subject"),
        F.max("severity").alias("compliance_top_severity"),
        F.max_by("source_url", worst).alias("compliance_top_url"),
    )
    news = children(t.news, (F.col("relevance") >= 50) & (F.col("trigger_severity") > 0))
    top = F.struct("trigger_severity", "id")
    w_bag = news.groupBy(F.col("institution_id").alias("id")).agg(
        F.count(F.lit(1)).alias("active_news_count"),
        F.max_by("title", top).alias("news_top_title"),
        F.max("trigger_severity").alias("news_top_severity"),
        F.max_by("curricula_tagged", top).alias("news_top_curricula"),
        F.max_by("angle", top).alias("news_top_angle"),
        F.max_by("url", top).alias("news_top_url"),
    )
    insp = t.inspections.select(
        F.col("id").alias("last_inspection_id"), "overall_grade", "previous_overall_grade", "grade_dropped",
        "inspection_start_date", "report_url",
    )
    insp = _asked(rows, "last_inspection_id").join(insp, "last_inspection_id")
    found = with_top_finding(_asked(rows, "top_finding_id"), t.findings, "inner")
    full = rows.join(n_bag, "id", "left").join(w_bag, "id", "left")
    full = _answered(_answered(full, insp, "last_inspection_id"), found, "top_finding_id")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    return full.orderBy(*order).select(
        "name", "type", "region", "local_authority", "postcode", "ukprn", "urn", "head_name", "head_email",
        "general_email", "phone", "website", "tier", "score", "urgency_score", "pipeline_value_score", "raw_score",
        "top_curriculum", "top_curriculum_score", "finding_count",
        grade_label(F.col("overall_grade")).alias("current_grade"),
        grade_label(F.col("previous_overall_grade")).alias("previous_grade"),
        F.when(F.col("grade_dropped"), "yes").otherwise("no").alias("grade_dropped"),
        F.col("inspection_start_date").alias("latest_inspection_date"),
        "report_url",
        blank("top_phrase_id").alias("top_weakness_phrase"),
        blank("top_quote").alias("top_weakness_quote"),
        F.coalesce("active_compliance_count", F.lit(0)).alias("active_compliance_count"),
        blank("compliance_top_subject").alias("compliance_top_subject"),
        F.coalesce(F.col("compliance_top_severity").cast("string"), F.lit("")).alias("compliance_top_severity"),
        blank("compliance_top_url").alias("compliance_top_url"),
        F.coalesce("active_news_count", F.lit(0)).alias("active_news_count"),
        blank("news_top_title").alias("news_top_title"),
        F.coalesce(F.col("news_top_severity").cast("string"), F.lit("")).alias("news_top_severity"),
        blank("news_top_curricula").alias("news_top_curricula"),
        blank("news_top_angle").alias("news_top_angle"),
        blank("news_top_url").alias("news_top_url"),
        F.coalesce(F.array_join("critical_signals", " · "), F.lit("")).alias("critical_signals"),
    )


def top_opportunities(t: Tables, n: int) -> DataFrame:
    """The best in-scope institutions with the grade of the scored inspection."""
    df = t.scored().where(F.col("in_scope"))
    order = [
        F.col("score").desc(), F.col("urgency_score").desc(), F.col("inspection_count").desc(), F.col("id").asc(),
    ]
    best = df.orderBy(*order).limit(n)
    insp = t.inspections.select(F.col("id").alias("last_inspection_id"), F.col("overall_grade").alias("current_grade"))
    cols = [
        "id", "name", "region", "type", "score", "urgency_score", "inspection_count", "top_curriculum",
        "current_grade", "finding_count",
    ]
    return best.join(insp, "last_inspection_id", "left").orderBy(*order).select(*cols)


def distinct_regions(t: Tables) -> DataFrame:
    """Regions of scored in-scope institutions, sorted."""
    df = t.scored().where(F.col("in_scope") & (F.col("region") != ""))
    return df.select("region").distinct().orderBy("region")


def tier_position(col: Column) -> Column:
    return list_position(col, TIERS)


def cohort(t: Tables, type_: str, tier: str | None = None, actionable: bool = True, how: str = "inner") -> DataFrame:
    """In-scope institutions of a type with score and latest inspection."""
    df = t.scored(how).where((F.col("type") == type_) & F.col("in_scope"))
    if tier:
        df = df.where(F.col("tier") == tier)
    if actionable:
        df = with_evidence(df, *t.evidence()).where(F.col("actionable"))
    joined = with_latest(df.select(*COHORT_COLUMNS), t.inspections)
    return joined.select(*COHORT_COLUMNS, "latest_grade", "latest_inspection_date")


_URGENT_FIRST = ["urgency_score", "score"]


def cohort_ranking(t: Tables, kind: str, n: int | None = None) -> DataFrame:
    """The named dashboard cohorts, the first ``n`` of them (None: all).

    critical, high, outstanding, major, by_score, by_size, universities,
    outreach_ids.
    """
    tail = F.col("id").asc()
    urgent = [F.col(c).desc() for c in _URGENT_FIRST] + [tail]
    size = [F.col("apprenticeship_standards").desc_nulls_last(), tail]
    if kind == "critical":
        df, order = cohort(t, "itp", "critical"), urgent
    elif kind == "high":
        df, order = cohort(t, "itp", "high"), urgent
    elif kind == "outstanding":
        df = cohort(t, "itp", actionable=False).where(F.col("latest_grade") == "outstanding")
        order = [F.col("latest_inspection_date").desc(), tail]
    elif kind == "major":
        df, order = cohort(t, "itp"), size
    elif kind == "by_score":
        df = cohort(t, "itp", actionable=False)
        order = [F.col("score").desc(), F.col("urgency_score").desc(), tail]
    elif kind == "by_size":
        df, order = cohort(t, "itp", actionable=False, how="left"), size
    elif kind == "universities":
        enough = F.coalesce(F.col("apprenticeship_standards") >= 5, F.lit(False))
        scope = t.scored("left").where((F.col("type") == "university") & F.col("in_scope"))
        df = with_evidence(scope, *t.evidence()).where(F.col("actionable") | enough).select(*COHORT_COLUMNS)
        order = [F.col("apprenticeship_standards").desc_nulls_last(), F.col("name").asc(), tail]
    elif kind == "outreach_ids":
        keep = F.col("in_scope") & (F.col("tier") == "critical") & F.col("type").isin("itp", "fe_college")
        df, order = t.scored().where(keep).select(*COHORT_COLUMNS), urgent
    else:
        raise ValueError(f"unknown cohort {kind!r}")
    df = df.orderBy(*order)
    return df if n is None else df.limit(n)


def rank_by_tier(t: Tables, type_: str = "itp") -> DataFrame:
    """The whole universe of a type: tier, urgency, score, size, name."""
    df = cohort(t, type_, how="left")
    zero = lambda c: F.coalesce(c, F.lit(0)).desc()
    return df.orderBy(
        tier_position(F.col("tier")),
        zero("urgency_score"),
        zero("score"),
        zero("apprenticeship_standards"),
        F.col("name"),
        F.col("id"),
    )


def signal_feed(t: Tables, type_: str, kind: str, n: int) -> DataFrame:
    """Newest, strongest notices or news of a type.

    The feed is cut after the join to the type, as a top-n without a sort of
    the whole table.
    """
    inst = t.institutions.where(F.col("type") == type_).select(
        F.col("id").alias("institution_id"), "name", "ukprn"
    )
    tail = F.col("id").asc()
    if kind == "notices":
        rows = t.notices.where(F.col("withdrawn_at").isNull())
        cols = ["notice_body", "notice_type", "severity", "subject", "issued_at", "source_url"]
        order = [F.col("severity").desc(), F.col("issued_at").desc_nulls_last(), tail]
    else:
        rows = t.news.where((F.col("trigger_severity") >= 50) & (F.col("relevance") >= 50))
        cols = [
            "title", "angle", "trigger_severity", "relevance", "curricula_tagged", "published_at", "url", "source",
        ]
        order = [F.col("trigger_severity").desc(), F.col("published_at").desc_nulls_last(), tail]
    joined = rows.select("institution_id", "id", *cols).join(inst, "institution_id")
    return joined.orderBy(*order).limit(n)


# ---- work queues -----------------------------------------------------------


def pending_queue(t: Tables, budget: int) -> DataFrame:
    """Unrated news, best institutions first, newest first."""
    scores = t.scores.select("institution_id", "score")
    inst = t.institutions.select(
        F.col("id").alias("institution_id"), F.col("name").alias("institution_name"), F.col("type").alias("institution_type")
    )
    pending = t.news.where(F.col("angle").isNull()).select(
        "id", "institution_id", "title", "excerpt", "source", "published_at"
    )
    df = pending.join(inst, "institution_id").join(scores, "institution_id", "left")
    order = [F.coalesce("score", F.lit(0)).desc(), F.col("published_at").desc_nulls_last(), F.col("id").asc()]
    return df.orderBy(*order).limit(budget).drop("score")


def report_queue(t: Tables, grades: list[str], cap: int, types: list[str] | None = None, refresh: bool = False) -> DataFrame:
    """Inspections whose report is to be fetched: grade order, then newest."""
    df = t.inspections.where(F.col("report_url") != "")
    if not refresh:
        df = df.where(F.col("report_text").isNull())
    inst = t.institutions.select(F.col("id").alias("institution_id"), F.col("type").alias("institution_type"))
    if types:
        inst = inst.where(F.col("institution_type").isin(*types))
    df = df.select("id", "report_url", "institution_id", "overall_grade", "inspection_start_date").join(
        inst, "institution_id"
    )
    order = [list_position(F.col("overall_grade"), grades), F.col("inspection_start_date").desc(), F.col("id").asc()]
    return df.orderBy(*order).limit(cap)


def provider_queue(t: Tables, budget: int) -> DataFrame:
    """Providers whose news is searched next."""
    wanted = F.col("type").isin("itp", "fe_college", "sixth_form_college", "university") | (
        F.col("tier").isin("critical", "high") & (F.col("type") == "employer")
    )
    df = t.scored().where(F.col("in_scope") & wanted)
    place = list_position(F.col("tier"), ["critical", "high", "worth_a_look"])
    return df.orderBy(place, F.col("score").desc(), F.col("id").asc()).limit(budget).select("id", "name", "tier", "score")


def stale_queue(institutions: DataFrame, budget: int, type_: str = "itp") -> DataFrame:
    """Least recently updated in-scope institutions of a type."""
    df = institutions.where((F.col("type") == type_) & F.col("in_scope"))
    return df.orderBy(F.col("updated_at").asc(), F.col("id").asc()).limit(budget).select("id", "name", "postcode", "updated_at")


def enrichment_cohort(t: Tables, budget: int, tiers: list[str] | None = None) -> DataFrame:
    """In-scope institutions with a site but no mailbox, by score."""
    df = t.scored("left").where(
        F.col("in_scope")
        & F.col("website").isNotNull()
        & F.col("general_email").isNull()
        & F.col("head_email").isNull()
    )
    if tiers:
        df = df.where(F.col("tier").isin(*tiers))
    order = [F.col("score").desc_nulls_last(), F.col("id").asc()]
    return df.orderBy(*order).limit(budget).select("id", "website", "tier", "score")


def directory_cohort(institutions: DataFrame, budget: int) -> DataFrame:
    """Providers on the directory that still miss mailbox, site or size."""
    missing = (
        F.col("general_email").isNull()
        | F.col("website").isNull()
        | (F.coalesce("apprenticeship_standards", F.lit(0)) == 0)
    )
    df = institutions.where(
        F.col("in_scope")
        & F.col("ukprn").isNotNull()
        & F.col("type").isin("itp", "fe_college", "sixth_form_college", "employer")
        & missing
    )
    return df.orderBy("id").limit(budget).select("id", "ukprn", "type")


def qa_sample(t: Tables, n: int, seed: int | None = None) -> DataFrame:
    """``n`` random institutions that have findings.

    With a seed the order is the MD5 of seed and id, so a run can be repeated
    by any engine.
    """
    ids = t.findings.where(~F.col("suppressed")).groupBy("institution_id").agg(
        F.min_by("inspection_id", "id").alias("inspection_id")
    )
    order = F.rand() if seed is None else F.md5(F.concat_ws(":", F.lit(seed), F.col("institution_id")).cast("binary"))
    picked = ids.orderBy(order).limit(n)
    inst = t.institutions.select(F.col("id").alias("institution_id"), "name", "region", "type")
    insp = t.inspections.select(F.col("id").alias("inspection_id"), "inspection_start_date")
    return picked.join(inst, "institution_id").join(insp, "inspection_id").select(
        "institution_id", "name", "region", "type", "inspection_start_date"
    )
