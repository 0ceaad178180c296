"""Two-axis opportunity scores.

Urgency comes from judgements, findings, notices and news; pipeline value from
how good a prospect the institution is. Every rule is a column expression over
one row per institution; the only exchanges are those of the bags.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.framework import FE_TYPES
from ..functions.grades import SHORT_LABELS, URGENCY, grade_urgency
from ..functions.text import half_up, lookup, present, sql_literal, sql_map
from ..schemas import CURRICULA, TEXT_JUDGEMENTS
from ..session import cut_lineage
from .bags import finding_bag, inspection_meta, news_bag, notice_bag
from .upsert import upsert

# ---- fixed values ---------------------------------------------------------
# framework -> (column, label, weights in curriculum order:
#               financial, employability, confidence, online safety)
JUDGEMENT_WEIGHTS = {
    "school": [
        ("safeguarding_effective", "Safeguarding", (0.0, 0.0, 0.4, 0.95)),
        ("personal_development", "Personal Development", (0.7, 0.7, 0.9, 0.6)),
        ("personal_dev_wellbeing", "Personal Development & Wellbeing", (0.8, 0.8, 0.9, 0.7)),
        ("behaviour_attitudes", "Behaviour and Attitudes", (0.1, 0.2, 0.9, 0.4)),
        ("attendance_behaviour", "Attendance and Behaviour", (0.2, 0.3, 0.95, 0.4)),
        ("inclusion", "Inclusion", (0.3, 0.4, 0.7, 0.3)),
        ("quality_of_education", "Quality of Education", (0.2, 0.4, 0.3, 0.3)),
        ("curriculum_teaching", "Curriculum and Teaching", (0.3, 0.4, 0.3, 0.3)),
        ("achievement", "Achievement", (0.2, 0.4, 0.4, 0.1)),
        ("sixth_form_provision", "Sixth Form Provision", (0.6, 0.9, 0.5, 0.3)),
        ("overall_grade", "Overall Effectiveness", (0.3, 0.4, 0.5, 0.4)),
    ],
    "fe_skills": [
        ("safeguarding_effective", "Safeguarding", (0.0, 0.0, 0.4, 0.95)),
        ("personal_development", "Personal Development", (0.8, 0.85, 0.85, 0.7)),
        ("behaviour_attitudes", "Behaviour and Attitudes", (0.2, 0.5, 0.85, 0.4)),
        ("quality_of_education", "Quality of Education", (0.3, 0.5, 0.3, 0.3)),
        ("apprenticeships", "Apprenticeships", (0.6, 0.95, 0.6, 0.4)),
        ("adult_learning_programmes", "Adult Learning Programmes", (0.7, 0.8, 0.5, 0.4)),
        ("young_peoples_provision", "Education programmes for young people", (0.7, 0.9, 0.7, 0.5)),
        ("high_needs_provision", "Provision for learners with high needs", (0.6, 0.8, 0.85, 0.5)),
        ("contribution_to_skills", "Contribution to skills needs", (0.4, 0.8, 0.3, 0.2)),
        ("overall_grade", "Overall Effectiveness", (0.3, 0.6, 0.4, 0.3)),
    ],
    "isi": [
        ("safeguarding_effective", "Safeguarding (ISS Part 3)", (0.0, 0.0, 0.6, 0.9)),
        ("personal_development", "Personal Development (ISI EQI)", (0.7, 0.6, 0.9, 0.7)),
        ("overall_grade", "Overall Outcome", (0.3, 0.4, 0.5, 0.4)),
    ],
}
JUDGEMENT_POINTS, JUDGEMENT_CAP = 35, 70
FINDING_SATURATION, FINDING_CAP = 25, 55
_FL, _ES, _CR, _OS = CURRICULA
# (column, value, floors, signal, critical), in evaluation order
HARD_FLOORS = [
    ("safeguarding_effective", False, {_OS: 90}, "Safeguarding NOT MET — regulatory urgency", True),
    ("personal_development", "inadequate", {_CR: 88}, "Personal Development: Inadequate", True),
    ("personal_dev_wellbeing", "inadequate", {_CR: 88}, "Personal Development & Wellbeing: Urgent improvement", True),
    ("behaviour_attitudes", "inadequate", {_CR: 82}, "Behaviour and Attitudes: Inadequate", True),
    ("attendance_behaviour", "inadequate", {_CR: 82}, "Attendance and Behaviour: Urgent improvement", True),
    ("apprenticeships", "inadequate", {_ES: 90, _CR: 70}, "Apprenticeships: Inadequate", True),
    ("apprenticeships", "requires_improvement", {_ES: 72}, "Apprenticeships: Requires improvement", False),
    ("young_peoples_provision", "inadequate", {_ES: 88}, "Education programmes for young people: Inadequate", True),
    (
        "young_peoples_provision", "requires_improvement", {_ES: 70},
        "Education programmes for young people: Requires improvement", False,
    ),
    ("adult_learning_programmes", "inadequate", {_ES: 85, _FL: 75}, "Adult learning programmes: Inadequate", True),
    ("high_needs_provision", "inadequate", {_CR: 85}, "Provision for learners with high needs: Inadequate", True),
    ("overall_grade", "inadequate", dict.fromkeys(CURRICULA, 75), "Overall: Inadequate", True),
    ("overall_grade", "requires_improvement", dict.fromkeys(CURRICULA, 55), "Overall: Requires improvement", False),
    (
        "overall_grade", "does_not_meet_standard", dict.fromkeys(CURRICULA, 75),
        "Overall: Does not meet the standard", True,
    ),
]
STRONG_URGENCY, MILD_URGENCY, MILD_SIGNAL_LIMIT = 0.7, 0.55, 8
NOTICE_FACTOR, NOTICE_CRITICAL = 0.85, 90
NEWS_TRIGGER, NEWS_EXTRA, NEWS_CRITICAL = 70, 50, 85
NEWS_TAGGED_FACTOR, NEWS_PLAIN_FACTOR = 0.9, 0.65
SYNERGY_FACTOR = 1.2
GRADE_CEILING = {
    "inadequate": 100,
    "does_not_meet_standard": 100,
    "requires_improvement": 95,
    "good": 75,
    "meets_standard": 75,
    "outstanding": 60,
    "not_judged": 80,
}
OPEN_CEILING = 80
PIPELINE_TYPES = ["itp", "fe_college", "sixth_form_college", "university", "employer"]
UNINSPECTED_TYPES = ["itp", "fe_college", "sixth_form_college", "university"]
PIPELINE_BASE = 35
DAYS_PER_MONTH, DAYS_PER_YEAR = 30.44, 365.25
COMMISSIONER_SCORES = {_ES: 95, _CR: 80, _FL: 70, _OS: 60}
EMPLOYER_SCORES = {_ES: 78, _CR: 55, _FL: 45, _OS: 40}
COMMISSIONER_SIGNALS = [
    "Skills Bootcamps commissioning authority — direct budget for pre-employment programmes",
    "Published skills-team contact email on record",
]
EMPLOYER_SIGNALS = [
    "APAR Employer-Provider — runs own apprenticeship scheme",
    "ICP fit: pre-employment bootcamp drops into their existing trainee pipeline",
]
NO_WEBSITE_SIGNAL = "(no website on record — enrich first)"
NO_SIGNAL = "Pipeline value (no inspection signal)"
# ---------------------------------------------------------------------------

SUB = {c: f"{c}_score" for c in CURRICULA}
LATEST = ["id", "inspection_body", "safeguarding_effective", "overall_grade", *TEXT_JUDGEMENTS]
SCORE_COLUMNS = [
    "institution_id", "score", "urgency_score", "pipeline_value_score", "raw_score", *SUB.values(),
    "top_curriculum", "top_curriculum_score", "top_finding_id", "critical_signals", "tier", "finding_count",
    "inspection_count", "first_inspection_date", "latest_inspection_date", "last_inspection_id",
]
#: Columns an employer row overwrites in a row an earlier pass left.
EMPLOYER_OVERWRITES = ["score", *SUB.values(), "top_curriculum", "top_curriculum_score", "critical_signals", "tier"]


def _int(col: Column) -> Column:
    return col.cast("int")


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def judgement_weights(spark: SparkSession) -> DataFrame:
    """The weights as a table: framework, position, field, label, curriculum, weight."""
    rows = [
        (fw, i, field, label, c, w)
        for fw, fields in JUDGEMENT_WEIGHTS.items()
        for i, (field, label, weights) in enumerate(fields)
        for c, w in zip(CURRICULA, weights)
    ]
    return spark.createDataFrame(
        rows, "framework string, position int, field string, label string, curriculum string, weight double"
    )


def weight_framework(body: Column, type_: Column) -> Column:
    return F.when(body == "isi", "isi").when(type_.isin(*FE_TYPES), "fe_skills").otherwise("school")


def _urgency(field: str) -> Column:
    if field == "safeguarding_effective":
        return F.when(~F.col(field), 1.0).when(F.col(field), -0.05).otherwise(0.0)
    return F.when(present(F.col(field)), grade_urgency(F.col(field))).otherwise(0.0)


def with_judged(df: DataFrame) -> DataFrame:
    """``judged``: the weighted fields of the framework that applies, in order.

    Built once per row and read by the sums and by the explanations.
    """

    def entry(field: str, label: str, weights: tuple[float, ...]) -> str:
        if field == "safeguarding_effective":
            urgency = f"CASE WHEN {field} THEN -0.05D WHEN NOT {field} THEN 1.0D ELSE 0.0D END"
            shown = f"CASE WHEN {field} THEN 'Met' WHEN NOT {field} THEN 'Not met' END"
        else:
            urgency = f"coalesce(try_element_at({sql_map(URGENCY)}, {field}), 0.0D)"
            shown = f"nullif(coalesce(try_element_at({sql_map(SHORT_LABELS)}, {field}), {field}), '')"
        values = ", ".join(sql_literal(w) for w in weights)
        note = f"concat({sql_literal(label + ': ')}, {shown})"
        return f"named_struct('urgency', {urgency}, 'note', {note}, 'weights', array({values}))"

    arms = " ".join(
        f"WHEN '{fw}' THEN array({', '.join(entry(*f) for f in fields)})" for fw, fields in JUDGEMENT_WEIGHTS.items()
    )
    framed = df.withColumn("__frame", weight_framework(F.col("inspection_body"), F.col("type")))
    return framed.withColumn("judged", F.expr(f"CASE __frame {arms} END")).drop("__frame")


def judgement_part(df: DataFrame) -> DataFrame:
    """``<curriculum>_judgement``: weighted weak grades, capped."""

    def total(i: int) -> Column:
        weak = F.filter("judged", lambda m: m["urgency"] > 0)
        points = F.aggregate(
            weak, F.lit(0.0), lambda acc, m: acc + m["urgency"] * F.get(m["weights"], F.lit(i)) * JUDGEMENT_POINTS
        )
        return F.least(F.lit(float(JUDGEMENT_CAP)), points)

    return with_judged(df).withColumns({f"{c}_judgement": total(i) for i, c in enumerate(CURRICULA)})


def finding_part(df: DataFrame) -> DataFrame:
    """``<curriculum>_finding``: square-root curve of the finding totals, capped."""

    def curve(total: Column) -> Column:
        part = F.least(F.lit(float(FINDING_CAP)), F.sqrt(total / FINDING_SATURATION) * FINDING_CAP)
        return F.when(total > 0, part).otherwise(0.0)

    return df.withColumns({f"{c}_finding": curve(F.col(f"{c}_total")) for c in CURRICULA})


def sub_scores(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            SUB[c]: _int(half_up(F.least(F.lit(100.0), F.col(f"{c}_judgement") + F.col(f"{c}_finding"))))
            for c in CURRICULA
        }
    )


def hard_floors(df: DataFrame) -> DataFrame:
    """Floors of non-negotiable evidence; starts ``signals`` and ``critical_count``."""
    rules = F.expr(
        "array("
        + ", ".join(
            f"named_struct('fires', coalesce({field} = {sql_literal(value)}, FALSE), "
            f"'floors', array({', '.join(str(floors.get(c, 0)) for c in CURRICULA)}), "
            f"'text', {sql_literal(text)}, 'critical', {sql_literal(critical)})"
            for field, value, floors, text, critical in HARD_FLOORS
        )
        + ")"
    )

    def floored(i: int, c: str) -> Column:
        return F.aggregate("__fired", F.col(SUB[c]), lambda acc, r: F.greatest(acc, F.get(r["floors"], F.lit(i))))

    return (
        df.withColumn("__fired", F.filter(rules, lambda r: r["fires"]))
        .withColumns(
            {
                **{SUB[c]: floored(i, c) for i, c in enumerate(CURRICULA)},
                "signals": F.transform("__fired", lambda r: r["text"]),
                "critical_count": F.size(F.filter("__fired", lambda r: r["critical"])),
            }
        )
        .drop("__fired")
    )


def explain_signals(df: DataFrame) -> DataFrame:
    """Weak grades appended in mapping order.

    Strong ones always; mild ones only while fewer than eight signals exist,
    so the array is built up step by step.
    """

    def add(acc: Column, m: Column) -> Column:
        wanted = (m["urgency"] >= STRONG_URGENCY) | (
            (m["urgency"] >= MILD_URGENCY) & (F.size(acc) < MILD_SIGNAL_LIMIT)
        )
        new = wanted & m["note"].isNotNull() & ~F.array_contains(acc, F.coalesce(m["note"], F.lit("")))
        return F.when(new, F.array_append(acc, m["note"])).otherwise(acc)

    return df.withColumn("signals", F.aggregate("judged", F.col("signals"), add)).drop("judged")


def notice_floor(df: DataFrame) -> DataFrame:
    """Active notices lift every sub-score and add up to three signals."""
    floor = _int(F.greatest(F.lit(0), half_up(F.col("worst_severity") * F.lit(NOTICE_FACTOR))))
    subjects = F.transform("top_notices", lambda n: F.concat(F.lit("Compliance: "), n["subject"]))
    return df.withColumns(
        {
            **{SUB[c]: F.greatest(F.col(SUB[c]), F.coalesce(floor, F.lit(0))) for c in CURRICULA},
            "signals": F.concat("signals", F.coalesce(subjects, _no_strings())),
            "critical_count": F.col("critical_count")
            + F.coalesce(F.col("worst_severity") >= NOTICE_CRITICAL, F.lit(False)).cast("int"),
        }
    )


def with_top_news(df: DataFrame) -> DataFrame:
    """Facts of the top article, null or empty where nothing triggers."""
    top = F.get("top_news", F.lit(0))
    triggered = top["severity"] >= NEWS_TRIGGER
    tagged = _int(half_up(top["severity"] * F.lit(NEWS_TAGGED_FACTOR)))
    plain = _int(half_up(top["severity"] * F.lit(NEWS_PLAIN_FACTOR)))
    untagged = F.size(top["curricula"]) == 0
    return df.withColumns(
        {
            "news_lead": F.when(triggered, top),
            "news_urgency": F.coalesce(F.when(triggered, tagged), F.lit(0)),
            "news_lift": F.coalesce(F.when(triggered, F.when(untagged, plain).otherwise(tagged)), F.lit(0)),
            "news_lifts": F.when(triggered, F.when(untagged, F.array(*[F.lit(c) for c in CURRICULA])).otherwise(top["curricula"])),
        }
    )


def _news_lift(c: str) -> Column:
    """What the top article asks of a curriculum (0 when nothing)."""
    return F.when(F.array_contains("news_lifts", c), F.col("news_lift")).otherwise(0)


def _headline_text(item: Column, width: int) -> Column:
    return F.concat(F.lit("News: "), F.coalesce(item["angle"], F.substring(item["title"], 1, width)))


def news_boost(df: DataFrame) -> DataFrame:
    """The top article lifts its curricula; up to two more become signals."""

    def dated(item: Column, width: int) -> Column:
        when = F.coalesce(item["published_at"], F.lit("recent"))
        return F.concat(_headline_text(item, width), F.lit(" ("), when, F.lit(")"))

    lead = F.col("news_lead")
    extras = F.transform(
        F.filter(F.slice("top_news", 2, 2), lambda n: n["severity"] >= NEWS_EXTRA), lambda n: dated(n, 90)
    )
    return (
        with_top_news(df)
        .withColumns(
            {
                **{SUB[c]: F.greatest(F.col(SUB[c]), _news_lift(c)) for c in CURRICULA},
                "signals": F.concat(
                    "signals",
                    F.when(lead.isNotNull(), F.array(dated(lead, 100))).otherwise(_no_strings()),
                    F.coalesce(extras, _no_strings()),
                ),
                "critical_count": F.col("critical_count")
                + F.coalesce(lead["severity"] >= NEWS_CRITICAL, F.lit(False)).cast("int"),
            }
        )
        .drop("news_lead", "news_urgency", "news_lift", "news_lifts")
    )


def synergy(df: DataFrame) -> DataFrame:
    """Two or more critical flags multiply every sub-score."""
    on = F.col("critical_count") >= 2
    text = F.concat(F.lit("("), F.col("critical_count").cast("string"), F.lit(" critical flags — synergy ×1.2)"))
    return df.withColumns(
        {
            **{
                SUB[c]: F.when(
                    on, _int(F.least(F.lit(100), half_up(F.col(SUB[c]) * F.lit(SYNERGY_FACTOR))))
                ).otherwise(F.col(SUB[c]))
                for c in CURRICULA
            },
            "signals": F.when(on, F.array_append("signals", text)).otherwise(F.col("signals")),
        }
    )


def lead_curriculum(df: DataFrame) -> DataFrame:
    """The highest sub-score (first among equals); null when all are zero."""
    best = F.greatest(*[F.col(s) for s in SUB.values()])
    lead = F.when(best <= 0, None)
    for c in CURRICULA:
        lead = lead.when(F.col(SUB[c]) == best, c)
    return df.withColumns({"top_curriculum": lead, "top_curriculum_score": F.greatest(best, F.lit(0))})


def pipeline_value(df: DataFrame, as_of: str) -> DataFrame:
    """``pipeline_value_score`` and ``pipeline_signals`` as of a given day."""
    count, today = F.coalesce("inspection_count", F.lit(0)), F.lit(as_of).cast("date")
    months = F.datediff(today, F.col("latest_inspection_date").try_cast("date")) / DAYS_PER_MONTH
    years = F.datediff(today, F.col("first_inspection_date").try_cast("date")) / DAYS_PER_YEAR
    standards = F.coalesce("apprenticeship_standards", F.lit(0))
    contact = present(F.col("general_email")) | present(F.col("head_email"))
    listed = F.coalesce(F.col("source").contains("apar"), F.lit(False))

    def number(col: Column, text: str) -> Column:
        return F.concat(col.cast("string"), F.lit(text))

    def rule(*cases: tuple[Column, int, Column | str | None]) -> Column:
        """struct(points, signal) of the first case that holds."""
        out: Column | None = None
        for cond, value, text in cases:
            shown = F.lit(text).cast("string") if text is None or isinstance(text, str) else text
            hit = F.struct(F.lit(value).alias("points"), shown.alias("signal"))
            out = F.when(cond, hit) if out is None else out.when(cond, hit)
        return out

    on_register = number(F.floor(years), "+ years on Ofsted register")
    delivered = " apprenticeship standards delivered"
    rules = [
        rule((listed, 18, "APAR-listed approved provider")),
        rule(
            (count >= 5, 18, number(count, "+ historical inspections (very established)")),
            (count >= 3, 14, number(count, "+ historical inspections (established)")),
            (count >= 1, 8, "Has Ofsted track record"),
        ),
        rule(
            (months <= 24, 12, "Active (inspected within 24 months)"),
            (months <= 60, 6, "Inspected within 5 years"),
        ),
        rule((years >= 15, 12, on_register), (years >= 10, 8, on_register), (years >= 5, 5, None)),
        rule(
            (F.col("best_grade") == "outstanding", 8, "Previously rated Outstanding"),
            (F.col("best_grade") == "good", 5, "Previously rated Good"),
        ),
        rule((contact, 15, "Reachable (email on file)")),
        rule((present(F.col("website")), 8, "Website on file")),
        rule(
            (standards >= 50, 28, number(standards, delivered + " (major provider)")),
            (standards >= 25, 20, number(standards, delivered + " (large provider)")),
            (standards >= 10, 12, number(standards, delivered)),
            (standards >= 3, 5, number(standards, delivered)),
        ),
    ]
    scored = df.withColumn("__rules", F.when(F.col("type").isin(*PIPELINE_TYPES), F.array_compact(F.array(*rules))))
    total = F.aggregate("__rules", F.lit(PIPELINE_BASE), lambda acc, r: acc + r["points"])
    signals = F.filter(F.transform("__rules", lambda r: r["signal"]), lambda s: s.isNotNull())
    return scored.withColumns(
        {
            "pipeline_value_score": F.when(F.col("__rules").isNotNull(), F.least(F.lit(100), total)).otherwise(0),
            "pipeline_signals": F.coalesce(signals, _no_strings()),
        }
    ).drop("__rules")


def grade_ceiling(grade: Column) -> Column:
    return F.coalesce(lookup(grade, GRADE_CEILING), F.lit(OPEN_CEILING))


def headline(urgency: Column, pipeline: Column, grade: Column) -> Column:
    """The greater axis, held under the grade's ceiling unless urgency breaks it."""
    return F.least(F.greatest(grade_ceiling(grade), urgency), F.greatest(urgency, pipeline))


def tier(urgency: Column, pipeline: Column) -> Column:
    return (
        F.when(urgency >= 70, "critical")
        .when(urgency >= 50, "high")
        .when((pipeline >= 92) & (urgency >= 30), "high")
        .when(pipeline >= 60, "worth_a_look")
        .when(urgency >= 30, "worth_a_look")
        .otherwise("skip")
    )


def score_base(
    institutions: DataFrame,
    inspections: DataFrame,
    findings: DataFrame,
    matches: DataFrame,
    notices: DataFrame,
    news: DataFrame,
) -> DataFrame:
    """Institutions with their bags: the one join tree all passes read."""
    need = [
        "id", "type", "in_scope", "website", "general_email", "head_email", "source", "apprenticeship_standards",
    ]
    df = institutions.select(*need).withColumnRenamed("id", "institution_id")
    for bag in (
        inspection_meta(inspections, LATEST),
        finding_bag(findings, matches),
        notice_bag(notices),
        news_bag(news),
    ):
        df = df.join(bag, "institution_id", "left")
    return df


def score_inspected(base: DataFrame, as_of: str) -> DataFrame:
    """In-scope institutions with an inspection on file."""
    df = base.where(F.col("in_scope") & F.col("latest").isNotNull())
    df = df.withColumns({c: F.col(f"latest.{c}") for c in LATEST if c != "id"})
    for step in (
        judgement_part, finding_part, sub_scores, hard_floors, explain_signals, notice_floor, news_boost, synergy,
        lead_curriculum,
    ):
        df = step(df)
    df = pipeline_value(df, as_of)
    urgency, value = F.col("top_curriculum_score"), F.col("pipeline_value_score")
    named = F.transform("pipeline_signals", lambda s: F.concat(F.lit("Pipeline: "), s))
    df = df.withColumns(
        {
            "score": headline(urgency, value, F.col("overall_grade")),
            "urgency_score": urgency,
            "raw_score": sum((F.col(s) for s in SUB.values()), F.lit(0)),
            "critical_signals": F.when(
                value > urgency, F.concat("signals", F.array_except(named, "signals"))
            ).otherwise(F.col("signals")),
            "top_curriculum": F.when(
                (value > urgency) & F.col("top_curriculum").isNull(), "employability_skills"
            ).otherwise(F.col("top_curriculum")),
            "tier": tier(urgency, value),
            "finding_count": F.coalesce("finding_count", F.lit(0)),
            "last_inspection_id": F.col("latest.id"),
        }
    )
    # A plain filter would be pushed through every projection above, copying
    # all their expressions into the condition; a generator is not crossed.
    keep = (F.col("score") >= 1) | (F.size("critical_signals") > 0)
    kept = df.select(F.inline_outer(F.when(keep, F.array(F.struct(*SCORE_COLUMNS)))))
    return kept.where(F.col("institution_id").isNotNull())


def score_uninspected(base: DataFrame, as_of: str) -> DataFrame:
    """Providers without any inspection: pipeline value, notices and news."""
    df = base.where(F.col("in_scope") & F.col("latest").isNull() & F.col("type").isin(*UNINSPECTED_TYPES))
    # These types always have a pipeline value (the base alone is 35), so the
    # rule "at least 1" never drops a row.
    df = with_top_news(pipeline_value(df, as_of))
    floor = F.coalesce(
        _int(F.greatest(F.lit(0), half_up(F.col("worst_severity") * F.lit(NOTICE_FACTOR)))), F.lit(0)
    )
    lead = F.col("news_lead")
    notice_texts = F.transform("top_notices", lambda n: F.concat(F.lit("Compliance: "), n["subject"]))
    aux = F.concat(
        F.coalesce(notice_texts, _no_strings()),
        F.when(lead.isNotNull(), F.array(_headline_text(lead, 100))).otherwise(_no_strings()),
    )
    df = df.withColumns({"__floor": floor, "__aux": aux})
    df = df.withColumns(
        {
            **{SUB[c]: F.greatest("__floor", _news_lift(c)) for c in CURRICULA},
            "urgency_score": F.greatest("__floor", "news_urgency"),
        }
    )
    df = lead_curriculum(df)
    value, urgency = F.col("pipeline_value_score"), F.col("urgency_score")
    named = F.transform("pipeline_signals", lambda s: F.concat(F.lit("Pipeline: "), s))
    return df.withColumns(
        {
            "score": headline(urgency, value, F.lit(None).cast("string")),
            "raw_score": F.lit(0),
            SUB["employability_skills"]: F.greatest(F.col(SUB["employability_skills"]), value),
            "top_curriculum": F.coalesce("top_curriculum", F.lit("employability_skills")),
            "top_curriculum_score": F.greatest("top_curriculum_score", value),
            "top_finding_id": F.lit(None).cast("bigint"),
            "critical_signals": F.concat(
                F.when(F.size("__aux") > 0, F.col("__aux")).otherwise(F.array(F.lit(NO_SIGNAL))), named
            ),
            "tier": tier(urgency, value),
            "finding_count": F.lit(0).cast("bigint"),
            "inspection_count": F.coalesce("inspection_count", F.lit(0)),
            "last_inspection_id": F.lit(None).cast("bigint"),
        }
    ).select(*SCORE_COLUMNS)


def score_employers(institutions: DataFrame) -> DataFrame:
    """Fixed buyer-fit scores of in-scope employers, by provenance."""
    commissioner = F.coalesce(F.col("source") == "skills_bootcamps", F.lit(False))

    def fixed(c: str) -> Column:
        return F.when(commissioner, COMMISSIONER_SCORES[c]).otherwise(EMPLOYER_SCORES[c])

    def texts(values: list[str]) -> Column:
        return F.array(*[F.lit(v) for v in values])

    signals = F.when(commissioner, texts(COMMISSIONER_SIGNALS)).otherwise(texts(EMPLOYER_SIGNALS))
    no_site = F.when(present(F.col("website")), _no_strings()).otherwise(F.array(F.lit(NO_WEBSITE_SIGNAL)))
    df = institutions.where((F.col("type") == "employer") & F.col("in_scope"))
    df = df.select(F.col("id").alias("institution_id"), "source", "website").withColumns(
        {SUB[c]: fixed(c) for c in CURRICULA}
    )
    lead = F.col(SUB["employability_skills"])
    return df.withColumns(
        {
            "score": lead,
            "urgency_score": F.lit(0),
            "pipeline_value_score": F.lit(0),
            "raw_score": sum((F.col(s) for s in SUB.values()), F.lit(0)),
            "top_curriculum": F.lit("employability_skills"),
            "top_curriculum_score": lead,
            "top_finding_id": F.lit(None).cast("bigint"),
            "critical_signals": F.concat(signals, no_site),
            "tier": tier(lead, F.lit(0)),
            "finding_count": F.lit(0).cast("bigint"),
            "inspection_count": F.lit(0).cast("bigint"),
            "first_inspection_date": F.lit(None).cast("string"),
            "latest_inspection_date": F.lit(None).cast("string"),
            "last_inspection_id": F.lit(None).cast("bigint"),
        }
    ).select(*SCORE_COLUMNS)


def combine_scores(inspected: DataFrame, uninspected: DataFrame, employers: DataFrame) -> DataFrame:
    """One row per institution: employer over inspected over uninspected.

    The first two passes are disjoint. An employer row replaces only the
    columns it owns; urgency, pipeline value and history of an earlier row stay.
    """
    prior = inspected.unionByName(uninspected)
    return upsert(prior, employers, ["institution_id"], overwrite=EMPLOYER_OVERWRITES)


def opportunity_scores(
    institutions: DataFrame,
    inspections: DataFrame,
    findings: DataFrame,
    matches: DataFrame,
    notices: DataFrame,
    news: DataFrame,
    as_of: str,
) -> DataFrame:
    """The whole mart as of a day."""
    # Written once: both passes read the bags, and neither plans the join tree.
    base = cut_lineage(score_base(institutions, inspections, findings, matches, notices, news), "score-base")
    return combine_scores(
        score_inspected(base, as_of), score_uninspected(base, as_of), score_employers(institutions)
    )
