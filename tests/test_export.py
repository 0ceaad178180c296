"""The wide export: foreign rows looked up by ids alone, and the same rows as plain joins."""

from pyspark.sql import functions as F

from tierline.operators.joins import with_top_finding
from tierline.plans import Tables
from tierline.plans.lists import _answered, _asked, opportunity_export
from tierline.session import cut_lineage

TEXTS = "name type region local_authority postcode ukprn urn head_name head_email general_email phone website".split()


def made(spark):
    """Institution 2 comes twice, with two scored inspections; inspection 21 and finding 32 come twice; 9 has no facts."""
    inst = spark.createDataFrame([(i,) for i in (1, 2, 2, 3, 9)], "id long").select("id", *[F.concat(F.lit(c[0]), "id").alias(c) for c in TEXTS])
    scores = [(1, 20, 31, 5), (2, 21, 32, 7), (2, 22, None, 6), (3, None, 33, 4), (9, 99, 98, 1), (8, 20, 31, 9)]
    scores = spark.createDataFrame(scores, "institution_id long, last_inspection_id long, top_finding_id long, score int").select(
        "*", F.array(F.lit("a")).alias("critical_signals"), F.lit("itp").alias("top_curriculum"), F.lit("high").alias("tier"), F.lit(3).alias("finding_count"),
        *[F.lit(2).alias(c) for c in ("urgency_score", "pipeline_value_score", "raw_score", "top_curriculum_score")],
    )
    rows = [(20, 1, "good"), (21, 2, "inadequate"), (21, 2, "outstanding"), (22, 2, None), (23, 3, "good"), (None, 3, "good")]
    insp = spark.createDataFrame(rows, "id long, institution_id long, overall_grade string").select(
        "*", F.lit("good").alias("previous_overall_grade"), F.lit(True).alias("grade_dropped"), F.lit("2001-01-01").alias("inspection_start_date"), F.concat(F.lit("u"), "id").alias("report_url")
    )
    rows = [(31, "p1"), (32, "p2"), (32, "p3"), (33, "p4"), (34, "p5"), (None, "p6")]
    findings = spark.createDataFrame(rows, "id long, phrase_id string").select("*", F.lit("s").alias("section_key"), F.concat(F.lit("q"), "id").alias("source_quote"))
    notices = spark.createDataFrame([(1, 1, 40), (2, 1, 50), (3, 2, 60)], "id long, institution_id long, severity int").select(
        "*", F.lit(None).cast("string").alias("withdrawn_at"), F.concat(F.lit("n"), "id").alias("subject"), F.lit("u").alias("source_url")
    )
    news = spark.createDataFrame([(1, 2, 40, 60)], "id long, institution_id long, trigger_severity int, relevance int").select(
        "*", *[F.lit(c).alias(c) for c in ("title", "curricula_tagged", "angle", "url")]
    )
    parts = {"institutions": inst, "scores": scores, "inspections": insp, "findings": findings, "notices": notices, "news": news}
    return Tables(**{name: cut_lineage(df, name) for name, df in parts.items()})


def bag(df):
    return sorted(map(str, df.collect()))


def test_lookups_are_plain_left_joins(spark):
    t = made(spark)
    rows = t.scored().select("id", "score", "last_inspection_id", "top_finding_id")
    insp = t.inspections.select(F.col("id").alias("last_inspection_id"), "overall_grade")
    plain = with_top_finding(rows.join(insp, "last_inspection_id", "left"), t.findings)
    full = _answered(rows, _asked(rows, "last_inspection_id").join(insp, "last_inspection_id"), "last_inspection_id")
    full = _answered(full, with_top_finding(_asked(rows, "top_finding_id"), t.findings, "inner"), "top_finding_id")
    assert bag(full.select(*plain.columns)) == bag(plain)
    assert plain.count() == 13


def exchanged(node):
    """The columns that each exchange of a plan sends, by its kind."""
    children = node.children()
    below = [x for i in range(children.size()) for x in exchanged(children.apply(i))]
    if node.nodeName() != "Exchange":
        return below
    sent = node.output()
    kind = node.outputPartitioning().toString().split("(")[0]
    return [(kind, {sent.apply(i).name() for i in range(sent.size())}), *below]


def test_wide_rows_are_dealt_out_once_and_sorted(spark):
    own = spark.newSession()
    for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"):
        own.conf.set(key, "-1")
    out = opportunity_export(made(own))
    sent = exchanged(out._jdf.queryExecution().executedPlan().initialPlan())
    assert sorted(kind for kind, columns in sent if "local_authority" in columns) == ["hashpartitioning", "rangepartitioning"]
    assert [(r.name, r.score, r.current_grade, r.top_weakness_phrase) for r in out.collect()][-3:] == [
        ("n1", 5, "Good", "p1"), ("n3", 4, "—", "p4"), ("n9", 1, "—", ""),
    ]
