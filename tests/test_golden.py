"""Three worked scoring cases with known results."""


from pyspark.sql import functions as F

from tierline import schemas as S
from tierline.operators.scoring import opportunity_scores

AS_OF = "2026-05-01"


def _frame(spark, rows, schema):
    """Rows given as dicts; missing columns are null."""
    names = [f.split()[0] for f in schema.split(", ")]
    plain = schema.replace("decimal(38,0)", "bigint")
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], plain)
    wide = [f.split()[0] for f in schema.split(", ") if "decimal" in f]
    return df.withColumns({n: F.col(n).cast("decimal(38,0)") for n in wide})


def _score(spark, institution, inspections=(), findings=(), matches=(), notices=(), news=()):
    tables = [
        _frame(spark, [institution], S.INSTITUTIONS),
        _frame(spark, list(inspections), S.INSPECTIONS),
        _frame(spark, list(findings), S.FINDINGS),
        _frame(spark, list(matches), S.CURRICULUM_MATCHES),
        _frame(spark, list(notices), S.COMPLIANCE_NOTICES),
        _frame(spark, list(news), S.NEWS_ITEMS),
    ]
    rows = opportunity_scores(*tables, AS_OF).collect()
    assert len(rows) == 1
    return rows[0]


def _subs(r):
    return [r[f"{c}_score"] for c in S.CURRICULA]


def _inspections(n, latest_grade):
    return [
        {"id": i, "institution_id": 1, "inspection_body": "ofsted", "inspection_start_date": f"{2025 - 3 * i}-06-24",
         "overall_grade": latest_grade if i == 0 else "good"}
        for i in range(n)
    ]


BASE = {"id": 1, "in_scope": True, "source": "gias+apar", "website": "-", "general_email": "-"}


def test_good_grade_with_notice(spark):
    r = _score(
        spark,
        BASE | {"type": "itp", "apprenticeship_standards": 4},
        _inspections(6, "good"),
        notices=[{"id": 1, "institution_id": 1, "severity": 85, "subject": "S", "notice_body": "apar"}],
    )
    assert (r.score, r.urgency_score, r.pipeline_value_score, r.tier) == (75, 72, 100, "critical")
    assert _subs(r) == [72] * 4 and r.top_curriculum == "financial_literacy"
    assert r.critical_signals[0] == "Compliance: S"


def test_no_inspection_with_news(spark):
    tagged = "employability_skills, financial_literacy"
    news = [
        {"id": 1, "institution_id": 1, "title": "t", "trigger_severity": 85, "relevance": 90, "curricula_tagged": tagged, "angle": "a"},
        {"id": 2, "institution_id": 1, "title": "u", "trigger_severity": 72, "relevance": 80, "curricula_tagged": "", "angle": "b"},
    ]
    r = _score(spark, BASE | {"type": "fe_college", "apprenticeship_standards": 61}, news=news)
    assert (r.score, r.urgency_score, r.pipeline_value_score, r.tier) == (80, 77, 100, "critical")
    assert _subs(r) == [77, 100, 0, 0]
    assert (r.top_curriculum, r.top_curriculum_score) == ("financial_literacy", 100)
    assert r.critical_signals[0] == "News: a"


def test_findings_saturate(spark):
    plan = {"employability_skills": 7, "confidence_resilience": 7}
    findings, matches, n = [], [], 0
    for curriculum, count in plan.items():
        for _ in range(count):
            n += 1
            findings.append((n, 4.0, curriculum))
    findings += [(100 + i, 4.4, "online_safety") for i in range(3)]
    rows = [
        {"id": i, "inspection_id": 0, "institution_id": 1, "section_key": "what_provider_needs_to_improve", "final_severity": s, "suppressed": False}
        for i, s, _ in findings
    ]
    matches = [{"finding_id": i, "institution_id": 1, "curriculum": c, "weight": 1.0} for i, _, c in findings]
    r = _score(spark, BASE | {"type": "itp", "apprenticeship_standards": 17}, _inspections(10, "good"), rows, matches)
    assert (r.score, r.urgency_score, r.pipeline_value_score, r.tier) == (75, 55, 100, "high")
    assert _subs(r) == [0, 55, 55, 40] and r.top_curriculum == "employability_skills"
    assert r.finding_count == 17 and r.top_finding_id == 100
    assert "Pipeline: 10+ historical inspections (very established)" in r.critical_signals


def test_employer_keeps_earlier_urgency(spark):
    r = _score(spark, BASE | {"type": "employer", "source": "apar", "apprenticeship_standards": 0}, _inspections(1, "inadequate"))
    assert (r.score, r.tier, r.top_curriculum) == (78, "critical", "employability_skills")
    assert r.urgency_score == 75 and r.pipeline_value_score > 0 and r.inspection_count == 1
    assert _subs(r) == [45, 78, 55, 40]


def test_bounds(spark):
    many = [
        {"id": i, "institution_id": 1, "severity": 99, "subject": f"n{i}", "notice_body": "apar"} for i in range(50)
    ]
    r = _score(spark, BASE | {"type": "itp", "apprenticeship_standards": 60}, _inspections(3, "inadequate"), notices=many)
    assert all(0 <= s <= 100 for s in _subs(r))
    assert sum(s.startswith("Compliance: ") for s in r.critical_signals) == 3
