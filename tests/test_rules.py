"""Column rules on small inline rows."""

import pytest
from pyspark.sql import functions as F

from tierline import functions as fn


def _map(spark, values, fun):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fun(F.col("x")).alias("y")).orderBy("i").collect()]


def test_grades(spark):
    raw = ["1", "Grade 2", "Requires Improvement", "RI", "Special measures", "Strong standard", "Urgent improvement", "Not met", "NULL", "Satisfactory", None]
    want = ["outstanding", "good", "requires_improvement", "requires_improvement", "inadequate", "good", "inadequate", "does_not_meet_standard", None, None, None]
    assert _map(spark, raw, fn.normalise_grade) == want


def test_dates_are_not_checked_against_the_calendar(spark):
    raw = ["2024-03-01T00:00", "1/2/2024", "01-02-2024", "5 September 2023", "31/02/2024", "soon", ""]
    want = ["2024-03-01", "2024-02-01", "2024-02-01", "2023-09-05", "2024-02-31", None, None]
    assert _map(spark, raw, fn.parse_inspection_date) == want


def test_name_keys(spark):
    raw = ["The Acme Group Ltd", "Acme trading as Best Co", "Acme t/a Best", "Acme trading as Best\nnext line"]
    assert _map(spark, raw, lambda c: fn.norm_name(c, "notice")) == ["acme", "acme", "acme t best", "acme trading as best next line"]
    assert _map(spark, raw[1:3], lambda c: fn.norm_name(c, "dedup")) == ["acme best co", "acme best"]
    assert _map(spark, ["St. Mary's School & College"], fn.norm_school_name) == ["marys"]


def test_non_ascii_word_edges(spark):
    assert _map(spark, ["àthe b"], lambda c: fn.norm_name(c, "notice")) == ["b"]


@pytest.mark.parametrize(
    "text,want",
    [
        ('{"relevance": 120, "trigger_severity": "33.5", "curricula_tagged": " a ", "angle": 3} tail {"x"', (100, 34, "a", "no angle")),
        ("no json", None),
    ],
)
def test_signal_json(spark, text, want):
    got = _map(spark, [text], fn.parse_signal_json)[0]
    assert (None if got is None else tuple(got)) == want


def test_reports_urls_and_contacts(spark):
    assert _map(spark, ["https://www.Inst.ac.uk/x"], fn.base_domain) == ["inst.ac.uk"]
    emails = F.array(F.lit("sam@inst.ac.uk"), F.lit("INFO@inst.ac.uk"), F.lit("info@other.com"))
    assert spark.range(1).select(fn.best_email(emails, F.lit("inst.ac.uk"))).first()[0] == "info@inst.ac.uk"


def test_render_email_does_not_merge_values_twice(spark):
    ctx = spark.createDataFrame([("A {{region}}", "North", "c")], "institution_name string, region string, top_curriculum string")
    tpl = spark.createDataFrame([("c", "Subject: Hi {{institution_name}}\n\nIn {{region}}, {{head_name}} {{x}}")], "curriculum string, template string")
    r = fn.render_email(ctx, tpl).first()
    assert r.subject == "Hi A {{region}}" and r.body == "In North, there [x]"
