"""Grades, dates, booleans and judgement synthesis."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import capitalise, lookup, strip

# ---- fixed values ---------------------------------------------------------
DIGIT_GRADES = {"1": "outstanding", "2": "good", "3": "requires_improvement", "4": "inadequate"}
LABEL_GRADES = {
    "outstanding": "outstanding",
    "good": "good",
    "requires improvement": "requires_improvement",
    "requires_improvement": "requires_improvement",
    "ri": "requires_improvement",
    "inadequate": "inadequate",
    "serious weaknesses": "inadequate",
    "special measures": "inadequate",
    "exceptional": "outstanding",
    "strong standard": "good",
    "strong": "good",
    "expected standard": "good",
    "expected": "good",
    "needs attention": "requires_improvement",
    "urgent improvement": "inadequate",
    "met": "meets_standard",
    "not met": "does_not_meet_standard",
}
UNGRADED_LABELS = ["no formal designation", "not graded"]
FOUR_GRADE_RANK = {"outstanding": 1, "good": 2, "requires_improvement": 3, "inadequate": 4}
SIX_GRADE_RANK = {
    "outstanding": 1,
    "good": 2,
    "meets_standard": 2,
    "requires_improvement": 3,
    "inadequate": 4,
    "does_not_meet_standard": 4,
}
URGENCY = {
    "inadequate": 1.0,
    "does_not_meet_standard": 1.0,
    "requires_improvement": 0.72,
    "meets_standard": 0.0,
    "good": -0.1,
    "outstanding": -0.3,
}
LONG_LABELS = {
    "outstanding": "Outstanding",
    "good": "Good",
    "requires_improvement": "Requires improvement",
    "inadequate": "Inadequate",
    "meets_standard": "Meets the standard",
    "does_not_meet_standard": "Does not meet the standard",
    "not_judged": "Not judged",
}
SHORT_LABELS = LONG_LABELS | {"meets_standard": "Met", "does_not_meet_standard": "Not met"}
MONTH_NUMBERS = {
    "jan": "01", "feb": "02", "mar": "03", "apr": "04", "may": "05", "jun": "06",
    "jul": "07", "aug": "08", "sep": "09", "oct": "10", "nov": "11", "dec": "12",
}
DASH = "—"
# ---------------------------------------------------------------------------


def normalise_grade(col: Column) -> Column:
    """Any grade spelling -> one of seven canonical values, or null."""
    s = strip(col)
    digit = strip(F.regexp_replace(s, r"(?i)^grade\s*", ""))
    low = F.lower(s)
    return (
        F.when(s.isin("", "NULL"), None)
        .when(digit.isin(*DIGIT_GRADES), lookup(digit, DIGIT_GRADES))
        .when(low.isin(*LABEL_GRADES), lookup(low, LABEL_GRADES))
        .when(low.contains("meets the standard") | low.contains("meets standard"), "meets_standard")
        .when(low.contains("does not meet") | low.startswith("not met"), "does_not_meet_standard")
        .when(low.isin(*UNGRADED_LABELS), "not_judged")
    )


def grade_urgency(col: Column) -> Column:
    return F.coalesce(lookup(col, URGENCY), F.lit(0.0))


def is_grade_drop(current: Column, previous: Column) -> Column:
    """True when the four-grade rank got worse; unknown grades give false."""
    return F.coalesce(lookup(current, FOUR_GRADE_RANK) > lookup(previous, FOUR_GRADE_RANK), F.lit(False))


def grade_label(col: Column) -> Column:
    return F.when(col.isNull() | (col == ""), DASH).otherwise(lookup(col, LONG_LABELS, col))


def pretty_grade(col: Column) -> Column:
    return lookup(col, SHORT_LABELS, col)


def title_label(col: Column) -> Column:
    """snake_case -> Title Words, dash when there is none."""
    words = F.transform(F.split(col, "_"), capitalise)
    return F.when(col.isNull() | (col == ""), DASH).otherwise(F.array_join(words, " "))


def parse_inspection_date(col: Column) -> Column:
    """Messy date -> ISO text. The calendar is not checked: 31/02/2024 passes."""
    s = strip(col)
    dmy = r"^([0-9]{1,2})%s([0-9]{1,2})%s([0-9]{4})\z"

    def built(pattern: str, month: Column) -> Column:
        return F.concat_ws(
            "-", F.regexp_extract(s, pattern, 3), month, F.lpad(F.regexp_extract(s, pattern, 1), 2, "0")
        )

    slash, dash = dmy % ("/", "/"), dmy % ("-", "-")
    named = r"^([0-9]{1,2})\s+([A-Za-z]+)\s+([0-9]{4})\z"
    month_no = lookup(F.lower(F.substring(F.regexp_extract(s, named, 2), 1, 3)), MONTH_NUMBERS)
    return (
        F.when(s.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.substring(s, 1, 10))
        .when(s.rlike(slash), built(slash, F.lpad(F.regexp_extract(s, slash, 2), 2, "0")))
        .when(s.rlike(dash), built(dash, F.lpad(F.regexp_extract(s, dash, 2), 2, "0")))
        .when(s.rlike(named) & month_no.isNotNull(), built(named, month_no))
    )


def parse_bool(col: Column) -> Column:
    s = F.lower(strip(col))
    return F.when(s.isin("yes", "y", "true", "1"), True).when(s.isin("no", "n", "false", "0"), False)


def synthesise_overall(stated: Column, *sub_judgements: Column) -> Column:
    """The stated grade, else the worst sub-judgement (first among equals)."""
    ranked = F.array(
        *[
            F.when(
                c.isin(*SIX_GRADE_RANK),
                F.struct(lookup(c, SIX_GRADE_RANK).alias("rank"), F.lit(-i).alias("pos"), c.alias("grade")),
            )
            for i, c in enumerate(sub_judgements)
        ]
    )
    return F.coalesce(stated, F.array_max(ranked)["grade"])


def safeguarding(effective: Column, standards: Column) -> Column:
    """Tri-state: the yes/no column first, then the exact Met / Not met words."""
    return F.coalesce(parse_bool(effective), F.when(standards == "Met", True).when(standards == "Not met", False))
