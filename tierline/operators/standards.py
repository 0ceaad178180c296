"""Independent-school standards: lines, grades and their application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import lookup, non_blank, portable, squeeze

# ---- fixed values ---------------------------------------------------------
STANDARD_LINE = r"(?i)Standards?\s+relating\s+to\s+([^.]+?)\s+are\s+(not\s+met|met)\b"
SAFETY_AREA = r"(?i)welfare|safeguard|child protection|health and safety"
DEVELOPMENT_AREA = (
    r"(?i)physical and mental health|emotional wellbeing|spiritual|moral|social and cultural|smsc"
    r"|personal\s*(?:and|,|\z)\s*social"
)
EDUCATION_AREA = r"(?i)quality of education|teaching and recreation|education,?\s*training"
LEADERSHIP_AREA = r"(?i)leadership|management|governance"
ALL_NOT_MET = (
    r"(?i)the school does not meet (?:all )?the (?:relevant )?standards"
    r"|(?:there are areas of|some areas of) non.?compliance|standards have not been met"
)
ALL_MET = (
    r"(?i)the school meets all (?:the )?(?:relevant )?standards|all (?:the )?(?:relevant )?standards are met"
)
DEVELOPMENT_WORD = r"(?i)personal development\s+(?:of pupils\s+)?is\s+(excellent|good|sound|unsatisfactory)"
ACHIEVEMENT_WORD = (
    r"(?i)(?:the\s+(?:quality of pupils['’]?\s+)?achievement(?:\s+of pupils)?\s+is\s+|achievement is\s+)"
    r"(excellent|good|sound|unsatisfactory)"
)
QUALITY_WORDS = {
    "excellent": "outstanding",
    "good": "good",
    "sound": "requires_improvement",
    "unsatisfactory": "inadequate",
}
MET, NOT_MET = "meets_standard", "does_not_meet_standard"
# ---------------------------------------------------------------------------

def standards_lines(text: Column) -> Column:
    """array<struct(area, outcome)> of a text, without repeats."""
    areas = F.regexp_extract_all(text, F.lit(portable(STANDARD_LINE)), F.lit(1))
    outcomes = F.regexp_extract_all(text, F.lit(portable(STANDARD_LINE)), F.lit(2))
    return F.array_distinct(
        F.zip_with(
            areas,
            outcomes,
            lambda a, o: F.struct(
                F.lower(squeeze(a)).alias("area"),
                F.when(o.rlike("(?i)^not"), "not_met").otherwise("met").alias("outcome"),
            ),
        )
    )


def extract_standards(df: DataFrame, text: str, keep: tuple[str, ...] = ("inspection_id",)) -> DataFrame:
    lines = df.select(*keep, F.posexplode_outer(standards_lines(F.col(text))).alias("position", "l"))
    return lines.where(F.col("position").isNotNull()).select(*keep, "position", "l.*")


def grade_columns(text: Column, lines: Column) -> dict[str, Column]:
    """Grades that a text and its standards lines give, null where silent."""

    def some(area: str, outcome: str) -> Column:
        return F.exists(lines, lambda s: s["area"].rlike(portable(area)) & (s["outcome"] == outcome))

    def worst(area: str) -> Column:
        return F.when(some(area, "not_met"), NOT_MET).when(some(area, "met"), MET)

    def word(pattern: str) -> Column:
        return lookup(non_blank(F.lower(F.regexp_extract(text, portable(pattern), 1))), QUALITY_WORDS)

    return {
        "safeguarding_effective": F.when(some(SAFETY_AREA, "not_met"), False).when(some(SAFETY_AREA, "met"), True),
        "personal_development": F.coalesce(worst(DEVELOPMENT_AREA), word(DEVELOPMENT_WORD)),
        "quality_of_education": F.coalesce(worst(EDUCATION_AREA), word(ACHIEVEMENT_WORD)),
        "leadership_management": worst(LEADERSHIP_AREA),
        "overall_grade": F.when(text.rlike(ALL_NOT_MET), NOT_MET)
        .when(text.rlike(ALL_MET), MET)
        .when(F.exists(lines, lambda s: s["outcome"] == "not_met"), NOT_MET)
        .otherwise(MET),
    }


def map_standards(df: DataFrame, text: str, keep: tuple[str, ...] = ("inspection_id",)) -> DataFrame:
    """One row of grades per text that has at least one standards line.

    The lines belong to one text, so the fold runs on its array: no exchange.
    """
    lined = df.select(*keep, F.col(text).alias("__text"), standards_lines(F.col(text)).alias("__lines"))
    grades = grade_columns(F.col("__text"), F.col("__lines"))
    return lined.where(F.size("__lines") > 0).select(
        *keep, F.size("__lines").alias("standards"), *[c.alias(name) for name, c in grades.items()]
    )


def update_isi_grades(inspections: DataFrame) -> DataFrame:
    """Grades read from the texts of independent-school inspections applied.

    A grade the text does not give keeps its old value. Target and source are
    the same rows, so the upsert is a projection.
    """
    lined = inspections.withColumn(
        "__lines", F.when(F.col("inspection_body") == "isi", standards_lines(F.col("report_text")))
    )
    grades = grade_columns(F.col("report_text"), F.col("__lines"))
    found = F.size("__lines") > 0
    return lined.select(
        *[
            F.coalesce(F.when(found, grades[c]), F.col(c)).alias(c) if c in grades else F.col(c)
            for c in inspections.columns
        ]
    )
