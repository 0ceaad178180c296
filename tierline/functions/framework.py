"""Which inspection framework applies, and its display fields as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grades import grade_label

# ---- fixed values: framework -> [(group, [(column, label, note)])] ---------
_HARD_FLOOR = "Online Safety (hard floor)"
FRAMEWORK_FIELDS = {
    "school_eif": [
        ("Headline", [
            ("overall_grade", "Overall effectiveness", None),
            ("safeguarding_effective", "Safeguarding", "Online Safety"),
        ]),
        ("Sub-judgements", [
            ("quality_of_education", "Quality of education", None),
            ("behaviour_attitudes", "Behaviour and attitudes", "Confidence & Resilience"),
            ("personal_development", "Personal development",
             "Confidence & Resilience · Financial Literacy · Employability"),
            ("leadership_management", "Leadership and management", None),
            ("sixth_form_provision", "Sixth form provision", "Employability Skills"),
        ]),
    ],
    "school_report_card": [
        ("Safeguarding", [("safeguarding_effective", "Safeguarding standards", _HARD_FLOOR)]),
        ("Thematic standards", [
            ("personal_dev_wellbeing", "Personal development and wellbeing",
             "Confidence & Resilience · Financial Literacy · Employability"),
            ("attendance_behaviour", "Attendance and behaviour", "Confidence & Resilience"),
            ("inclusion", "Inclusion", "Confidence & Resilience"),
            ("curriculum_teaching", "Curriculum and teaching", None),
            ("achievement", "Achievement", "Employability Skills"),
        ]),
    ],
    "fe_skills": [
        ("Headline", [
            ("overall_grade", "Overall effectiveness", None),
            ("safeguarding_effective", "Safeguarding standards", _HARD_FLOOR),
        ]),
        ("Common judgements", [
            ("quality_of_education", "Quality of education", None),
            ("behaviour_attitudes", "Behaviour and attitudes", "Confidence & Resilience"),
            ("personal_development", "Personal development",
             "Confidence & Resilience · Financial Literacy · Employability"),
            ("leadership_management", "Leadership and management", None),
            ("contribution_to_skills", "Contribution to meeting skills needs", "Employability Skills"),
        ]),
        ("Provision-type judgements", [
            ("young_peoples_provision", "Education programmes for young people (16–19)",
             "Employability Skills · Confidence & Resilience"),
            ("apprenticeships", "Apprenticeships", "Employability Skills (hard floor)"),
            ("adult_learning_programmes", "Adult learning programmes",
             "Financial Literacy · Employability Skills"),
            ("high_needs_provision", "Provision for learners with high needs",
             "Confidence & Resilience · Employability"),
        ]),
    ],
    "isi": [
        ("Headline", [
            ("overall_grade", "Overall outcome", None),
            ("safeguarding_effective", "Safeguarding (ISS Part 3)", _HARD_FLOOR),
        ]),
        ("Educational quality + personal development", [
            ("personal_development", "Personal development", "Confidence & Resilience"),
            ("quality_of_education", "Educational quality (achievement)", None),
        ]),
    ],
    "employer": [
        ("ICP signal", [
            (None, "Listed on APAR as Employer-Provider", "Employability Skills (lead) · Confidence & Resilience"),
        ]),
    ],
}
REPORT_CARD_FIELDS = [
    "inclusion", "attendance_behaviour", "personal_dev_wellbeing", "achievement", "curriculum_teaching",
]
FE_TYPES = ["itp", "fe_college", "sixth_form_college"]
# ---------------------------------------------------------------------------


def framework_for(body: Column, institution_type: Column, has_report_card: Column) -> Column:
    return (
        F.when(institution_type == "employer", "employer")
        .when(body == "isi", "isi")
        .when(institution_type.isin(*FE_TYPES), "fe_skills")
        .when(has_report_card, "school_report_card")
        .otherwise("school_eif")
    )


def has_report_card_grades(df: DataFrame) -> Column:
    return F.coalesce(*[F.col(c) for c in REPORT_CARD_FIELDS]).isNotNull()


def framework_rows(df: DataFrame, framework: str = "framework_key", keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """One row per display field of the framework that applies to each inspection.

    The field lists are literals, so this is a projection and an explode: no
    join and no exchange.
    """

    def value(column: str | None) -> Column:
        if column is None:
            return F.lit(None).cast("string")
        if column == "safeguarding_effective":
            return F.when(F.col(column), "Met").when(~F.col(column), "Not met")
        return F.when(F.col(column).isNotNull(), grade_label(F.col(column)))

    per_framework: Column | None = None
    for key, groups in FRAMEWORK_FIELDS.items():
        fields = [(g, *f) for g, fs in groups for f in fs]
        rows = F.array(
            *[
                F.struct(
                    F.lit(i).alias("position"),
                    F.lit(group).alias("field_group"),
                    F.lit(column or "_apar").alias("field"),
                    F.lit(label).alias("label"),
                    F.lit(note).cast("string").alias("note"),
                    value(column).alias("value"),
                )
                for i, (group, column, label, note) in enumerate(fields)
            ]
        )
        cond = F.col(framework) == key
        per_framework = F.when(cond, rows) if per_framework is None else per_framework.when(cond, rows)
    return df.select(*keep, framework, F.inline(per_framework))
