"""Mail-merge over curriculum templates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grades import grade_label
from .text import lookup, non_blank, replace_first, strip

# ---- fixed values ---------------------------------------------------------
MERGE_FIELDS = [
    "institution_name", "region", "inspection_date", "current_grade", "previous_grade",
    "top_weakness", "source_quote", "source_section", "report_url", "head_name",
]
GRADE_FIELDS = {"current_grade", "previous_grade"}
MISSING_HEAD = "there"
# ---------------------------------------------------------------------------
# Private-use marks around a field name: a merged value can never form one, so
# text that came in by a value is not merged a second time.
_OPEN, _CLOSE = "\ue000", "\ue001"


def _value(df: DataFrame, field: str) -> Column:
    col = F.col(field) if field in df.columns else F.lit(None).cast("string")
    if field in GRADE_FIELDS:
        return grade_label(col)
    default = MISSING_HEAD if field == "head_name" else f"[{field}]"
    return F.coalesce(non_blank(col.cast("string")), F.lit(default))


def render_email(df: DataFrame, templates: dict[str, str] | DataFrame, curriculum: str = "top_curriculum") -> DataFrame:
    """Add ``subject`` and ``body``; ``templates`` maps curricula to texts, or is a (curriculum, template) table.

    The few templates are constants of the plan: rows stay where they are,
    though four curricula share them all.
    """
    if isinstance(templates, DataFrame):
        templates = {r["curriculum"]: r["template"] for r in templates.select("curriculum", "template").collect()}
    joined = df.withColumn("__tpl", lookup(F.col(curriculum), templates) if templates else F.lit(None).cast("string"))
    merged = F.regexp_replace(F.col("__tpl"), r"\{\{\s*([a-z_]+)\s*\}\}", f"{_OPEN}$1{_CLOSE}")
    for field in MERGE_FIELDS:
        merged = F.replace(merged, F.lit(f"{_OPEN}{field}{_CLOSE}"), _value(df, field))
    merged = F.regexp_replace(merged, f"{_OPEN}([a-z_]+){_CLOSE}", "[$1]")
    out = joined.withColumn("__raw", merged)
    missing = F.col("__tpl").isNull()
    subject = strip(F.regexp_extract(F.col("__raw"), r"(?m)^Subject:\s*(.+)$", 1))
    body = strip(replace_first(F.col("__raw"), r"(?m)^Subject:\s*.+\n\n?"))
    return out.select(
        *df.columns,
        F.when(missing, F.concat(F.lit("(no template for "), F.col(curriculum), F.lit(")")))
        .otherwise(subject)
        .alias("subject"),
        F.when(missing, "").otherwise(body).alias("body"),
    )
