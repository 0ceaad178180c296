"""Email templates: one Markdown file per curriculum."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .whole import read_whole


def read_templates(spark: SparkSession, folder: str) -> dict[str, str]:
    """Curriculum -> template; ``online-safety.md`` is the template of ``online_safety``."""
    return {name.removesuffix(".md").replace("-", "_"): text for name, text in read_whole(spark, folder, "*.md")}
