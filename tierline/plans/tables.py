"""The tables a report reads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Tables:
    institutions: DataFrame
    inspections: DataFrame | None = None
    sections: DataFrame | None = None
    findings: DataFrame | None = None
    matches: DataFrame | None = None
    notices: DataFrame | None = None
    news: DataFrame | None = None
    scores: DataFrame | None = None
    runs: DataFrame | None = None

    def scored(self, how: str = "inner") -> DataFrame:
        """Institutions joined to their score row (key column ``id``)."""
        return self.institutions.join(self.scores.withColumnRenamed("institution_id", "id"), "id", how)

    def evidence(self) -> tuple[DataFrame, DataFrame, DataFrame]:
        return self.inspections, self.notices, self.news
