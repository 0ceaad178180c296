"""Company-profile and insolvency payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.notices import COMPANY_SEVERITY, company_notices, severity_for
from ..schemas import COMPANY_PROFILE, INSOLVENCY

COMPANY_PAGE = "https://find-and-update.company-information.service.gov.uk/company/"


def parse_company_profile(df: DataFrame, profile: str = "profile", insolvency: str = "insolvency") -> DataFrame:
    """JSON text columns -> ``profile`` struct and ``insolvency_cases`` count."""
    cases = F.size(F.from_json(F.col(insolvency), INSOLVENCY)["cases"])
    return df.withColumns(
        {
            profile: F.from_json(F.col(profile), COMPANY_PROFILE),
            "insolvency_cases": F.when(cases > 0, cases),
        }
    ).drop(insolvency)


def company_notice_rows(parsed: DataFrame, as_of: str, institution: str = "institution_id") -> DataFrame:
    """Parsed profiles -> 0..n notice rows each."""
    p = F.col("profile")
    detail = F.concat(
        F.lit("Company "),
        p["company_name"],
        F.lit(" ("),
        p["company_number"],
        F.lit(") status="),
        p["company_status"],
        F.coalesce(F.concat(F.lit(" detail="), F.when(p["company_status_detail"] != "", p["company_status_detail"])), F.lit("")),
    )
    return parsed.select(
        institution,
        F.lit("companies_house").alias("notice_body"),
        F.lit(as_of).alias("issued_at"),
        detail.alias("details"),
        F.concat(F.lit(COMPANY_PAGE), p["company_number"]).alias("source_url"),
        F.inline(company_notices(p, F.col("insolvency_cases"))),
    ).withColumn("severity", severity_for(F.col("notice_type"), COMPANY_SEVERITY))
