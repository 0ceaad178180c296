"""Anchors and the facts carried by report links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grades import normalise_grade, parse_inspection_date
from .markup import elements
from .text import lookup, non_blank, squeeze, strip

# ---- fixed values ---------------------------------------------------------
REPORT_CODES = {
    "EQI": "Educational Quality Inspection",
    "FCI": "Focused Compliance Inspection",
    "ADD": "Additional Inspection",
    "GRT": "Integrated Inspection",
    "REG": "Regulatory Compliance",
    "ROU": "Routine Inspection",
    "IRD": "Initial Registration",
    "PRG": "Progress Monitoring",
    "PMV": "Progress Monitoring Visit",
    "EFD": "Early Findings Visit",
    "STD": "Standard Inspection",
    "FND": "Findings Update",
}
SCHOOL_REPORT_PAGE = r"(?i)reports\.isi\.net/DownloadReport\.aspx"
SCHOOL_REPORT_HOST = "https://reports.isi.net"
REPORT_FILE = r"(?i)r=([A-Z]{2,4})([0-9]+)_([0-9]{8})\.pdf"
PROVIDER_FILE = r"(?i)files\.ofsted\.gov\.uk/v1/file/"
ANY_REPORT_FILE = r"(?i)files\.ofsted\.gov\.uk/v1/file/|\.pdf(?:\?|\z)"
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
LINK_DATE = rf"(?i)([0-9]{{1,2}}\s+(?:{MONTHS})[a-z]*\s+[0-9]{{4}})"
REPORT_LINK_DATE = rf"([0-9]{{1,2}}\s+(?:{MONTHS})[A-Za-z]*\s+[0-9]{{4}}|[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}})"
LINK_TYPE = (
    r"(?i)(Full inspection|School inspection|Short inspection|Monitoring visit|Section 5|Section 8|Survey visit"
    r"|Graded inspection|Ungraded inspection|Standard inspection|Progress monitoring)"
)
LINK_GRADE = (
    r"(?i):\s*(Outstanding|Good|Requires Improvement|Inadequate|Special measures|Serious weaknesses|Satisfactory)"
)
FULL_INSPECTION = r"(?i)full inspection|school inspection|graded inspection|standard inspection"
# ---------------------------------------------------------------------------

def anchors(html: Column) -> Column:
    """array<struct(href, text)> of a page's links, in page order; see :mod:`markup` for loose markup."""
    linked = F.filter(elements(html, ["a"]), lambda e: e["href"].isNotNull())
    return F.transform(linked, lambda e: F.struct(e["href"].alias("href"), squeeze(e["text"]).alias("text")))


def parse_report_url(href: Column) -> Column:
    """struct(url, code, report_date, inspection_type) of a school report link, else null."""
    code = F.regexp_extract(href, REPORT_FILE, 1)
    stamp = F.regexp_extract(href, REPORT_FILE, 3)
    rooted = F.when(href.startswith("/"), href).otherwise(F.concat(F.lit("/"), href))
    return F.when(
        href.rlike(SCHOOL_REPORT_PAGE) & href.rlike(REPORT_FILE),
        F.struct(
            F.when(href.startswith("http"), href).otherwise(F.concat(F.lit(SCHOOL_REPORT_HOST), rooted)).alias("url"),
            F.upper(code).alias("code"),
            F.concat_ws("-", F.substring(stamp, 1, 4), F.substring(stamp, 5, 2), F.substring(stamp, 7, 2)).alias(
                "report_date"
            ),
            F.coalesce(lookup(F.upper(code), REPORT_CODES), F.concat(code, F.lit(" inspection"))).alias(
                "inspection_type"
            ),
        ),
    )


def parse_link_text(text: Column) -> Column:
    """struct(date, inspection_type, grade) of a provider-page link text."""
    kind = non_blank(F.regexp_extract(text, LINK_TYPE, 1))
    return F.struct(
        parse_inspection_date(non_blank(F.regexp_extract(text, LINK_DATE, 1))).alias("date"),
        F.coalesce(kind, strip(F.substring_index(text, ",", 1))).alias("inspection_type"),
        normalise_grade(non_blank(F.regexp_extract(text, LINK_GRADE, 1))).alias("grade"),
    )
