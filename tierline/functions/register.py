"""Register and inspection-file columns: aliases, scope, types, URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WS, lookup, non_blank, strip

# ---- fixed values ---------------------------------------------------------
MIN_HIGH_AGE = 14
SCOPED_PHASES = ["Secondary", "Middle deemed secondary", "All-through", "16 plus", "Not applicable"]
EXCLUDED_PHASES = ["Nursery", "Primary", "Middle deemed primary", "16-19"]
EXCLUDED_TYPES = [
    "Welsh comprehensive school",
    "Welsh establishment",
    "Higher education institutions",
    "Local authority adult education provision",
    "Children's centre",
    "Children's centre linked site",
    "Online provider",
    "Service children's education",
    "Miscellaneous",
]
INSTITUTION_TYPE_PATTERNS = [
    (r"independent\s+school", "independent_school"),
    (r"independent\s+special", "independent_school"),
    (r"sixth\s+form", "sixth_form_college"),
    (r"academy\s+16", "sixth_form_college"),
    (r"free\s+schools?\s+16", "sixth_form_college"),
    (r"further\s+education", "fe_college"),
]
REPORT_SITE = "https://reports.ofsted.gov.uk/provider"
FIRST_URL_CODE = {
    "state_school": 23,
    "independent_school": 21,
    "sixth_form_college": 46,
    "fe_college": 31,
    "itp": 33,
    "other": 23,
}
# ---------------------------------------------------------------------------


def header_key(name: str) -> str:
    """Header text reduced for matching: case and runs of blanks ignored."""
    return " ".join(name.replace("\ufeff", "").lower().split())


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def pick(df: DataFrame, *aliases: str, null_word: str | None = "NULL", loose: bool = True) -> Column:
    """First non-blank value among aliased columns of ``df``.

    ``loose`` matches headers ignoring case and runs of blanks; ``null_word``
    is a literal that counts as blank.
    """
    by_key = {(header_key(c) if loose else c): c for c in df.columns}
    found = [by_key[k] for k in ((header_key(a) if loose else a) for a in aliases) if k in by_key]
    blanks = [""] if null_word is None else ["", null_word]
    values = [F.when(~quoted(c).isin(*blanks), quoted(c)) for c in found]
    return F.coalesce(*values) if values else F.lit(None).cast("string")


def parse_age(col: Column) -> Column:
    """Leading integer, or null."""
    return non_blank(F.regexp_extract(col, rf"^{WS}*([+-]?[0-9]+)", 1)).try_cast("int")


def join_nonblank(separator: str, *cols: Column) -> Column:
    return non_blank(F.concat_ws(separator, *[non_blank(c) for c in cols]))


def classify_scope(status: Column, phase: Column, type_name: Column, high_age: Column) -> Column:
    """struct(in_scope, reason); the first failing rule in this order decides."""
    kind, stage = strip(type_name), strip(phase)
    low_age = high_age < MIN_HIGH_AGE
    reason = (
        F.when((status != "") & (status != "Open"), F.concat(F.lit("status="), status))
        .when(kind.isin(*EXCLUDED_TYPES), F.concat(F.lit("type="), kind))
        .when(stage.isin(*EXCLUDED_PHASES), F.concat(F.lit("phase="), stage))
        .when(
            low_age,
            F.concat(F.lit("high_age="), high_age.cast("string"), F.lit(f" < {MIN_HIGH_AGE} (no Year 9)")),
        )
        .when((stage != "") & ~stage.isin(*SCOPED_PHASES) & high_age.isNull(), F.concat(F.lit("phase="), stage))
    )
    return F.struct(reason.isNull().alias("in_scope"), reason.alias("reason"))


def map_institution_type(col: Column) -> Column:
    out = F.when(col.isNull(), "state_school")
    for pattern, mapped in INSTITUTION_TYPE_PATTERNS:
        out = out.when(col.rlike(f"(?i){pattern}"), mapped)
    return out.otherwise("state_school")


def map_register_type(application_type: Column) -> Column:
    """Approved-provider register: employer providers, else training providers."""
    return F.when(application_type.rlike(r"(?i)employer\s+provider"), "employer").otherwise("itp")


def map_provider_type(provider_type: Column) -> Column:
    """Further-education inspection file: independent, college, else provider."""
    low = F.lower(provider_type)
    return F.when(low.contains("independent"), "itp").when(low.contains("college"), "fe_college").otherwise("itp")


def repair_report_url(url: Column, urn: Column, ukprn: Column, further_education: bool) -> Column:
    """https form of the link, else a provider page built from the identifier."""
    code = 33 if further_education else 23
    ident = F.coalesce(non_blank(urn), non_blank(ukprn))
    given = F.when(url.startswith("http://"), F.concat(F.lit("https://"), url.substr(F.lit(8), F.length(url)))).otherwise(
        url
    )
    return F.coalesce(non_blank(given), F.concat(F.lit(f"{REPORT_SITE}/{code}/"), ident))


def resolve_report_url(url: Column, institution_type: Column) -> Column:
    """Old-site link -> provider page for the type; other links pass through."""
    path_id = non_blank(F.regexp_extract(url, r"(?i)/provider/[^/]+/([0-9]{4,8})", 1))
    tail_id = non_blank(F.regexp_extract(url, r"/([0-9]{4,8})(?:[/?#]|\z)", 1))
    urn = F.coalesce(path_id, tail_id)
    code = F.coalesce(lookup(institution_type, FIRST_URL_CODE), F.lit(FIRST_URL_CODE["other"]))
    legacy = url.rlike(r"(?i)^https?://www\.ofsted\.gov\.uk/")
    return F.when(~legacy, url).otherwise(F.concat(F.lit(REPORT_SITE + "/"), code.cast("string"), F.lit("/"), urn))


def merge_tags(left: Column, right: Column) -> Column:
    """Union of two "+"-joined tag sets, first-seen order."""
    both = F.concat(*[F.split(F.coalesce(c, F.lit("")), r"\+") for c in (left, right)])
    return F.array_join(F.array_distinct(F.filter(both, lambda t: t != "")), "+")
