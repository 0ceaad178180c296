"""Organisation and person names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, capitalise, non_blank, portable, strip, word

# ---- fixed values ---------------------------------------------------------
LEGAL_FORMS = "ltd|limited|llp|plc|cic|cio"
ARTICLES = "the|a|an"
FILLER = "group|holdings|services|company"
TRADING_NAME_TAIL = r"(?<![0-9A-Za-z_])(?:t/a|trading as)(?![0-9A-Za-z_]).*\z"
SCHOOL_WORDS = r"school|college|the|of|and"
NAME_RULES = {
    "notice": [word(LEGAL_FORMS), word(ARTICLES), TRADING_NAME_TAIL, word(FILLER)],
    "news": [word(LEGAL_FORMS), word(ARTICLES), TRADING_NAME_TAIL, word(FILLER)],
    "company": [word(LEGAL_FORMS + "|t/a")],
    "dedup": [word(LEGAL_FORMS), word(ARTICLES + "|t/a|trading as"), word(FILLER)],
}
UNIVERSITY_PATTERNS = [
    r"\buniversity of \w+",
    r"\b\w+ university\b",
    r"\buniversity college \w+",
    r"\buniversity centre \w+",
    r"\bimperial college london\b",
    r"\bking's college london\b",
    r"\b(?:^|\s)ucl(?:\s|$|,)",
    r"\blondon school of economics\b",
    r"\blse\b",
    r"\broyal college of (?:art|music|nursing|surgeons|physicians|paediatrics)",
    r"\bschool of oriental and african studies\b",
    r"\bsoas\b",
    r"\b(?:liverpool hope|aston|brunel|coventry|cranfield|de montfort|loughborough|northumbria|salford"
    r"|sheffield hallam|teesside) university\b",
]
NOT_UNIVERSITY = (
    r"\b(?:NHS|hospital|hospitals|trust|academy holbeach|academy 92|stem education academy|primary|secondary"
    r"|further education|fe college)\b"
)
PERSON_TITLES = "mr|mrs|ms|miss|mx|dr|prof"
# ---------------------------------------------------------------------------


def _plain(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(col, r"[^a-z0-9]+", " "), r" +", " "))


def norm_name(col: Column, variant: str = "notice") -> Column:
    """Comparison key of an organisation name.

    Rules run in order, which is why "t/a" never cuts in the first two
    variants: the article rule has already eaten its "a".
    """
    out = F.lower(col)
    for rule in NAME_RULES[variant]:
        out = F.regexp_replace(out, rule, " ")
    return _plain(out)


def norm_school_name(col: Column) -> Column:
    out = F.regexp_replace(F.lower(col), "['’‘]", "")
    out = F.replace(out, F.lit("&"), F.lit("and"))
    # "st." loses its dot only when a word character follows directly.
    out = F.regexp_replace(
        out, rf"(?<![0-9A-Za-z_])(?:st\.(?=[0-9A-Za-z_])|(?:{SCHOOL_WORDS}|st)(?![0-9A-Za-z_]))", ""
    )
    return _plain(out)


def slugify(col: Column, width: int | None = None) -> Column:
    """Lower-case words joined by dashes; whole unless ``width`` is given."""
    dashed = F.regexp_replace(F.lower(col), r"[^a-z0-9]+", "-")
    slug = F.regexp_replace(dashed, r"^-+|-+\z", "")
    return slug if width is None else F.substring(slug, 1, width)


def split_name(col: Column) -> Column:
    """struct(first, last) of a person name, title dropped."""
    bare = strip(F.regexp_replace(col, rf"(?i)^(?:{PERSON_TITLES})\.?{WS}+", ""))
    parts = F.split(bare, f"{WS}+")
    has_value = F.coalesce(col != "", F.lit(False))
    return F.struct(
        F.when(has_value, F.get(parts, F.lit(0))).alias("first"),
        F.when(has_value, non_blank(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1))), " "))).alias(
            "last"
        ),
    )


def phrase_label(col: Column) -> Column:
    """"fam.some_phrase" -> "Some Phrase"."""
    bare = F.replace(F.regexp_replace(col, r"^[a-z_]+\.", ""), F.lit("_"), F.lit(" "))
    runs = F.regexp_extract_all(bare, F.lit(r"[0-9A-Za-z_]+|[^0-9A-Za-z_]+"), F.lit(0))
    return F.array_join(
        F.transform(runs, lambda r: F.when(r.rlike("^[0-9A-Za-z_]"), capitalise(r)).otherwise(r)), ""
    )


def looks_like_university(name: Column) -> Column:
    include = portable("(?i)" + "|".join(UNIVERSITY_PATTERNS))
    return name.rlike(include) & ~name.rlike(portable("(?i)" + NOT_UNIVERSITY))


def reclassify_universities(type_: Column, name: Column, in_scope: Column) -> Column:
    """Type after earlier university marks are reset and the rule re-applied."""
    reset = F.when(type_ == "university", "itp").otherwise(type_)
    return F.when((reset == "itp") & in_scope & looks_like_university(name), "university").otherwise(reset)
