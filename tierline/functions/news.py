"""News items: keyword gate, excerpts, hashes and rated answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WS, half_up, strip

# ---- fixed values: trigger keyword stems ----------------------------------
TRIGGER_KEYWORDS = [
    # industrial action, staffing
    "strik", "ballot", "walk out", "walkout", "industrial action", "ucu",
    "redundanc", "lay off", "layoff", "job cut", "job loss", "restructur",
    "principal", "chief executive", "ceo", "step down", "stepping down",
    "resign", "depart", "appoint",
    # inspection
    "inadequate", "requires improvement", "rated good", "downgrad", "rated outstanding",
    "ofsted", "inspection report", "ofsted finds",
    # regulator
    "notice to improve", "best value notice", "intervention", "fec ", "fe commissioner",
    "removed from", "suspended", "fraud", "investigation", "probe",
    "audit", "warning", "complain", "compliance", "threat", "threaten",
    # money
    "deficit", "insolvenc", "administration", "liquidat", "merger",
    "merging", "merged", "fund", "budget cut", "loss",
    "financial difficult", "financial troubl", "financial crisis",
    "loan", "debt", "bankruptcy", "rescue",
    # safety and behaviour
    "safeguard", "behaviour", "behavior", "bully", "exclus", "absentee",
    "harm", "abuse", "assault", "stab", "knife", "weapon", "police",
    "death", "died", "tragedy", "accident", "evacuat", "fell", "fall",
    "racist", "racism", "homopho", "transpho",
    # quality
    "consent", "missold", "mis-sold", "data integrity", "inflat",
    "scandal", "concern", "complaint",
    "closur", "closing", "shut down", "shutting", "shut at",
    # wellbeing
    "wellbeing", "mental health", "anxiety", "self-harm", "suicid",
    # further education
    "apprent", "training provider", "roatp", "apar ",
]
FILTERED_ANGLE = "filtered: no signal keywords matched"
NO_ANGLE = "no angle"
# ---------------------------------------------------------------------------
TRIGGER_PATTERN = "(?i)" + "|".join(TRIGGER_KEYWORDS)

ANSWER_FIELDS = "relevance variant, trigger_severity variant, curricula_tagged variant, angle variant"


def has_trigger(title: Column, excerpt: Column) -> Column:
    return F.concat(title, F.lit(" "), F.coalesce(excerpt, F.lit(""))).rlike(TRIGGER_PATTERN)


def keyword_gate(news: DataFrame) -> DataFrame:
    """Rows without a trigger keyword get fixed low ratings; ``hit`` says which."""
    hit = has_trigger(F.col("title"), F.col("excerpt"))
    flagged = news.withColumn("hit", hit)
    keep = lambda c, other: F.when(F.col("hit"), F.col(c)).otherwise(other)
    return flagged.withColumns(
        {
            "relevance": keep("relevance", F.when(F.length("title") > 0, 30).otherwise(10)),
            "trigger_severity": keep("trigger_severity", F.lit(0)),
            "curricula_tagged": F.when(F.col("hit"), F.col("curricula_tagged")),
            "angle": keep("angle", F.lit(FILTERED_ANGLE)),
        }
    )


def clean_excerpt(col: Column, width: int | None = None) -> Column:
    """Tags and runs of blanks become one space; whole unless ``width`` is given."""
    no_tags = F.regexp_replace(col, "<[^>]+>", " ")
    whole = F.regexp_replace(no_tags, f"{WS}+", " ")
    return whole if width is None else F.substring(whole, 1, width)


def content_hash(link: Column, title: Column) -> Column:
    """First 16 hex digits of sha1(link + title)."""
    return F.substring(F.sha1(F.concat(link, title).cast("binary")), 1, 16)


def text_hash(col: Column) -> Column:
    return F.sha2(col.cast("binary"), 256)


def parse_signal_json(answer: Column) -> Column:
    """First JSON object of a rating answer as a typed struct, null if none.

    The parser stops at the end of the first object, so fences and prose
    around it do no harm. Numbers are rounded and clamped to 0..100.
    """
    body = answer.substr(F.instr(answer, "{"), F.length(answer))
    parsed = F.from_json(F.when(F.instr(answer, "{") > 0, body), ANSWER_FIELDS)
    usable = F.coalesce(
        *[F.when(parsed[f].isNotNull(), True) for f in ("relevance", "trigger_severity", "curricula_tagged", "angle")]
    )

    def clamped(name: str) -> Column:
        raw = F.try_variant_get(parsed[name], "$", "string")
        number = F.when(F.lower(raw) == "true", 1.0).when(F.trim(raw) == "", 0.0).otherwise(raw.try_cast("double"))
        finite = F.when(F.abs(number) < float("inf"), number)
        return F.coalesce(F.least(F.greatest(half_up(finite), F.lit(0)), F.lit(100)), F.lit(0)).cast("int")

    def text(name: str, default: str) -> Column:
        is_text = F.schema_of_variant(parsed[name]) == "STRING"
        return F.when(is_text, strip(F.try_variant_get(parsed[name], "$", "string"))).otherwise(default)

    return F.when(
        usable,
        F.struct(
            clamped("relevance").alias("relevance"),
            clamped("trigger_severity").alias("trigger_severity"),
            text("curricula_tagged", "").alias("curricula_tagged"),
            text("angle", NO_ANGLE).alias("angle"),
        ),
    )
