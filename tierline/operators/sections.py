"""Report text into named sections: one walk over each text finds all markers."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS
from ..functions.walk import Walk
from .upsert import replace_children

# ---- fixed values: (key, multiplier, pattern) in search order --------------
SECTION_MARKERS = [
    ("what_school_needs_to_improve", 2.0, r"(?i)what does the school need to do to improve"),
    ("what_provider_needs_to_improve", 2.0, r"(?i)what does the provider need to do to improve"),
    ("what_school_needs_to_improve", 2.0, r"(?i)what does the (?:college|sixth form) need to do to improve"),
    ("what_school_needs_to_improve", 2.0, r"(?i)how can the school improve further"),
    ("what_school_needs_to_improve", 2.0, r"(?i)the school must take the following actions"),
    ("areas_for_action", 2.0, r"(?i)areas (?:for|requiring) action"),
    ("areas_for_action", 2.0, r"(?i)priority actions"),
    ("recommendations", 1.5, r"(?im)^\s*recommendations\b"),
    ("recommendations", 1.5, r"(?im)^\s*recommended actions"),
    ("areas_for_improvement", 1.5, r"(?i)areas for improvement"),
    ("significant_strengths", 0.0, r"(?i)significant strengths"),
    ("significant_strengths", 0.0, r"(?im)^\s*strengths\b"),
    ("significant_strengths", 0.0, r"(?i)the school's strengths"),
    ("safeguarding", 1.0, r"(?im)^\s*safeguarding\b"),
    ("safeguarding", 1.0, r"(?i)safeguarding (?:is )?effective"),
    ("main_findings", 1.0, r"(?i)what is it like to attend this school"),
    ("main_findings", 1.0, r"(?i)what is it like to be a learner"),
    ("main_findings", 1.0, r"(?i)what is it like to attend this provider"),
    ("main_findings", 1.0, r"(?i)what is it like to attend this college"),
    ("main_findings", 1.0, r"(?i)what does the school do well"),
    ("main_findings", 1.0, r"(?i)what does the provider do well"),
    ("apprenticeships", 1.5, r"(?im)^\s*apprenticeships\s*$"),
    ("adult_learning", 1.5, r"(?i)adult\s+learning\s+programmes"),
    ("young_peoples_provision", 1.5, r"(?i)education\s+programmes\s+for\s+young\s+people"),
    (
        "young_peoples_provision",
        1.5,
        r"(?im)^\s*(?:16\s+to\s+19\s+study\s+programmes?|study\s+programmes?\s+for\s+young\s+people)",
    ),
    ("high_needs_provision", 1.5, r"(?i)provision\s+for\s+learners\s+with\s+high\s+needs"),
    ("high_needs_provision", 1.5, r"(?i)high\s+needs\s+provision"),
    ("quality_of_education", 1.0, r"(?im)^\s*quality\s+of\s+education\s*$"),
    ("behaviour_attitudes", 1.0, r"(?i)behaviour and attitudes"),
    ("personal_development", 1.0, r"(?im)^\s*personal\s+development\s*$"),
    ("leadership_management", 1.0, r"(?i)leadership\s+and\s+management"),
    ("summary", 0.5, r"(?i)information about this school"),
    ("summary", 0.5, r"(?i)information about this provider"),
]
END_MARKERS = [
    r"(?im)^\s*provider details\b",
    r"(?im)^\s*school details\b",
    r"(?im)^\s*information about this inspection\b",
    r"(?im)^\s*the inspection team\b",
    r"(?im)^\s*annex\b",
    r"(?im)^\s*how can I feedback my views\b",
    r"(?im)^\s*if you are not satisfied\b",
    r"(?im)^\s*the parent view (?:online )?questionnaire\b",
    r"(?im)^\s*you can use parent view\b",
    r"(?im)^\s*interested in our work\b",
    r"(?i)this publication is available at https?://",
    r"(?m)^\s*Inspection report:\s*[A-Z]",
    r"(?m)^\s*Re-inspection report:\s*[A-Z]",
    r"(?im)^\s*[0-9]{1,2}\s+(?:January|February|March|April|May|June|July|August|September|October|November"
    r"|December)\s+[0-9]{4}\s*$",
]
MIN_TEXT = 100
MIN_SUMMARY_PREFIX = 200
MIN_BODY = 60
MIN_PROVISION_BODY = 250
PROVISION_KEYS = [
    "apprenticeships", "adult_learning", "young_peoples_provision", "high_needs_provision",
    "quality_of_education", "behaviour_attitudes", "personal_development", "leadership_management",
]
# ---------------------------------------------------------------------------


#: Texts that a worker holds at a time.
ROWS = 256


def marker_walks() -> tuple[Walk, Walk]:
    return Walk([(source, True) for _, _, source in SECTION_MARKERS]), Walk([(source, True) for source in END_MARKERS])


def split_sections(text: str, walks: tuple[Walk, Walk]) -> list[tuple[str, str, str, float]]:
    """(key, title, text, multiplier) of a text's sections, in reading order.

    A text is never cut or split before: all positions refer to the whole
    string, so the anchored patterns see their true context.
    """
    markers, ends_walk = walks
    found = sorted((at, i, text[at:end].strip(BLANKS)) for i, at, end in markers.first(text)) if len(text) >= MIN_TEXT else []
    first: dict[str, tuple[int, int, str]] = {}
    for at, i, title in found:
        first.setdefault(SECTION_MARKERS[i][0], (at, i, title))
    if not first:
        return [("body", "Body", text, 1.0)]
    starts = list(first.values())
    ends = sorted(at for _, at, _ in ends_walk.all(text))
    out = []
    if starts[0][0] > MIN_SUMMARY_PREFIX:
        out.append(("summary", "Summary", text[: starts[0][0]].strip(BLANKS), 0.5))
    for n, (at, i, title) in enumerate(starts):
        stop = starts[n + 1][0] if n + 1 < len(starts) else len(text)
        k = bisect_right(ends, at)
        if k < len(ends):
            stop = min(stop, ends[k])
        key, multiplier, _ = SECTION_MARKERS[i]
        body = text[at:stop].strip(BLANKS)
        if len(body) >= (MIN_PROVISION_BODY if key in PROVISION_KEYS else MIN_BODY):
            out.append((key, title, body, multiplier))
    return out


def sectionise(df: DataFrame, text_col: str, keep: Sequence[str] = ("inspection_id",)) -> DataFrame:
    """One row per section: key, title, text, multiplier, order_index. No exchange is involved."""
    rows = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__text"))
    kept = [f"`{c}` {t}" for c, t in rows.dtypes[:-1]]
    made = {"section_key": pa.string(), "section_title": pa.string(), "section_text": pa.string(), "multiplier": pa.float64()}
    sent = df.sparkSession.sparkContext.broadcast(marker_walks())

    def cut(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                sections = [split_sections(t, sent.value) for t in batch.column("__text").to_pylist()]
                row = pa.array([r for r, own in enumerate(sections) for _ in own], pa.int32())
                fields = [pa.array([s[k] for own in sections for s in own], t) for k, t in enumerate(made.values())]
                order = pa.array([n for own in sections for n in range(len(own))], pa.int32())
                columns = [*(batch.column(c).take(row) for c in keep), *fields, order]
                yield pa.RecordBatch.from_arrays(columns, [*keep, *made, "order_index"])

    types = "section_key string, section_title string, section_text string, multiplier double, order_index int"
    return rows.mapInArrow(cut, ", ".join([*kept, types]))


def resectionise(inspections: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections rebuilt for every inspection that has a text, others kept."""
    stored = inspections.where(F.col("report_text") != "").select(F.col("id").alias("inspection_id"), "report_text")
    return replace_children(sections, sectionise(stored, "report_text"), stored, "inspection_id")
