"""Texts and names over whole documents, pages and registers."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.operators import findings as fd
from tierline.operators import matching as mt
from tierline.operators import sections as sec
from tierline.operators import standards as st
from tierline.operators.ledger import extract_incrementally
from tierline.session import cut_lineage, scratch_dir
from tierline.sources import pages as pg
from tierline.sources.phrases import Library, Phrase

from . import expected
from .q_columns import sql_name
from .registry import ORACLES, SHARED, query
from .views import Views

_stored: dict[tuple[str, str], DataFrame] = {}


def sections(v: Views) -> DataFrame:
    """The stored report sections of a folder (written once per session)."""
    key = (v.spark.sparkContext.applicationId, v.dir)
    if key not in _stored:
        _stored[key] = cut_lineage(sec.sectionise(v.report_texts, "report_text"), "sections")
    return _stored[key]


def sections_with_owner(v: Views) -> DataFrame:
    owner = v.inspections.select(F.col("id").alias("inspection_id"), "institution_id")
    return sections(v).join(owner, "inspection_id")


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


_T = "report_text"
_MARKS = ",\n".join(
    f"CASE WHEN regexp_matches({_T}, {_q(p)}) THEN struct_pack(pos := length(string_split_regex({_T}, {_q(p)})[1]), i := {i}, key := '{k}', "
    f"mult := CAST({m} AS DOUBLE), title := regexp_replace(regexp_extract({_T}, {_q(p)}, 0), '^\\s+|\\s+$', '', 'g')) END"
    for i, (k, m, p) in enumerate(expected.SECTION_MARKERS)
)


def _positions(text: str, pattern: str) -> str:
    """DuckDB list of 0-based match offsets."""
    return (
        f"(SELECT coalesce(list(list_sum(list_transform(ps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hs[1:k-1], lambda x: length(x))), 0)), []) "
        f"FROM (SELECT string_split_regex({text}, {_q(pattern)}) AS ps, regexp_extract_all({text}, {_q(pattern)}) AS hs) z, unnest(range(1, len(hs) + 1)) u(k))"
    )


SHARED["t1_marks"] = f"""SELECT inspection_id, m.pos AS pos, m.key AS key, m.mult AS mult, m.title AS title FROM
  (SELECT inspection_id, unnest(list_filter([{_MARKS}], lambda x: x IS NOT NULL)) AS m FROM {{report_texts}} WHERE length({_T}) >= 100) x
  QUALIFY row_number() OVER (PARTITION BY inspection_id, m.key ORDER BY m.pos, m.i) = 1"""
_ENDS = " UNION ALL ".join(
    f"SELECT inspection_id, unnest({_positions(_T, p)}) AS pos FROM {{report_texts}} WHERE regexp_matches({_T}, {_q(p)})" for p in expected.END_MARKERS
)
SHARED["t1_ends"] = _ENDS
SHARED["t1_cut"] = """SELECT m.*, coalesce(lead(m.pos) OVER (PARTITION BY m.inspection_id ORDER BY m.pos), length(t.report_text)) AS nxt,
  row_number() OVER (PARTITION BY m.inspection_id ORDER BY m.pos) AS rn, t.report_text FROM {t1_marks} m JOIN {report_texts} t ON t.inspection_id = m.inspection_id"""
SHARED["t1_body"] = """SELECT c.inspection_id, c.key, c.title, c.mult, c.rn, regexp_replace(substr(c.report_text, CAST(c.pos + 1 AS BIGINT), CAST(coalesce(e.stop, c.nxt) - c.pos AS BIGINT)), '^\\s+|\\s+$', '', 'g') AS body
  FROM {t1_cut} c LEFT JOIN (SELECT c.inspection_id, c.rn, min(e.pos) AS stop FROM {t1_cut} c JOIN {t1_ends} e ON e.inspection_id = c.inspection_id AND e.pos > c.pos AND e.pos < c.nxt GROUP BY 1, 2) e
    ON e.inspection_id = c.inspection_id AND e.rn = c.rn"""
_PROV = ", ".join(f"'{k}'" for k in expected.PROVISION_KEYS)
SHARED["t1"] = f"""SELECT inspection_id, section_key, section_title, section_text, multiplier, CAST(row_number() OVER (PARTITION BY inspection_id ORDER BY rn) - 1 AS INT) AS order_index FROM (
  SELECT inspection_id, key AS section_key, title AS section_title, body AS section_text, mult AS multiplier, rn FROM {{t1_body}} WHERE length(body) >= CASE WHEN key IN ({_PROV}) THEN 250 ELSE 60 END
  UNION ALL SELECT inspection_id, 'summary', 'Summary', regexp_replace(substr(report_text, 1, CAST(pos AS BIGINT)), '^\\s+|\\s+$', '', 'g'), 0.5, 0 FROM {{t1_cut}} WHERE rn = 1 AND pos > 200
  UNION ALL SELECT inspection_id, 'body', 'Body', report_text, 1.0, 0 FROM {{report_texts}} t WHERE NOT EXISTS (SELECT 1 FROM {{t1_marks}} m WHERE m.inspection_id = t.inspection_id)) x"""


@query("sectionise", "SELECT * FROM {t1}")
def _(v: Views) -> DataFrame:
    return sec.sectionise(v.report_texts, "report_text")


@query(
    "resectionise",
    """SELECT i.id AS inspection_id, s.section_key, s.order_index FROM {inspections} i JOIN {t1} s ON s.inspection_id = i.id
       JOIN {report_texts} t ON t.inspection_id = i.id WHERE t.report_text <> ''
       UNION ALL SELECT id, 'old', 0 FROM {inspections} i WHERE NOT EXISTS (SELECT 1 FROM {report_texts} t WHERE t.inspection_id = i.id AND t.report_text <> '')""",
)
def _(v: Views) -> DataFrame:
    old = v.inspections.select(
        F.col("id").alias("inspection_id"),
        F.lit("old").alias("section_key"),
        F.lit("Old").alias("section_title"),
        F.lit("old text").alias("section_text"),
        F.lit(1.0).alias("multiplier"),
        F.lit(0).alias("order_index"),
    )
    return sec.resectionise(v.inspections_text, old).select("inspection_id", "section_key", "order_index")


# A library of words that do occur in the invented prose.
PHRASES = [
    Phrase("fin_lit.the_of", "the of", False, 3, ("financial_literacy",)),
    Phrase("fin_lit.thing", r"\bth(?:ing|ere)\b", True, 2, ("financial_literacy", "confidence_resilience"), ("is the", "of the")),
    Phrase("emp.work", r"on\s+the\s+er", True, 2, ("employability_skills",)),
    Phrase("cr.ing_and", "ing and", False, 1, ("confidence_resilience",), ("zzz", "the and")),
    Phrase("os.de_la", r"de\s+(?:la|le)\s+\w+", True, 1, ("online_safety",)),
    Phrase("shared.der", "der und", False, 2, ("confidence_resilience", "online_safety")),
    Phrase("shared.never", "this phrase never occurs", False, 3, ("online_safety",)),
]


def _finding_sql(p: Phrase) -> str:
    pattern = "(?i)" + (p.pattern if p.regex else p.pattern)
    starts = _positions("section_text", pattern)
    guards = "[" + ", ".join(f"'{g}'" for g in p.guards) + "]::VARCHAR[]"
    return f"""SELECT DISTINCT inspection_id, institution_id, section_key, order_index, '{p.id}' AS phrase_id, {p.severity} AS base_severity, multiplier,
      [{', '.join(f"'{c}'" for c in p.curricula)}] AS curricula, {guards} AS guards, s AS quote_start,
      CASE WHEN t + n < len THEN t + n + 1 ELSE len END AS quote_end, section_text
      FROM (SELECT *, length(regexp_replace(substr(section_text, 1, CAST(greatest(0, h0 - 200) AS BIGINT)), '[^.!?]*$', '')) AS s, least(len, h1 + 200) AS t,
              length(regexp_extract(substr(section_text, CAST(least(len, h1 + 200) + 1 AS BIGINT)), '^[^.!?]*', 0)) AS n
            FROM (SELECT *, length(section_text) AS len, starts[k] AS h0, starts[k] + length(hs[k]) AS h1
                  FROM (SELECT w.*, {starts} AS starts, regexp_extract_all(section_text, {_q(pattern)}) AS hs FROM {{t1_owned}} w WHERE multiplier <> 0 AND regexp_matches(section_text, {_q(pattern)})) a,
                       unnest(range(1, len(hs) + 1)) u(k)) b) c"""


SHARED["t1_owned"] = "SELECT s.*, i.institution_id FROM {t1} s JOIN {inspections} i ON i.id = s.inspection_id"
SHARED["t2"] = f"""SELECT inspection_id, institution_id, section_key, order_index, phrase_id, CAST(quote_start AS INT) AS quote_start, CAST(quote_end AS INT) AS quote_end, quote AS source_quote,
  CAST(base_severity AS INT) AS base_severity, base_severity * multiplier AS final_severity, curricula, hit IS NOT NULL AS suppressed,
  CASE WHEN hit IS NOT NULL THEN 'guard: ' || substr(quote, instr(lower(quote), hit), length(hit)) END AS suppression_reason
  FROM (SELECT *, list_filter(guards, lambda g: contains(lower(quote), g))[1] AS hit FROM (SELECT *, regexp_replace(regexp_replace(substr(section_text, CAST(quote_start + 1 AS BIGINT), CAST(quote_end - quote_start AS BIGINT)),
    '[\\s\\x{{A0}}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS quote FROM ({' UNION ALL '.join(_finding_sql(p) for p in PHRASES)}) d) e) f""".replace("{{A0}}", "{A0}")


def found(v: Views) -> DataFrame:
    return fd.extract_findings(sections_with_owner(v), PHRASES)


_F = "inspection_id, section_key, order_index, phrase_id, quote_start, quote_end, base_severity, final_severity"


@query("extract_findings", f"SELECT {_F}, source_quote FROM {{t2}}")
def _(v: Views) -> DataFrame:
    return found(v).select(*_F.split(", "), "source_quote")


def _incremental(v: Views):
    """All texts as they were before (German ones another) read first, then all as they are."""
    owner = v.inspections.select(F.col("id").alias("inspection_id"), "institution_id")
    now = v.report_texts.join(owner, "inspection_id", "left").select("inspection_id", "institution_id", "report_text", "lang")
    before = now.withColumn("report_text", F.when(F.col("lang") == "de", F.concat("report_text", F.lit(" Old."))).otherwise(F.col("report_text")))
    folder = scratch_dir(v.spark, "extraction-ledger")
    library = Library(PHRASES, hashlib.sha256(repr(PHRASES).encode()).hexdigest())
    extract_incrementally(before, library, folder)
    return extract_incrementally(now, library, folder)


@query("extract_findings_incremental", f"SELECT {_F}, source_quote FROM {{t2}}")
def _(v: Views) -> DataFrame:
    return _incremental(v)[1].where("institution_id IS NOT NULL").select(*_F.split(", "), "source_quote")


@query("sectionise_incremental", ORACLES["sectionise"])
def _(v: Views) -> DataFrame:
    return _incremental(v)[0].select("inspection_id", "section_key", "section_title", "section_text", "multiplier", "order_index")


@query("apply_guards", "SELECT inspection_id, order_index, phrase_id, quote_start, quote_end, suppressed, suppression_reason FROM {t2}")
def _(v: Views) -> DataFrame:
    return found(v).select("inspection_id", "order_index", "phrase_id", "quote_start", "quote_end", "suppressed", "suppression_reason")


@query("explode_curricula", "SELECT institution_id, curriculum, CAST(count(*) AS BIGINT) AS matches FROM (SELECT institution_id, unnest(curricula) AS curriculum FROM {t2} WHERE NOT suppressed) x GROUP BY 1, 2")
def _(v: Views) -> DataFrame:
    return fd.explode_curricula(found(v)).groupBy("institution_id", "curriculum").agg(F.count(F.lit(1)).alias("matches"))


_LINE = "(?i)Standards?\\s+relating\\s+to\\s+([^.]+?)\\s+are\\s+(not\\s+met|met)\\b"
SHARED["t5"] = f"""SELECT DISTINCT inspection_id, area, outcome FROM (SELECT inspection_id, lower(trim(regexp_replace(unnest(regexp_extract_all(report_text, '{_LINE}', 1)), '\\s+', ' ', 'g'))) AS area,
  CASE WHEN regexp_matches(unnest(regexp_extract_all(report_text, '{_LINE}', 2)), '(?i)^not') THEN 'not_met' ELSE 'met' END AS outcome FROM {{standards_texts}}) x"""


@query("extract_standards", "SELECT * FROM {t5}")
def _(v: Views) -> DataFrame:
    return st.extract_standards(v.standards_texts, "report_text").drop("position")


def _worst(area: str) -> str:
    return f"CASE WHEN bool_or(regexp_matches(area, '{area}') AND outcome = 'not_met') THEN 'does_not_meet_standard' WHEN bool_or(regexp_matches(area, '{area}')) THEN 'meets_standard' END"


SHARED["t6"] = f"""SELECT l.inspection_id, CAST(l.standards AS INT) AS standards, l.safeguarding_effective,
  coalesce(l.pd, CASE WHEN regexp_matches(t.report_text, 'personal development\\s+of pupils is good') THEN 'good' END) AS personal_development,
  coalesce(l.qe, CASE WHEN regexp_matches(t.report_text, '(?i)achievement is excellent') THEN 'outstanding' END) AS quality_of_education, l.lm AS leadership_management,
  CASE WHEN regexp_matches(t.report_text, '(?i)all the relevant standards are met') THEN 'meets_standard' WHEN l.any_not THEN 'does_not_meet_standard' ELSE 'meets_standard' END AS overall_grade
  FROM (SELECT inspection_id, count(*) AS standards, CASE WHEN bool_or(regexp_matches(area, 'welfare|safety') AND outcome = 'not_met') THEN FALSE WHEN bool_or(regexp_matches(area, 'welfare|safety')) THEN TRUE END AS safeguarding_effective,
     {_worst('spiritual|moral')} AS pd, {_worst('quality of education')} AS qe, {_worst('leadership|management')} AS lm, bool_or(outcome = 'not_met') AS any_not FROM {{t5}} GROUP BY 1) l
  JOIN {{standards_texts}} t ON t.inspection_id = l.inspection_id"""


@query("map_standards", "SELECT * FROM {t6}")
def _(v: Views) -> DataFrame:
    return st.map_standards(v.standards_texts, "report_text")


@query(
    "update_isi_grades",
    """SELECT i.id, CASE WHEN t.inspection_body = 'isi' AND g.inspection_id IS NOT NULL THEN coalesce(g.overall_grade, i.overall_grade) ELSE i.overall_grade END AS overall_grade,
       CASE WHEN t.inspection_body = 'isi' AND g.inspection_id IS NOT NULL THEN coalesce(g.safeguarding_effective, i.safeguarding_effective) ELSE i.safeguarding_effective END AS safeguarding_effective,
       CASE WHEN t.inspection_body = 'isi' AND g.inspection_id IS NOT NULL THEN coalesce(g.personal_development, i.personal_development) ELSE i.personal_development END AS personal_development
       FROM {inspections} i LEFT JOIN {standards_texts} t ON t.inspection_id = i.id LEFT JOIN {t6} g ON g.inspection_id = i.id""",
)
def _(v: Views) -> DataFrame:
    texts = v.standards_texts.withColumnRenamed("inspection_id", "id")
    df = v.inspections.drop("inspection_body").join(texts, "id", "left")
    return st.update_isi_grades(df).select("id", "overall_grade", "safeguarding_effective", "personal_development")


# ---- pages ------------------------------------------------------------------

_A = "(?is)<a\\b[^>]*?\\bhref\\s*=\\s*[\"'']([^\"'']*)[\"''][^>]*>(.*?)</a>"


def _decode(x: str) -> str:
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        x = f"replace({x}, '{a}', '{b}')"
    return x


@query(
    "extract_links",
    f"""SELECT page_id, CAST(k - 1 AS INT) AS position, {_decode('hs[k]')} AS href,
        regexp_replace(regexp_replace({_decode("regexp_replace(ts[k], '<[^>]+>', '', 'g')")}, '[\\s\\x{{A0}}]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text
        FROM (SELECT page_id, regexp_extract_all(html, '{_A}', 1) AS hs, regexp_extract_all(html, '{_A}', 2) AS ts FROM pages) x, unnest(range(1, len(hs) + 1)) u(k)""",
)
def _(v: Views) -> DataFrame:
    return pg.extract_links(v.pages)


@query(
    "html_main_text",
    f"""SELECT page_id, CASE WHEN length(m) >= 500 THEN m END AS main_text FROM (SELECT page_id, regexp_replace(regexp_replace(regexp_replace({_decode("regexp_replace(body, '(?s)<[^>]*>', '', 'g')")},
        '[\\s\\x{{A0}}]+\\n', chr(10), 'g'), '[ \\t]{{2,}}', ' ', 'g'), '^[\\s\\x{{A0}}]+|[\\s\\x{{A0}}]+$', '', 'g') AS m
        FROM (SELECT page_id, coalesce(nullif(regexp_extract(c, '(?is)<main\\b[^>]*>(.*)</main>', 1), ''), nullif(regexp_extract(c, '(?is)<article\\b[^>]*>(.*)</article>', 1), ''),
                nullif(regexp_extract(c, '(?is)<body\\b[^>]*>(.*)</body>', 1), ''), c) AS body
              FROM (SELECT page_id, regexp_replace(html, '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', '', 'g') AS c FROM pages) a) b) d""",
)
def _(v: Views) -> DataFrame:
    return v.pages.select("page_id", pg.html_main_text(F.col("html")).alias("main_text"))


_REPORT_PAGES = """SELECT o_orderkey AS page_id, '<p><a href="/home">Home</a> <a href="https://files.ofsted.gov.uk/v1/file/A' || CAST(o_orderkey AS STRING) || '">Short inspection report, PDF - 0' || CAST(1 + o_orderkey % 9 AS STRING)
  || ' March 2020</a><a class="x" href="https://files.ofsted.gov.uk/v1/file/B' || CAST(o_orderkey AS STRING) || '"> ' || CASE WHEN o_totalprice > 250000 THEN 'Full inspection: Good' ELSE 'Monitoring report' END
  || ', PDF - 12 ' || CASE WHEN o_orderstatus = 'F' THEN 'Jan' ELSE 'September' END || ' 2020</a><a href="/c' || CAST(o_orderkey AS STRING) || '.pdf">School inspection report undated</a>' ||
  CASE WHEN o_orderpriority = '5-LOW' THEN '<a href="/d.pdf">Full inspection report 2021-05-06</a>' ELSE '' END || '</p>' AS html FROM {orders}"""


@query(
    "best_report_link",
    """SELECT o_orderkey AS page_id, CASE WHEN o_orderpriority = '5-LOW' THEN '/d.pdf' WHEN o_totalprice > 250000 THEN 'https://files.ofsted.gov.uk/v1/file/B' || CAST(o_orderkey AS VARCHAR)
       ELSE '/c' || CAST(o_orderkey AS VARCHAR) || '.pdf' END AS href, CASE WHEN o_orderpriority = '5-LOW' THEN '2021-05-06' WHEN o_totalprice > 250000 THEN CASE WHEN o_orderstatus = 'F' THEN '2020-01-12' ELSE '2020-09-12' END END AS report_date,
       TRUE AS is_full FROM orders""",
)
def _(v: Views) -> DataFrame:
    return v.sql(_REPORT_PAGES).select("page_id", pg.best_report_link(F.col("html")).alias("b")).select("page_id", "b.*")


_DIRECTORY = """SELECT id AS page_id, '<dl><dt>Email</dt> <dd class="v"><a href="mailto:' || coalesce(general_email, '') || '?subject=x">mail  us</a></dd><dt> Telephone</dt><dd>0' || CAST(id AS STRING) || ' 1</dd>'
  || '<dt>Website</dt><dd><a href="' || coalesce(website, '') || '">our <b>site</b></a></dd><dt>Principal</dt><dd>' || coalesce(head_name, '') || '</dd></dl>'
  || repeat('Course (level 3) ', CAST(id % 4 AS INT)) AS html FROM {institutions}"""


@query(
    "contact_pages",
    """SELECT id AS page_id, coalesce(general_email, 'mail us') AS email, '0' || CAST(id AS VARCHAR) || ' 1' AS phone, coalesce(website, 'our site') AS website, coalesce(head_name, '') AS head_name, CAST(id % 4 AS INT) AS standards FROM {institutions}""",
)
def _(v: Views) -> DataFrame:
    return pg.extract_contacts_dl(v.sql(_DIRECTORY))


_LISTING = """SELECT CAST(floor(id / 200) AS BIGINT) AS page_id, concat('<table><tr class=head><th>Name<th>Place', array_join(transform(array_sort(collect_list(struct(id, name, region))), r ->
  concat('<tr class="result odd"', CASE WHEN r.id % 7 = 0 THEN '' ELSE concat(' id=school_', CAST(r.id AS STRING)) END, '><td class="name"><img src=x><a href="',
  CASE WHEN r.id % 5 = 0 THEN '/other/' ELSE '/institutions/school/' END, 's', CAST(r.id AS STRING), '?p=1"><b>', replace(r.name, '&', '&amp;'), '</b>\n School</a><!-- <a href="/institutions/school/no">no</a> -->',
  '<td class="location">', CASE WHEN r.id % 4 = 0 THEN ' ' ELSE concat(coalesce(r.region, ''), ' &amp; area') END)), ''), '</table>') AS html FROM {institutions} GROUP BY 1"""


@query(
    "school_listing",
    """SELECT CAST(floor(id / 200) AS BIGINT) AS page_id, CAST(id AS VARCHAR) AS isi_id, 's' || CAST(id AS VARCHAR) AS slug, trim(regexp_replace(name, '\\s+', ' ', 'g')) || ' School' AS name,
       CASE WHEN id % 4 <> 0 THEN trim(coalesce(region, '') || ' & area') END AS address FROM {institutions} WHERE id % 7 <> 0 AND id % 5 <> 0""",
)
def _(v: Views) -> DataFrame:
    """All institutions as rows of listing pages with unclosed cells, unquoted ids and commented-out links."""
    return pg.school_listing(v.sql(_LISTING)).drop("position")


_COLLECTION = """SELECT CAST(floor(id / 100) AS BIGINT) AS page_id, concat('<main>', array_join(transform(array_sort(collect_list(struct(id, title))), r ->
  concat('<section>', CASE WHEN r.id % 3 = 0 THEN '' ELSE concat('<h2> Section ', CAST(r.id % 9 AS STRING), ' </h2>') END, '<ul class="gem-c-document-list big"><li class=gem-c-document-list__item>',
  CASE WHEN r.id % 4 = 0 THEN '<h3>Open</h3>' ELSE '' END, '<a href=/government/publications/n', CAST(r.id AS STRING), '> ', r.title, ' <li><a href="/other">none</a></ul><a href="/government/publications/m',
  CAST(r.id AS STRING), '">More of ', r.title, '</a></section><a href="/government/publications/outside">outside</a>')), ''), '</main>') AS html FROM {news} GROUP BY 1"""


@query(
    "collection_links",
    """SELECT CAST(floor(id / 100) AS BIGINT) AS page_id, 'https://www.gov.uk/government/publications/' || k || CAST(id AS VARCHAR) AS href, CASE k WHEN 'n' THEN title ELSE 'More of ' || title END AS title,
       CASE WHEN k = 'n' THEN CASE WHEN id % 4 = 0 THEN 'Open' ELSE 'Notices' END WHEN id % 3 <> 0 THEN 'Section ' || CAST(id % 9 AS VARCHAR) WHEN id % 4 = 0 THEN 'Open' ELSE 'Notices' END AS section
       FROM {news}, unnest(['n', 'm']) u(k)""",
)
def _(v: Views) -> DataFrame:
    """All news as lists in sections of collection pages; links outside of any list count for nothing."""
    return pg.collection_links(v.sql(_COLLECTION), "https://www.gov.uk/government/collections/notices")


# ---- names ------------------------------------------------------------------

SHARED["name_index"] = f"SELECT id, {sql_name('name')} AS k FROM {{institutions}} WHERE in_scope"


@query(
    "match_by_name",
    f"""WITH t AS (SELECT DISTINCT {sql_name('external_name')} AS k FROM {{external_names}}),
        e AS (SELECT t.k, min(d.id) AS eid FROM t JOIN {{name_index}} d ON d.k = t.k WHERE length(t.k) >= 4 GROUP BY 1),
        c AS (SELECT t.k, count(*) AS n, min(d.id) AS cid FROM t JOIN {{name_index}} d ON length(t.k) >= 5 AND length(d.k) >= 5 AND (contains(d.k, t.k) OR contains(t.k, d.k))
          AND least(length(d.k), length(t.k)) / CAST(greatest(length(d.k), length(t.k)) AS DOUBLE) >= 0.5 GROUP BY 1)
        SELECT x.id, coalesce(e.eid, CASE WHEN c.n = 1 THEN c.cid END) AS institution_id FROM (SELECT id, {sql_name('external_name')} AS k FROM {{external_names}}) x
        LEFT JOIN e ON e.k = x.k LEFT JOIN c ON c.k = x.k""",
)
def _(v: Views) -> DataFrame:
    return mt.match_by_name(v.external_names, v.institutions, "external_name").select("id", "institution_id")


@query(
    "match_mentions",
    f"""WITH d AS (SELECT id, {sql_name('name', 'news')} AS k FROM {{institutions}} WHERE in_scope),
        u AS (SELECT * FROM d WHERE length(k) >= 8 AND len(list_filter(string_split(k, ' '), lambda w: length(w) >= 3)) >= 2),
        a AS (SELECT doc_id, ' ' || {sql_name('text', 'news')} || ' ' AS t FROM documents)
        SELECT a.doc_id, u.id AS institution_id, CAST(50 + least(40, floor(length(u.k) / 2)) AS INT) AS relevance FROM a JOIN u ON contains(a.t, ' ' || u.k || ' ')
        QUALIFY row_number() OVER (PARTITION BY a.doc_id ORDER BY u.id) <= 3""",
)
def _(v: Views) -> DataFrame:
    return mt.match_mentions(v.documents, v.institutions, "doc_id", "text", per_article=3)


_SCHOOLS = """SELECT CAST(6000 + id AS STRING) AS isi_id, CASE WHEN id % 3 = 0 THEN 'The ' || name || ' School' ELSE name || ' Hall' END AS name, region AS address FROM {institutions}"""


def _school(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower({x}), '''', ''), '&', 'and'), '\\b(school|college|the|of|and|st\\.?)\\b', '', 'g'), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "link_or_create",
    f"""SELECT s.isi_id, CASE WHEN b.id IS NOT NULL THEN 'id' WHEN n.id IS NOT NULL THEN 'name' ELSE 'new' END AS how, coalesce(b.id, n.id) AS known_id FROM ({_SCHOOLS}) s
        LEFT JOIN (SELECT isi_id, min(id) AS id FROM {{institutions}} WHERE isi_id IS NOT NULL GROUP BY 1) b ON b.isi_id = s.isi_id
        LEFT JOIN (SELECT {_school('name')} AS k, min(id) AS id FROM {{institutions}} WHERE type = 'independent_school' GROUP BY 1) n ON n.k = {_school('s.name')} AND length(n.k) >= 4""",
)
def _(v: Views) -> DataFrame:
    out = mt.link_or_create(v.sql(_SCHOOLS), v.institutions)
    return out.select("isi_id", "how", F.when(F.col("how") != "new", F.col("institution_id")).alias("known_id"))


@query(
    "rank_company",
    f"""WITH c AS (SELECT *, {sql_name('name', 'company')} AS k, {sql_name('title', 'company')} AS tk FROM {{company_hits}}),
        r AS (SELECT *, CASE WHEN tk = k THEN 0 WHEN replace(upper(company_postcode), ' ', '') = replace(upper(postcode), ' ', '') AND postcode <> '' THEN 1 WHEN company_status = 'active' THEN 2 ELSE 3 END AS step,
          abs(length(tk) - length(k)) AS gap FROM c)
        SELECT institution_id, company_number FROM r QUALIFY row_number() OVER (PARTITION BY institution_id ORDER BY step, CASE WHEN step >= 2 THEN gap ELSE 0 END, position) = 1""",
)
def _(v: Views) -> DataFrame:
    return mt.rank_company(v.company_hits)


_HITS = """SELECT e.event_id AS id, i.id AS provider, i.name, e.event_id AS position, CASE WHEN e.value > 40 THEN 'News of ' || i.name ELSE 'Other item' END AS title,
  CASE WHEN e.value > 120 THEN NULL ELSE lower(split_part(i.name, ' ', 1)) || ' again' END AS summary FROM {events} e JOIN {institutions} i ON i.id = e.user_id"""


@query(
    "filter_feed_hits",
    f"""SELECT id, provider FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY position) AS rn FROM ({_HITS}) h) x WHERE rn <= 8
        AND contains(lower(title || ' ' || coalesce(summary, '')), lower(array_to_string(string_split(name, ' ')[1:2], ' ')))""",
)
def _(v: Views) -> DataFrame:
    return mt.filter_feed_hits(v.sql(_HITS), "provider", "name", "position", first=8).select("id", "provider")


@query(
    "filter_feed_hits_bulk",
    f"""SELECT id, provider FROM (SELECT *, row_number() OVER (PARTITION BY provider ORDER BY position) AS rn FROM ({_HITS}) h) x WHERE rn <= 8
        AND (length(split_part(name, ' ', 1)) < 4 OR contains(lower(title || ' ' || coalesce(summary, '')), lower(split_part(name, ' ', 1))))""",
)
def _(v: Views) -> DataFrame:
    return mt.filter_feed_hits(v.sql(_HITS), "provider", "name", "position", words=1, first=8).select("id", "provider")
