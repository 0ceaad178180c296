"""Upserts, snapshots, entity resolution, ingestion, readers and the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline.operators import dedup as dd
from tierline.operators import ingest as ing
from tierline.operators import notice_flow as nf
from tierline.operators import upsert as up
from tierline.operators.buckets import BucketedTable
from tierline.session import scratch_dir
from tierline.sources import feeds, registers, sinks
from tierline.sources.phrases import load_phrases
from tierline.sources.seeds import COMMISSIONERS, seed_commissioners
from tierline.streaming.news import compact, current_news, store_mention_index, stream_feeds, stream_merge_news

from .q_columns import sql_date, sql_grade, sql_name
from .q_reports import EXPORT, tables
from .q_reports import _brief_sql as BRIEF_SQL
from .registry import ORACLES, SHARED, query
from .views import AS_OF, Views

# ---- keyed upsert -----------------------------------------------------------

SHARED["up_target"] = "SELECT id, type, region, website FROM {institutions} WHERE website IS NULL OR region = 'ASIA'"
SHARED["up_source"] = """SELECT o_custkey AS id, o_orderpriority AS type, o_orderstatus AS region, CASE WHEN o_totalprice > 250000 THEN 'site ' || CAST(o_orderkey AS STRING) END AS website, o_orderkey AS row_no FROM {orders}"""


@query(
    "upsert",
    """SELECT coalesce(t.id, s.id) AS id, coalesce(s.last_type, t.type) AS type, coalesce(t.region, CASE WHEN t.id IS NULL THEN s.first_region END) AS region, coalesce(s.last_site, t.website) AS website
       FROM {up_target} t FULL JOIN (SELECT id, arg_max(type, row_no) AS last_type, arg_min(region, row_no) AS first_region, arg_max(website, row_no) FILTER (WHERE website IS NOT NULL) AS last_site FROM {up_source} GROUP BY id) s ON s.id = t.id""",
)
def _(v: Views) -> DataFrame:
    target, source = v.sql(SHARED["up_target"]), v.sql(SHARED["up_source"])
    return up.upsert(target, source, ["id"], overwrite=["type"], keep_if_null=["website"], order="row_no")


@query(
    "replace_children",
    """SELECT id, institution_id, subject FROM {notices} WHERE institution_id NOT IN (SELECT user_id FROM {events})
       UNION ALL SELECT event_id, user_id, event_type FROM {events}""",
)
def _(v: Views) -> DataFrame:
    target = v.notices.select("id", "institution_id", "subject")
    new = v.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("institution_id"), F.col("event_type").alias("subject"))
    return up.replace_children(target, new, new, "institution_id")


def _bucketed(v: Views, label: str, rows: DataFrame, *keys: str) -> BucketedTable:
    """The rows as a stored table cut into buckets of the keys."""
    table = BucketedTable(v.spark, _landed(v, label), ", ".join(f"{c} {t}" for c, t in rows.dtypes), keys, buckets=16)
    table.write(rows)
    return table


@query("upsert_stored", ORACLES["upsert"])
def _(v: Views) -> DataFrame:
    table = _bucketed(v, "upsert-table", v.sql(SHARED["up_target"]), "id")
    table.upsert(v.sql(SHARED["up_source"]), ["id"], overwrite=["type"], keep_if_null=["website"], order="row_no")
    return table.read()


@query("replace_children_stored", ORACLES["replace_children"])
def _(v: Views) -> DataFrame:
    table = _bucketed(v, "children-table", v.notices.select("id", "institution_id", "subject"), "institution_id")
    new = v.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("institution_id"), F.col("event_type").alias("subject"))
    table.replace_children(new, new)
    return table.read()


@query(
    "content_manifest",
    """SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS bytes, sha256(html) AS sha256, page_id % 3 = 0 AS fresh FROM pages""",
)
def _(v: Views) -> DataFrame:
    docs = v.pages.select(
        "page_id", "html", F.when(F.col("page_id") % 3 == 0, "2003-03-30 12:00:00").otherwise("2003-03-01 00:00:00").alias("fetched_at")
    )
    out = up.content_manifest(docs.withColumnRenamed("page_id", "url"), AS_OF, 24, body="html")
    return out.select(F.col("url").alias("page_id"), "bytes", "sha256", "fresh")


@query("register_version", "SELECT sha256(text) AS yaml_hash, CAST(n_chars AS INT) AS phrase_count FROM documents UNION ALL SELECT 'abc', 85")
def _(v: Views) -> DataFrame:
    seen = v.documents.select(F.sha2("text", 256).alias("yaml_hash"), F.col("n_chars").cast("int").alias("phrase_count"))
    return up.register_version(up.register_version(seen, "abc", 85), "abc", 85)


# ---- notices ----------------------------------------------------------------

_STATUS = """CASE WHEN s LIKE '%not currently starting%' THEN 'apar.not_currently_starting_new_apprentices' WHEN s LIKE '%removed%' THEN 'apar.removed' WHEN s LIKE '%suspended%' THEN 'apar.suspended'
  WHEN s LIKE '%conditions%' THEN 'apar.conditions_imposed' ELSE 'apar.status_other' END"""
_SEV = "CASE {t} WHEN 'apar.not_currently_starting_new_apprentices' THEN 85 WHEN 'apar.removed' THEN 95 WHEN 'apar.suspended' THEN 92 WHEN 'apar.conditions_imposed' THEN 80 ELSE 60 END"
SHARED["reg_notices"] = f"""SELECT i.id AS institution_id, {_STATUS} AS notice_type, arg_max(status, row_no) AS status, max(row_no) AS row_no FROM (SELECT id AS row_no, ukprn, register_status AS status, lower(trim(register_status)) AS s FROM {{messy}}) m
  JOIN {{institutions}} i ON i.ukprn = m.ukprn WHERE s <> '' GROUP BY 1, 2"""


def _register(v: Views) -> DataFrame:
    return v.messy.select(
        F.col("id").alias("row_no"), "ukprn", "application_type", F.col("register_status").alias("status"), F.lit(None).cast("string").alias("determined")
    )


@query(
    "apply_snapshot",
    f"""SELECT institution_id, notice_body, notice_type, source_url, CASE WHEN notice_body = 'apar' AND withdrawn_at IS NULL AND institution_id NOT IN (SELECT institution_id FROM {{reg_notices}}) THEN '{AS_OF}' ELSE withdrawn_at END AS withdrawn_at,
        CAST(severity AS INT) AS severity FROM (
          SELECT institution_id, notice_body, notice_type, source_url, withdrawn_at, severity FROM {{notices}}
          UNION ALL SELECT institution_id, 'apar', notice_type, 'https://download.apprenticeships.education.gov.uk/apar', NULL, {_SEV.format(t='notice_type')} FROM {{reg_notices}}) x""",
)
def _(v: Views) -> DataFrame:
    snap = nf.register_notices(_register(v), v.institutions, AS_OF)
    once = nf.apply_snapshot(v.notices, snap, AS_OF)
    return once.select("institution_id", "notice_body", "notice_type", "source_url", "withdrawn_at", "severity")


@query("apply_snapshot_stored", ORACLES["apply_snapshot"])
def _(v: Views) -> DataFrame:
    table = _bucketed(v, "notices-table", v.notices, "institution_id")
    nf.apply_snapshot_stored(table, nf.register_notices(_register(v), v.institutions, AS_OF), AS_OF)
    return table.read().select("institution_id", "notice_body", "notice_type", "source_url", "withdrawn_at", "severity")


_FEED = """SELECT e.event_id AS row_no, CASE e.event_type WHEN 'click' THEN i.name || ': Notice to Improve' WHEN 'view' THEN 'Statutory intervention: ' || i.name WHEN 'purchase' THEN i.name || ' open day' ELSE 'Ofsted report on ' || i.name || '. Fraud charges' END AS title,
  'Published by the department' AS summary, 'https://feeds.example.org/' || CAST(e.event_id AS STRING) AS link, CAST(CAST(e.ts AS DATE) AS STRING) || 'T00:00:00Z' AS updated, CASE WHEN e.value > 100 THEN 'Closed' ELSE 'Open' END AS section
  FROM {events} e JOIN {institutions} i ON i.id = e.user_id"""


SHARED["feed"] = _FEED


def _matched(keys: str) -> str:
    """(k, institution_id) of distinct name keys: the lowest id with that key, else the only containment partner."""
    return f"""SELECT t.k, coalesce((SELECT min(d.id) FROM {{name_index}} d WHERE d.k = t.k AND length(t.k) >= 4),
      (SELECT CASE WHEN count(*) = 1 THEN min(d.id) END FROM {{name_index}} d WHERE length(t.k) >= 5 AND length(d.k) >= 5 AND (contains(d.k, t.k) OR contains(t.k, d.k))
         AND least(length(d.k), length(t.k)) / CAST(greatest(length(d.k), length(t.k)) AS DOUBLE) >= 0.5)) AS institution_id
      FROM (SELECT DISTINCT k FROM ({keys}) x) t"""


SHARED["feed_classed"] = r"""SELECT *, CASE WHEN regexp_matches(t, '(?i)notice to improve|financial notice|quality notice|governance notice') THEN 'govuk.notice_issued'
    WHEN regexp_matches(t, '(?i)intervention|commissioner') THEN 'govuk.intervention_announced' ELSE 'govuk.compliance_action' END AS nt
  FROM (SELECT *, title || chr(10) || summary AS t FROM {feed}) f
  WHERE regexp_matches(t, '(?i)\b(notice to improve|financial notice|quality notice|governance notice|intervention|removed from\s+(the\s+)?(register|apar|roatp)|suspended from\s+(apar|roatp)|subcontracting standard|minimum standards|(fe\s+)?commissioner|safeguarding (concern|failure|investigation)|fraud (investigation|charges?))\b')""".replace("\\\\", "\\")
SHARED["feed_candidates"] = f"""SELECT row_no, {sql_name('candidate')} AS k FROM (
    SELECT row_no, trim(p) AS candidate FROM (SELECT row_no, unnest(string_split(title, ':')) AS p FROM {{feed_classed}}) a WHERE length(trim(p)) >= 6 AND regexp_matches(trim(p), '[A-Z]')
    UNION SELECT row_no, trim(regexp_extract(title, '(?i)(report on|notice (issued )?to)\\s+(.+?)(\\.|$)', 3)) FROM {{feed_classed}} WHERE regexp_matches(title, '(?i)(report on|notice (issued )?to)\\s+(.+?)(\\.|$)')) b"""
SHARED["feed_matched"] = _matched("SELECT k FROM {feed_candidates}")
_KEPT = "SELECT institution_id, notice_body, notice_type, source_url, {more} FROM {{notices}}"


@query(
    "feed_notices",
    f"""{_KEPT.format(more='subject').replace('{{', '{').replace('}}', '}')}
        UNION ALL SELECT DISTINCT m.institution_id, 'govuk', c.nt, c.link, c.title FROM {{feed_classed}} c JOIN {{feed_candidates}} n ON n.row_no = c.row_no JOIN {{feed_matched}} m ON m.k = n.k
        WHERE m.institution_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {{notices}} x WHERE x.source_url = c.link)""",
)
def _(v: Views) -> DataFrame:
    found = nf.feed_notices(v.sql(_FEED), v.institutions)
    return nf.merge_feed_notices(v.notices, found).select("institution_id", "notice_body", "notice_type", "source_url", "subject")


SHARED["list_classed"] = f"""SELECT *, {sql_name('college')} AS k, CASE WHEN regexp_matches(title, '(?i)financial') THEN 'esfa.notice_to_improve_financial' WHEN regexp_matches(title, '(?i)quality') THEN 'esfa.notice_to_improve_quality'
    WHEN regexp_matches(title, '(?i)governance') THEN 'esfa.notice_to_improve_governance' ELSE 'esfa.notice_to_improve_other' END AS nt,
    regexp_matches(title, '(?i)^(closed|revoked)\\b') OR regexp_matches(section, '(?i)closed') AS closed
  FROM (SELECT *, CASE WHEN contains(title, ':') AND coalesce(side, '') <> '' THEN side ELSE title END AS college FROM (
    SELECT *, list_filter(list_transform(string_split(title, ':'), lambda p: trim(p)), lambda p: NOT regexp_matches(p, '(?i)notice to improve|financial|quality|governance'))[1] AS side FROM {{feed}}) a) b"""
SHARED["list_matched"] = _matched("SELECT k FROM {list_classed}")


@query(
    "list_notices",
    f"""{_KEPT.format(more='withdrawn_at, CAST(severity AS INT) AS severity').replace('{{', '{').replace('}}', '}')}
        UNION ALL SELECT m.institution_id, 'esfa', c.nt, c.link, CASE WHEN c.closed THEN '{AS_OF}' END,
          CAST(CASE WHEN c.closed THEN 30 ELSE CASE c.nt WHEN 'esfa.notice_to_improve_quality' THEN 95 WHEN 'esfa.notice_to_improve_other' THEN 80 ELSE 88 END END AS INT)
        FROM {{list_classed}} c JOIN {{list_matched}} m ON m.k = c.k
        WHERE m.institution_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {{notices}} x WHERE x.source_url = c.link)""",
)
def _(v: Views) -> DataFrame:
    entries = v.sql(_FEED).withColumnRenamed("link", "href")
    found = nf.list_notices(entries, v.institutions, AS_OF)
    return nf.merge_list_notices(v.notices, found).select("institution_id", "notice_body", "notice_type", "source_url", "withdrawn_at", "severity")


@query("split_active", "SELECT id, withdrawn_at IS NULL AS is_active FROM {notices}")
def _(v: Views) -> DataFrame:
    active, closed = nf.split_active(v.notices)
    return active.withColumn("is_active", F.lit(True)).unionByName(closed.withColumn("is_active", F.lit(False))).select("id", "is_active")


# ---- register, news, inspections ---------------------------------------------


@query(
    "merge_register",
    """SELECT i.ukprn, CASE WHEN r.emp THEN 'employer' ELSE i.type END AS type, CASE WHEN r.ukprn IS NULL THEN i.source WHEN list_contains(string_split(coalesce(i.source, ''), '+'), 'apar') THEN i.source
         WHEN coalesce(i.source, '') = '' THEN 'apar' ELSE i.source || '+apar' END AS source FROM {institutions} i LEFT JOIN (SELECT ukprn, bool_or(application_type <> 'Main provider') AS emp FROM {messy} GROUP BY 1) r ON r.ukprn = i.ukprn
       UNION ALL SELECT ukprn, CASE WHEN bool_or(application_type <> 'Main provider') THEN 'employer' ELSE 'itp' END, 'apar' FROM {messy} m WHERE ukprn NOT IN (SELECT ukprn FROM {institutions} WHERE ukprn IS NOT NULL) GROUP BY 1""",
)
def _(v: Views) -> DataFrame:
    reg = _register(v).withColumn("name", F.concat(F.lit("Provider "), F.col("ukprn")))
    return ing.merge_register(reg, v.institutions).select("ukprn", "type", "source")


SHARED["news_first"] = "SELECT * FROM (SELECT n.*, row_number() OVER (PARTITION BY url, institution_id ORDER BY id) AS rn FROM {news} n) x WHERE rn = 1"


def _news_merge(v: Views) -> tuple[DataFrame, DataFrame]:
    target = v.sql(SHARED["news_first"]).withColumn("content_hash", F.lit("x"))
    again = v.news.where(F.col("source").isin("click", "view")).select(
        "url", "institution_id", "source", F.concat(F.lit("Again "), F.col("title")).alias("title"), (90 - F.col("relevance") % 40).alias("relevance"), F.col("id").alias("row_no")
    )
    new = v.orders.select(
        F.concat(F.lit("https://news.example.org/new/"), F.col("o_orderkey")).alias("url"),
        F.col("o_custkey").alias("institution_id"),
        F.lit("feed").alias("source"),
        F.concat(F.lit("New "), F.col("o_orderpriority")).alias("title"),
        F.lit(60).alias("relevance"),
        F.col("o_orderkey").alias("row_no"),
    )
    return target, again.unionByName(new)


@query(
    "merge_news",
    """SELECT url, institution_id, coalesce(f.title, t.title) AS title, CAST(coalesce(f.relevance, t.relevance) AS INT) AS relevance, CAST(coalesce(t.trigger_severity, 0) AS INT) AS trigger_severity
       FROM {news_first} t FULL JOIN (SELECT url, institution_id, arg_max('Again ' || title, id) AS title, arg_max(90 - relevance % 40, id) AS relevance FROM {news} WHERE source IN ('click', 'view') GROUP BY 1, 2
         UNION ALL SELECT 'https://news.example.org/new/' || CAST(o_orderkey AS VARCHAR), o_custkey, 'New ' || o_orderpriority, 60 FROM {orders}) f USING (url, institution_id)""",
)
def _(v: Views) -> DataFrame:
    target, found = _news_merge(v)
    return ing.merge_news(target, found).select("url", "institution_id", "title", "relevance", "trigger_severity")


@query("merge_news_stored", ORACLES["merge_news"])
def _(v: Views) -> DataFrame:
    target, found = _news_merge(v)
    table = _bucketed(v, "news-merge-table", target, "url")
    ing.merge_news_stored(table, found)
    return table.read().select("url", "institution_id", "title", "relevance", "trigger_severity")


def _inspection_file(v: Views) -> DataFrame:
    return v.messy.select(
        F.col("id").alias("row_no"),
        F.col("urn").alias("Provider  URN"),
        F.col("ukprn").alias("Provider UKPRN"),
        F.col("provider_type").alias("Provider type"),
        F.concat(F.lit("Provider "), F.col("ukprn")).alias("Provider name"),
        F.col("raw_date").alias("Inspection start date"),
        F.col("raw_grade").alias("Overall effectiveness"),
        F.col("raw_previous").alias("Previous overall effectiveness"),
        F.col("raw_bool").alias("Safeguarding is effective"),
        F.col("url").alias("Web Link"),
    )


SHARED["insp_file"] = f"""SELECT id AS row_no, nullif(urn, '') AS urn, ukprn, {sql_date('raw_date')} AS d, {sql_grade('raw_grade')} AS g FROM {{messy}}"""


#: Inspection files whose keys cross: a row may share its URN with one row and its UKPRN with another.
SHARED["fe_file"] = """SELECT id AS row_no, CASE WHEN id % 5 <> 0 THEN 'u' || CAST(id * 7 % 911 AS STRING) END AS urn, CASE WHEN id % 3 <> 0 OR id % 5 = 0 THEN 'k' || CAST(id * 13 % 1307 AS STRING) END AS ukprn FROM {messy}"""
#: Read row by row: a row creates unless its URN or UKPRN is known by then.
SHARED["fe_created"] = """SELECT row_no FROM (WITH RECURSIVE o AS (SELECT *, row_number() OVER (ORDER BY row_no) AS n FROM (SELECT min(row_no) AS row_no, urn, ukprn FROM {fe_file} GROUP BY urn, ukprn) d),
  w AS (SELECT CAST(0 AS BIGINT) AS n, CAST([] AS VARCHAR[]) AS known, CAST(NULL AS BIGINT) AS row_no
    UNION ALL SELECT o.n, CASE WHEN list_has_any(w.known, [coalesce(o.urn, '-'), coalesce(o.ukprn, '-')]) THEN w.known ELSE list_concat(w.known, list_filter([o.urn, o.ukprn], lambda x: x IS NOT NULL)) END,
      CASE WHEN list_has_any(w.known, [coalesce(o.urn, '-'), coalesce(o.ukprn, '-')]) THEN NULL ELSE o.row_no END FROM w JOIN o ON o.n = w.n + 1)
  SELECT row_no FROM w WHERE row_no IS NOT NULL) z"""


def _fe_file(v: Views) -> DataFrame:
    raw = v.sql(SHARED["fe_file"].replace("AS row_no", "AS row_no, raw_date, raw_grade, raw_previous, raw_bool, provider_type"))
    return raw.select(
        "row_no",
        F.col("urn").alias("Provider URN"),
        F.col("ukprn").alias("Provider UKPRN"),
        F.col("provider_type").alias("Provider type"),
        F.concat(F.lit("Provider "), F.col("row_no")).alias("Provider name"),
        F.col("raw_date").alias("Inspection start date"),
        F.col("raw_grade").alias("Overall effectiveness"),
        F.col("raw_previous").alias("Previous overall effectiveness"),
        F.col("raw_bool").alias("Safeguarding is effective"),
    )


@query(
    "missing_providers",
    """SELECT f.urn, f.ukprn, 'Provider ' || CAST(c.row_no AS VARCHAR) AS name FROM {fe_created} c JOIN {fe_file} f ON f.row_no = c.row_no""",
)
def _(v: Views) -> DataFrame:
    rows = ing.inspection_rows(_fe_file(v), True, "feskills_2022")
    return ing.missing_providers(rows, v.institutions).select("urn", "ukprn", "name")


_FE_EVENTS = f"""SELECT coalesce(a.row_no, b.row_no) AS lead, d, arg_max(coalesce(g, '?'), row_no_) AS overall_grade, arg_max(coalesce(pg, '?'), row_no_) AS previous_overall_grade, arg_max(coalesce(CAST(sg AS VARCHAR), '?'), row_no_) AS safeguarding
  FROM (SELECT f.row_no AS row_no_, f.urn, f.ukprn, {sql_date('m.raw_date')} AS d, {sql_grade('m.raw_grade')} AS g, {sql_grade('m.raw_previous')} AS pg,
    CASE WHEN lower(trim(m.raw_bool)) IN ('yes', 'y', 'true', '1') THEN TRUE WHEN lower(trim(m.raw_bool)) IN ('no', 'n', 'false', '0') THEN FALSE END AS sg FROM {{fe_file}} f JOIN {{messy}} m ON m.id = f.row_no) x
  LEFT JOIN (SELECT f.urn AS k, min(f.row_no) AS row_no FROM {{fe_created}} c JOIN {{fe_file}} f ON f.row_no = c.row_no WHERE f.urn IS NOT NULL GROUP BY 1) a ON a.k = x.urn
  LEFT JOIN (SELECT f.ukprn AS k, min(f.row_no) AS row_no FROM {{fe_created}} c JOIN {{fe_file}} f ON f.row_no = c.row_no WHERE f.ukprn IS NOT NULL GROUP BY 1) b ON b.k = x.ukprn
  WHERE d IS NOT NULL AND coalesce(a.row_no, b.row_no) IS NOT NULL GROUP BY 1, 2"""


@query("ingest_inspections_fe", f"SELECT 'Provider ' || CAST(lead AS VARCHAR) AS provider, d AS inspection_start_date, overall_grade, previous_overall_grade, safeguarding FROM ({_FE_EVENTS}) e")
def _(v: Views) -> DataFrame:
    """Further-education mode: providers are created, then every dated row lands on one of them."""
    inst, merged = ing.ingest_inspections(_fe_file(v), v.institutions, v.inspections.where(F.lit(False)), further_education=True)
    names = inst.where(F.col("source") == "ofsted_mi_fe").select(F.col("id").alias("institution_id"), F.col("name").alias("provider"))
    mark = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    return merged.join(names, "institution_id").select(
        "provider", "inspection_start_date", mark("overall_grade").alias("overall_grade"), mark("previous_overall_grade").alias("previous_overall_grade"),
        mark("safeguarding_effective").alias("safeguarding"),
    )


SHARED["insp_known"] = f"""SELECT institution_id, d, arg_max(coalesce(g, '?'), row_no) AS g, arg_max(coalesce(pg, '?'), row_no) AS pg, arg_max(coalesce(u, '?'), row_no) AS u FROM (SELECT f.*, {sql_grade('m.raw_previous')} AS pg,
    CASE WHEN m.url = '' THEN 'https://reports.ofsted.gov.uk/provider/23/' || coalesce(nullif(m.urn, ''), m.ukprn) ELSE regexp_replace(m.url, '^http://', 'https://') END AS u, coalesce((SELECT min(id) FROM {{institutions}} i WHERE i.urn = f.urn), (SELECT min(id) FROM {{institutions}} i WHERE i.ukprn = f.ukprn)) AS institution_id
  FROM {{insp_file}} f JOIN {{messy}} m ON m.id = f.row_no) x WHERE institution_id IS NOT NULL AND d IS NOT NULL GROUP BY 1, 2"""
SHARED["insp_target"] = """SELECT institution_id, inspection_start_date, min(id) AS id, arg_min(coalesce(overall_grade, '?'), id) AS g, arg_min(coalesce(previous_overall_grade, '?'), id) AS pg, arg_min(coalesce(report_url, '?'), id) AS u FROM {inspections} GROUP BY 1, 2"""


@query(
    "ingest_inspections",
    """SELECT coalesce(k.institution_id, t.institution_id) AS institution_id, coalesce(k.d, t.inspection_start_date) AS inspection_start_date, coalesce(k.g, t.g) AS overall_grade, coalesce(k.pg, t.pg) AS previous_overall_grade, coalesce(k.u, t.u) AS report_url
       FROM {insp_target} t FULL JOIN {insp_known} k ON k.institution_id = t.institution_id AND k.d = t.inspection_start_date""",
)
def _(v: Views) -> DataFrame:
    """School mode over the stored inspections: known events are updated, new ones inserted, the rest kept."""
    target = v.inspections.groupBy("institution_id", "inspection_start_date").agg(
        *[F.min_by(c, "id").alias(c) for c in v.inspections.columns if c not in ("institution_id", "inspection_start_date", "inspection_body")]
    ).withColumn("inspection_body", F.lit("ofsted")).select(*v.inspections.columns)
    _, merged = ing.ingest_inspections(_inspection_file(v), v.institutions, target)
    mark = lambda c: F.coalesce(F.col(c), F.lit("?")).alias(c)
    return merged.select("institution_id", "inspection_start_date", mark("overall_grade"), mark("previous_overall_grade"), mark("report_url"))


@query(
    "ingest_history",
    """SELECT coalesce(t.institution_id, s.institution_id) AS institution_id, coalesce(t.inspection_start_date, s.d) AS inspection_start_date, coalesce(s.g, t.overall_grade) AS overall_grade
       FROM (SELECT institution_id, inspection_start_date, arg_min(overall_grade, id) AS overall_grade FROM {inspections} GROUP BY 1, 2) t
       FULL JOIN (SELECT id AS institution_id, '2013-02-08' AS d, CASE WHEN type = 'itp' THEN 'good' END AS g FROM {institutions}) s ON s.institution_id = t.institution_id AND s.d = t.inspection_start_date""",
)
def _(v: Views) -> DataFrame:
    body = F.when(F.col("type") == "itp", "Full inspection: Good Full inspection, PDF - 08 February 2013").otherwise("Survey visit report, PDF - 8 Feb 2013")
    html = F.concat(F.lit('<a href="//x">none</a><a href="https://files.ofsted.gov.uk/v1/file/'), F.col("id"), F.lit('">'), body, F.lit("</a>"))
    pages = v.institutions.select(F.col("id").alias("institution_id"), "type", html.alias("html"))
    one = v.inspections.groupBy("institution_id", "inspection_start_date").agg(
        F.min("id").alias("id"), F.min_by("overall_grade", "id").alias("overall_grade"), F.min_by("report_url", "id").alias("report_url"), F.min_by("inspection_type", "id").alias("inspection_type")
    ).withColumn("inspection_body", F.lit("ofsted")).withColumn("framework", F.lit("eif"))
    return ing.ingest_history(pages, one).select("institution_id", "inspection_start_date", "overall_grade")


@query(
    "close_stale_runs",
    """SELECT id, CASE WHEN stale THEN 'failed' ELSE status END AS status, CASE WHEN stale THEN coalesce(error_message, '') || ' [auto-marked failed: process exited without recording completion]' ELSE error_message END AS error_message
       FROM (SELECT *, status = 'running' AND date_diff('second', CAST(started_at AS TIMESTAMP), TIMESTAMP '2024-01-15 00:00:00') > 3600 AS stale FROM {runs}) x""",
)
def _(v: Views) -> DataFrame:
    return ing.close_stale_runs(v.runs, "2024-01-15 00:00:00").select("id", "status", "error_message")


@query(
    "seed_commissioners",
    f"""SELECT name, type, region, source, in_scope, general_email, website FROM {{institutions}}
        UNION ALL SELECT n, 'employer', r, 'skills_bootcamps', TRUE, e, w FROM (VALUES {', '.join('(' + ', '.join('NULL' if x is None else "'" + x.replace("'", "''") + "'" for x in row) + ')' for row in COMMISSIONERS)}) c(r, n, e, w)""",
)
def _(v: Views) -> DataFrame:
    return seed_commissioners(v.institutions).select("name", "type", "region", "source", "in_scope", "general_email", "website")


# ---- entity resolution --------------------------------------------------------

_FILLED = "CASE WHEN urn <> '' THEN 5 ELSE 0 END + CASE WHEN ukprn <> '' THEN 3 ELSE 0 END + CASE WHEN website <> '' THEN 1 ELSE 0 END + CASE WHEN general_email <> '' THEN 1 ELSE 0 END + CASE WHEN postcode <> '' THEN 1 ELSE 0 END + CASE WHEN apprenticeship_standards > 0 THEN 1 ELSE 0 END"
SHARED["e_keyed"] = f"SELECT *, {sql_name('name', 'dedup')} AS k, {_FILLED} AS pts FROM {{parties}}"
SHARED["e_clusters"] = """SELECT k AS cluster_key, CAST(count(*) AS BIGINT) AS size, count(DISTINCT nullif(upper(replace(postcode, ' ', '')), '')) > 1 AS postcodes_differ,
  bool_or(type IN ('state_school', 'independent_school')) AND bool_or(type IN ('itp', 'fe_college')) AS types_mixed,
  CASE WHEN count(CASE WHEN urn <> '' THEN 1 END) = 1 THEN min(CASE WHEN urn <> '' THEN id END) ELSE arg_max(id, CAST(pts AS BIGINT) * 1000000000 - id) END AS canonical_id
  FROM {e_keyed} WHERE length(k) >= 6 GROUP BY k HAVING count(*) > 1"""
SHARED["e_map"] = """SELECT p.id AS loser_id, c.canonical_id FROM {e_keyed} p JOIN {e_clusters} c ON c.cluster_key = p.k WHERE NOT postcodes_differ AND NOT types_mixed AND p.id <> c.canonical_id"""


@query("find_clusters", "SELECT * FROM {e_clusters}")
def _(v: Views) -> DataFrame:
    return dd.find_clusters(v.parties)


@query("guard_clusters", "SELECT cluster_key, size FROM {e_clusters} WHERE NOT postcodes_differ AND NOT types_mixed")
def _(v: Views) -> DataFrame:
    return dd.guard_clusters(dd.find_clusters(v.parties)).select("cluster_key", "size")


@query("pick_canonical", "SELECT * FROM {e_map}")
def _(v: Views) -> DataFrame:
    return dd.id_map(v.parties)


def _fill(f: str, filled: str) -> str:
    return f"CASE WHEN {filled.replace('X', 'p.' + f)} THEN p.{f} ELSE coalesce((SELECT arg_max(l.{f}, l.id) FROM {{parties}} l JOIN {{e_map}} m ON m.loser_id = l.id WHERE m.canonical_id = p.id AND {filled.replace('X', 'l.' + f)}), p.{f}) END AS {f}"


_TEXT = "coalesce(X <> '', FALSE)"


@query(
    "survivorship",
    f"""SELECT p.id, {', '.join(_fill(f, _TEXT) for f in ('urn', 'ukprn', 'postcode', 'website', 'general_email', 'head_email'))}, {_fill('apprenticeship_standards', 'coalesce(X <> 0, FALSE)')},
        coalesce((SELECT arg_max(u, l_id) FROM (SELECT l.id AS l_id, array_to_string(list_concat(own, list_filter(string_split(l.source, '+'), lambda x: NOT list_contains(own, x))), '+') AS u, l.source AS ls
          FROM (SELECT list_filter(string_split(coalesce(p.source, ''), '+'), lambda x: x <> '') AS own) o, {{parties}} l JOIN {{e_map}} m ON m.loser_id = l.id WHERE m.canonical_id = p.id AND l.source <> '') z
          WHERE ls <> coalesce(p.source, '') AND u <> coalesce(p.source, '')), p.source) AS source
        FROM {{parties}} p WHERE p.id NOT IN (SELECT loser_id FROM {{e_map}})""",
)
def _(v: Views) -> DataFrame:
    cols = ["id", "urn", "ukprn", "postcode", "website", "general_email", "head_email", "apprenticeship_standards", "source"]
    return dd.survivorship(v.parties, dd.id_map(v.parties)).select(*cols)


@query(
    "repoint",
    """SELECT id, institution_id, url FROM (SELECT n.l_orderkey * 10 + n.l_linenumber AS id, coalesce(m.canonical_id, n.l_partkey) AS institution_id, n.l_returnflag || n.l_linestatus AS url,
         row_number() OVER (PARTITION BY coalesce(m.canonical_id, n.l_partkey), n.l_returnflag || n.l_linestatus ORDER BY m.loser_id NULLS FIRST, n.l_orderkey * 10 + n.l_linenumber) AS rn
       FROM {lineitem} n LEFT JOIN {e_map} m ON m.loser_id = n.l_partkey) x WHERE rn = 1""",
)
def _(v: Views) -> DataFrame:
    child = v.lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("institution_id"), F.concat("l_returnflag", "l_linestatus").alias("url")
    )
    return dd.repoint(child, dd.id_map(v.parties), ["url"])


#: Columns of the export in order; fixed values.
EXPORT_COLUMNS = """name type region local_authority postcode ukprn urn head_name head_email general_email phone website tier score
  urgency_score pipeline_value_score raw_score top_curriculum top_curriculum_score finding_count current_grade previous_grade grade_dropped
  latest_inspection_date report_url top_weakness_phrase top_weakness_quote active_compliance_count compliance_top_subject
  compliance_top_severity compliance_top_url active_news_count news_top_title news_top_severity news_top_curricula news_top_angle
  news_top_url critical_signals""".split()


def _export_text(column: str) -> str:
    """CSV does not tell an empty cell from a null one."""
    return f"nullif(CAST({column} AS VARCHAR), '') AS {column}"


# ---- readers and sinks over landed files --------------------------------------


def _landed(v: Views, label: str) -> str:
    return scratch_dir(v.spark, label)


@query(
    "read_register",
    """SELECT CAST(c_custkey AS VARCHAR) AS "URN", 'École "' || c_name || '", Ltd' AS "EstablishmentName", CASE WHEN c_acctbal > 0 THEN c_mktsegment END AS "Postcode" FROM customer""",
)
def _(v: Views) -> DataFrame:
    path = _landed(v, "register")
    v.customer.select(
        F.col("c_custkey").alias("URN"),
        F.concat(F.lit('École "'), F.col("c_name"), F.lit('", Ltd')).alias("EstablishmentName"),
        F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")).alias("Postcode"),
    ).write.csv(path, header=True, escape='"', encoding="ISO-8859-1")
    return registers.read_register(v.spark, path)


@query("read_inspections_csv", 'SELECT CAST(o_orderkey AS VARCHAR) AS "URN", o_orderpriority AS "Overall effectiveness" FROM orders')
def _(v: Views) -> DataFrame:
    path = _landed(v, "inspections")
    v.orders.select(F.col("o_orderkey").alias("\ufeffURN"), F.col("o_orderpriority").alias("Overall effectiveness")).write.csv(path, header=True)
    return registers.read_inspections_csv(v.spark, path)


@query("read_provider_register", "SELECT CAST(s_suppkey AS VARCHAR) AS \"Ukprn\", s_name AS \"Name\" FROM supplier")
def _(v: Views) -> DataFrame:
    path = _landed(v, "providers")
    rows = v.supplier.select(F.col("s_suppkey").alias("Ukprn"), F.col("s_name").alias("Name"))
    rows.coalesce(1).write.csv(path, header=True)
    return registers.read_provider_register(v.spark, path)


def _land_feeds(v: Views, label: str, item, head: str, tail: str) -> str:
    """The events as feed files of up to 500 items each."""
    path = _landed(v, label)
    items = v.events.select(F.floor(F.col("event_id") / 500).alias("file"), item.alias("item"))
    feed = F.concat(F.lit(head), F.array_join(F.collect_list("item"), ""), F.lit(tail))
    items.groupBy("file").agg(feed.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    return path


@query(
    "read_rss",
    """SELECT 'T ' || event_type AS title, ' Bold & fine ' || CAST(event_id AS VARCHAR) AS summary, 'https://x.example.org/' || CAST(event_id AS VARCHAR) AS link, '2024-03-06' AS published_at,
       left(sha1('https://x.example.org/' || CAST(event_id AS VARCHAR) || 'T ' || event_type), 16) AS content_hash FROM events WHERE event_type <> 'error'""",
)
def _(v: Views) -> DataFrame:
    eid = F.col("event_id").cast("string")
    title = F.when(F.col("event_type") == "error", "").otherwise(F.concat(F.lit("T "), F.col("event_type")))
    row = F.concat(
        F.lit("<item><title> "), title, F.lit("</title><description>&lt;b&gt;Bold&lt;/b&gt;  &amp; fine\t"), eid,
        F.lit("</description><link>https://x.example.org/"), eid, F.lit("</link><pubDate>Tue, 05 Mar 2024 23:30:00 -0200</pubDate></item>"),
    )
    return feeds.read_rss(v.spark, _land_feeds(v, "rss", row, "<rss><channel>", "</channel></rss>"))


@query(
    "read_atom",
    """SELECT 'A ' || event_type AS title, 'S' || CAST(event_id AS VARCHAR) AS summary, 'https://y.example.org/' || CAST(event_id AS VARCHAR) AS link, CAST(CAST(ts AS DATE) AS VARCHAR) AS published_at,
       left(sha1('https://y.example.org/' || CAST(event_id AS VARCHAR) || 'A ' || event_type), 16) AS content_hash FROM events""",
)
def _(v: Views) -> DataFrame:
    eid = F.col("event_id").cast("string")
    row = F.concat(
        F.lit("<entry><title>A "), F.col("event_type"), F.lit("</title><summary>S"), eid, F.lit('</summary><link rel="alternate" href="https://y.example.org/'), eid,
        F.lit('"/><updated>'), F.col("ts").cast("date").cast("string"), F.lit("T10:00:00Z</updated></entry>"),
    )
    return feeds.read_atom(v.spark, _land_feeds(v, "atom", row, "<feed>", "</feed>"))


@query(
    "load_phrases",
    """SELECT DISTINCT 'p.' || p_brand || '.' || CAST(p_size AS VARCHAR) AS id, p_brand || ' (' || CAST(p_size AS VARCHAR) || ')' AS pattern, FALSE AS regex, CAST(1 + p_size % 3 AS INT) AS severity,
       'online_safety' AS curriculum, 'not ' || p_brand AS guard FROM part""",
)
def _(v: Views) -> DataFrame:
    """Phrase files written from the kinds of parts, loaded as a library (as many phrases as there are kinds)."""
    path = _landed(v, "phrases")
    kinds = v.part.select("p_brand", "p_size").distinct()
    line = F.format_string(
        '{"id": "p.%s.%s", "pattern": "%s (%s)", "severity": %s, "curricula": ["online_safety"], "guards": ["not %s"]}',
        "p_brand", "p_size", "p_brand", "p_size", (1 + F.col("p_size") % 3), "p_brand",
    )
    files = kinds.groupBy("p_brand").agg(F.concat(F.lit('{"phrases": ['), F.array_join(F.collect_list(line), ","), F.lit("]}")).alias("value"))
    files.write.option("maxRecordsPerFile", 1).partitionBy("p_brand").text(path)
    library = load_phrases(v.spark, path, "*.txt")  # Spark names its part files .txt; they hold JSON
    return library.select("id", "pattern", "regex", "severity", F.get("curricula", F.lit(0)).alias("curriculum"), F.get("guards", F.lit(0)).alias("guard"))


@query(
    "ingest_register",
    """SELECT CAST(urn AS VARCHAR) AS urn, name, type, website FROM {institutions} WHERE urn IS NULL OR CAST(urn AS BIGINT) % 2 = 1
       UNION ALL SELECT urn, name || ' X', 'state_school', coalesce(website, 'none') FROM {institutions} WHERE CAST(urn AS BIGINT) % 2 = 0
       UNION ALL SELECT 'new' || CAST(o_orderkey AS VARCHAR), o_orderpriority, 'fe_college', NULL FROM {orders}""",
)
def _(v: Views) -> DataFrame:
    known = v.institutions.where(F.col("urn").cast("bigint") % 2 == 0).select(
        F.col("urn").alias("URN"), F.concat("name", F.lit(" X")).alias("EstablishmentName"), F.lit("Community school").alias("TypeOfEstablishment (name)"), F.coalesce("website", F.lit("none")).alias("SchoolWebsite")
    )
    new = v.orders.select(
        F.concat(F.lit("new"), F.col("o_orderkey")).alias("URN"), F.col("o_orderpriority").alias("EstablishmentName"), F.lit("Further education").alias("TypeOfEstablishment (name)"), F.lit("").alias("SchoolWebsite")
    )
    return ing.ingest_register(known.unionByName(new), v.institutions).select("urn", "name", "type", "website")


@query("write_export", f"SELECT {', '.join(_export_text(c) for c in EXPORT_COLUMNS)} FROM ({EXPORT}) x")
def _(v: Views) -> DataFrame:
    from tierline.plans.lists import opportunity_export

    path = _landed(v, "export")
    sinks.write_export(opportunity_export(tables(v)), path)
    return v.spark.read.csv(path, header=True, escape='"', multiLine=True)


SHARED["brief_lines"] = BRIEF_SQL(["critical", "high"], ["itp"], AS_OF)


@query(
    "write_briefs",
    """SELECT file_name, CAST(unnest(range(1, len(w) + 1)) AS BIGINT) AS line, unnest(w) AS text FROM (
         SELECT file_name, string_split(string_agg(text, chr(10) ORDER BY block, place, item_id), chr(10)) AS w FROM {brief_lines} GROUP BY 1) x""",
)
def _(v: Views) -> DataFrame:
    """Every line of every written document, read back in the order of its parts."""
    from tierline.plans.briefs import briefs

    from .q_reports import _full_tables

    path = _landed(v, "briefs")
    lines = briefs(_full_tables(v), ["critical", "high"], ["itp"], AS_OF)
    sinks.write_briefs(lines, path)
    # a document is a small file, of which Spark reads few in one task
    back = v.spark.read.text(path).coalesce(int(v.spark.conf.get("spark.sql.shuffle.partitions")))
    back = back.select("file_name", "value", "_metadata.file_name", "_metadata.file_block_start", F.monotonically_increasing_id().alias("at"))
    back = back.toDF("file_name", "text", "part", "start", "at")
    place = F.expr("row_number() OVER (PARTITION BY file_name ORDER BY part, start, at)").cast("long")
    return back.select("file_name", place.alias("line"), "text")


SHARED["sights"] = """SELECT id, url, institution_id, source, title, excerpt || ' ' || CAST(id % 5 AS STRING) AS excerpt, published_at, relevance + CAST(id % 3 AS INT) AS relevance, 'h' || CAST(id % 4 AS STRING) AS content_hash,
  CAST('2024-02-01' AS DATE) + CAST(id * 37 % 400 AS INT) AS seen_on FROM {news}
  UNION ALL SELECT id, url, institution_id, source, 'Again ' || title, excerpt, published_at, relevance + 1, 'again', CAST('2024-06-01' AS DATE) + CAST(id * 11 % 300 AS INT) FROM {news} WHERE id % 3 = 0"""


@query(
    "stream_merge_news",
    """SELECT url, institution_id, arg_max(title, CAST(seen_on AS VARCHAR) || lpad(CAST(id AS VARCHAR), 20, '0')) AS title, arg_max(excerpt, CAST(seen_on AS VARCHAR) || lpad(CAST(id AS VARCHAR), 20, '0')) AS excerpt,
       CAST(arg_max(relevance, CAST(seen_on AS VARCHAR) || lpad(CAST(id AS VARCHAR), 20, '0')) AS INT) AS relevance FROM (SELECT * FROM {sights} QUALIFY row_number() OVER (PARTITION BY url, institution_id, seen_on ORDER BY id DESC, title DESC) = 1) x GROUP BY 1, 2""",
)
def _(v: Views) -> DataFrame:
    """All sights of all pairs, streamed in four batches out of order, with a compaction between; sights of one pair and
    time are told apart by adding the id as microseconds."""
    land, table, check = (_landed(v, x) for x in ("news-in", "news-table", "news-check"))
    sights = v.sql(SHARED["sights"])
    sights = sights.dropDuplicates(["url", "institution_id", "seen_on", "id", "title"])
    last = F.expr("row_number() OVER (PARTITION BY url, institution_id, seen_on ORDER BY id, title)")
    shaped = sights.withColumn("seen_at", F.timestamp_add("MICROSECOND", last, F.col("seen_on").cast("timestamp"))).drop("id", "seen_on")
    shaped.repartition(4, F.xxhash64("seen_at", "content_hash")).write.parquet(land)
    schema = v.spark.read.parquet(land).schema
    stream = v.spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).parquet(land)
    stream_merge_news(stream, table, check).awaitTermination()
    compact(v.spark, table)
    return current_news(v.spark, table).select("url", "institution_id", "title", "excerpt", "relevance")


#: Most files that each source of ``stream_feeds`` lands.
FEED_FILES = 16
SHARED["feed_items"] = """SELECT id, 'https://feeds.example.org/' || CAST(id AS STRING) AS link, CASE WHEN id % 5 = 0 THEN 'Unnamed provider in the news' ELSE 'Visit to ' || name || ' Ltd' END AS title,
  'Staff of ' || CASE WHEN id % 3 = 0 THEN name ELSE 'the site' END || ' met on day ' || CAST(id % 28 AS STRING) AS summary FROM {institutions}"""


@query(
    "stream_feeds",
    f"""WITH d AS (SELECT id, {sql_name('name', 'news')} AS k FROM {{institutions}} WHERE in_scope),
        u AS (SELECT * FROM d WHERE length(k) >= 8 AND len(list_filter(string_split(k, ' '), lambda w: length(w) >= 3)) >= 2),
        a AS (SELECT link, title, summary, ' ' || {sql_name("title || chr(10) || summary", 'news')} || ' ' AS t FROM {{feed_items}})
        SELECT a.link AS url, u.id AS institution_id, a.title, a.summary AS excerpt, CAST(50 + least(40, floor(length(u.k) / 2)) AS INT) AS relevance, '2024-03-06' AS published_at,
        left(sha1(a.link || a.title), 16) AS content_hash FROM a JOIN u ON contains(a.t, ' ' || u.k || ' ') QUALIFY row_number() OVER (PARTITION BY a.link ORDER BY u.id) <= 3""",
)
def _(v: Views) -> DataFrame:
    """An article for each institution, as feed files of two sources, streamed from XML to the table in several batches."""
    land, index, table, check = (_landed(v, x) for x in ("feed-in", "feed-index", "feed-table", "feed-check"))
    store_mention_index(v.institutions, index)
    xml = lambda c: F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    item = F.concat(
        F.lit("<item><title>"), xml("title"), F.lit("</title><description>"), xml("summary"), F.lit("</description><link>"), F.col("link"),
        F.lit("</link><pubDate>Tue, 05 Mar 2024 23:30:00 -0200</pubDate></item>"),
    )
    # batches have their own cost: beyond 80,000 institutions the files grow, not their number
    cut = min(FEED_FILES, -(-v.institutions.count() // 5000)) or 1
    files = v.sql(SHARED["feed_items"]).groupBy((F.col("id") % 2).alias("source"), F.pmod(F.xxhash64("id"), F.lit(cut)).alias("file"))
    feed = F.concat(F.lit("<rss><channel>"), F.array_join(F.collect_list(item), ""), F.lit("</channel></rss>"))
    files.agg(feed.alias("value")).select("source", "value").write.option("maxRecordsPerFile", 1).partitionBy("source").text(land)
    stream_feeds(v.spark, land, index, table, check, files_per_batch=2, compact_every=2).awaitTermination()
    return current_news(v.spark, table).select("url", "institution_id", "title", "excerpt", "relevance", "published_at", "content_hash")
