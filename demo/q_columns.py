"""Column functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierline import functions as fn
from tierline.functions.text import half_up

from .registry import SHARED, query
from .views import AS_OF, Views

# The oracles restate each rule in SQL; regexes there are RE2 with ASCII edges.


def sql_trim(x: str) -> str:
    return f"trim({x}, ' ' || chr(9) || chr(10) || chr(13) || chr(160))"


def sql_grade(x: str) -> str:
    s, n = f"lower(trim({x}))", f"trim(regexp_replace(lower(trim({x})), '^grade\\s*', ''))"
    return f"""CASE WHEN {x} IS NULL OR trim({x}) IN ('', 'NULL') THEN NULL
      WHEN {n} = '1' THEN 'outstanding' WHEN {n} = '2' THEN 'good' WHEN {n} = '3' THEN 'requires_improvement'
      WHEN {n} = '4' THEN 'inadequate'
      WHEN {s} IN ('outstanding', 'exceptional') THEN 'outstanding'
      WHEN {s} IN ('good', 'strong standard', 'strong', 'expected standard', 'expected') THEN 'good'
      WHEN {s} IN ('requires improvement', 'requires_improvement', 'ri', 'needs attention') THEN 'requires_improvement'
      WHEN {s} IN ('inadequate', 'serious weaknesses', 'special measures', 'urgent improvement') THEN 'inadequate'
      WHEN {s} = 'met' THEN 'meets_standard' WHEN {s} = 'not met' THEN 'does_not_meet_standard'
      WHEN contains({s}, 'meets the standard') OR contains({s}, 'meets standard') THEN 'meets_standard'
      WHEN contains({s}, 'does not meet') OR starts_with({s}, 'not met') THEN 'does_not_meet_standard'
      WHEN {s} IN ('no formal designation', 'not graded') THEN 'not_judged' END"""


def sql_rank(x: str) -> str:
    return f"CASE {x} WHEN 'outstanding' THEN 1 WHEN 'good' THEN 2 WHEN 'requires_improvement' THEN 3 WHEN 'inadequate' THEN 4 END"


def sql_label(x: str) -> str:
    return f"""CASE WHEN {x} IS NULL OR {x} = '' THEN '—' WHEN {x} = 'outstanding' THEN 'Outstanding' WHEN {x} = 'good' THEN 'Good'
      WHEN {x} = 'requires_improvement' THEN 'Requires improvement' WHEN {x} = 'inadequate' THEN 'Inadequate'
      WHEN {x} = 'meets_standard' THEN 'Meets the standard' WHEN {x} = 'does_not_meet_standard' THEN 'Does not meet the standard'
      WHEN {x} = 'not_judged' THEN 'Not judged' ELSE {x} END"""


def sql_date(x: str) -> str:
    t = f"trim({x})"
    dmy = "^([0-9]{{1,2}})[/]([0-9]{{1,2}})[/]([0-9]{{4}})$".replace("{{", "{").replace("}}", "}")
    dash = dmy.replace("[/]", "-")
    named = "^([0-9]{1,2})\\s+([A-Za-z]+)\\s+([0-9]{4})$"
    month = f"list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], left(lower(regexp_extract({t}, '{named}', 2)), 3))"

    def built(p: str) -> str:
        return (
            f"regexp_extract({t}, '{p}', 3) || '-' || lpad(regexp_extract({t}, '{p}', 2), 2, '0') || '-' "
            f"|| lpad(regexp_extract({t}, '{p}', 1), 2, '0')"
        )

    return f"""CASE WHEN regexp_matches({t}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN left({t}, 10)
      WHEN regexp_matches({t}, '{dmy}') THEN {built(dmy)}
      WHEN regexp_matches({t}, '{dash}') THEN {built(dash)}
      WHEN regexp_matches({t}, '{named}') AND {month} > 0 THEN regexp_extract({t}, '{named}', 3) || '-'
        || lpad(CAST({month} AS VARCHAR), 2, '0') || '-' || lpad(regexp_extract({t}, '{named}', 1), 2, '0') END""".replace(
        "{4}", "{4}"
    )


def sql_bool(x: str) -> str:
    return f"CASE WHEN lower(trim({x})) IN ('yes','y','true','1') THEN TRUE WHEN lower(trim({x})) IN ('no','n','false','0') THEN FALSE END"


@query("normalise_grade", f"SELECT id, raw_grade, {sql_grade('raw_grade')} AS grade FROM {{messy}}")
def _(v: Views) -> DataFrame:
    return v.messy.select("id", "raw_grade", fn.normalise_grade(F.col("raw_grade")).alias("grade"))


@query(
    "grade_urgency",
    """SELECT id, CASE WHEN overall_grade IN ('inadequate','does_not_meet_standard') THEN CAST(1.0 AS DOUBLE)
       WHEN overall_grade = 'requires_improvement' THEN CAST(0.72 AS DOUBLE) WHEN overall_grade = 'good' THEN CAST(-0.1 AS DOUBLE)
       WHEN overall_grade = 'outstanding' THEN CAST(-0.3 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS urgency FROM {inspections}""",
)
def _(v: Views) -> DataFrame:
    return v.inspections.select("id", fn.grade_urgency(F.col("overall_grade")).alias("urgency"))


@query(
    "is_grade_drop",
    f"""SELECT id, coalesce({sql_rank('g')} > {sql_rank('p')}, FALSE) AS dropped
        FROM (SELECT id, {sql_grade('raw_grade')} AS g, {sql_grade('raw_previous')} AS p FROM {{messy}}) x""",
)
def _(v: Views) -> DataFrame:
    g, p = fn.normalise_grade(F.col("raw_grade")), fn.normalise_grade(F.col("raw_previous"))
    return v.messy.select("id", fn.is_grade_drop(g, p).alias("dropped"))


@query(
    "grade_labels",
    f"""SELECT id, {sql_label('g')} AS long_label,
        CASE g WHEN 'meets_standard' THEN 'Met' WHEN 'does_not_meet_standard' THEN 'Not met'
          ELSE CASE WHEN g IS NULL THEN NULL ELSE {sql_label('g')} END END AS short_label,
        CASE WHEN g IS NULL THEN '—' ELSE array_to_string(list_transform(string_split(g, '_'), lambda w: upper(w[1]) || w[2:]), ' ') END AS title_text
        FROM (SELECT id, overall_grade AS g FROM {{inspections}}
              UNION ALL SELECT -id, previous_overall_grade FROM {{inspections}}) x""",
)
def _(v: Views) -> DataFrame:
    g = v.inspections.select("id", F.col("overall_grade").alias("g")).unionByName(
        v.inspections.select((-F.col("id")).alias("id"), F.col("previous_overall_grade").alias("g"))
    )
    return g.select(
        "id",
        fn.grade_label(F.col("g")).alias("long_label"),
        fn.pretty_grade(F.col("g")).alias("short_label"),
        fn.title_label(F.col("g")).alias("title_text"),
    )


@query("parse_inspection_date", f"SELECT id, raw_date, {sql_date('raw_date')} AS day FROM {{messy}}")
def _(v: Views) -> DataFrame:
    return v.messy.select("id", "raw_date", fn.parse_inspection_date(F.col("raw_date")).alias("day"))


@query("parse_bool", f"SELECT id, {sql_bool('raw_bool')} AS flag FROM {{messy}}")
def _(v: Views) -> DataFrame:
    return v.messy.select("id", fn.parse_bool(F.col("raw_bool")).alias("flag"))


@query(
    "pick_alias",
    """SELECT id, coalesce(nullif(nullif(raw_grade, ''), 'NULL'), nullif(nullif(raw_previous, ''), 'NULL')) AS picked,
       coalesce(nullif(raw_grade, ''), nullif(raw_previous, '')) AS plain FROM {messy}""",
)
def _(v: Views) -> DataFrame:
    raw = v.messy.select(
        "id", F.col("raw_grade").alias("Overall   Effectiveness"), F.col("raw_previous").alias("previous grade")
    )
    return raw.select(
        "id",
        fn.pick(raw, "Overall effectiveness", "Previous  Grade").alias("picked"),
        fn.pick(raw, "Overall   Effectiveness", "previous grade", null_word=None, loose=False).alias("plain"),
    )


@query(
    "parse_age",
    "SELECT id, TRY_CAST(nullif(regexp_extract(raw_age, '^\\s*([+-]?[0-9]+)', 1), '') AS INT) AS age FROM {messy}",
)
def _(v: Views) -> DataFrame:
    return v.messy.select("id", fn.parse_age(F.col("raw_age")).alias("age"))


@query(
    "join_nonblank",
    """SELECT id, nullif(concat_ws(', ', nullif(raw_age, ''), nullif(raw_standards, ''), nullif(urn, '')), '') AS joined FROM {messy}""",
)
def _(v: Views) -> DataFrame:
    return v.messy.select("id", fn.join_nonblank(", ", *[F.col(c) for c in ("raw_age", "raw_standards", "urn")]).alias("joined"))


_AGE = "TRY_CAST(nullif(regexp_extract(raw_age, '^\\s*([+-]?[0-9]+)', 1), '') AS INT)"


@query(
    "classify_scope",
    f"""SELECT id, reason IS NULL AS in_scope, reason FROM (SELECT id,
        CASE WHEN status <> '' AND status <> 'Open' THEN 'status=' || status
          WHEN type_name IN ('Online provider', 'Miscellaneous') THEN 'type=' || type_name
          WHEN phase IN ('Primary', 'Middle deemed primary') THEN 'phase=' || phase
          WHEN age < 14 THEN 'high_age=' || CAST(age AS VARCHAR) || ' < 14 (no Year 9)'
          WHEN phase = 'Mystery phase' AND age IS NULL THEN 'phase=' || phase END AS reason
        FROM (SELECT *, {_AGE} AS age FROM {{messy}}) m) x""",
)
def _(v: Views) -> DataFrame:
    scope = fn.classify_scope(F.col("status"), F.col("phase"), F.col("type_name"), fn.parse_age(F.col("raw_age")))
    return v.messy.select("id", scope.alias("s")).select("id", "s.*")


@query(
    "map_types",
    """SELECT id, CASE WHEN type_name LIKE '%independent s%' THEN 'independent_school'
        WHEN type_name IN ('Sixth form centres', 'Academy 16-19 converter', 'Free schools 16 to 19') THEN 'sixth_form_college'
        WHEN type_name = 'Further education' THEN 'fe_college' ELSE 'state_school' END AS institution_type,
        CASE WHEN application_type = 'Main provider' THEN 'itp' ELSE 'employer' END AS register_type,
        CASE provider_type WHEN 'General FE college' THEN 'fe_college' ELSE 'itp' END AS provider_type
        FROM {messy}""",
)
def _(v: Views) -> DataFrame:
    return v.messy.select(
        "id",
        fn.map_institution_type(F.col("type_name")).alias("institution_type"),
        fn.map_register_type(F.col("application_type")).alias("register_type"),
        fn.map_provider_type(F.col("provider_type")).alias("provider_type"),
    )


@query(
    "report_urls",
    """SELECT id, CASE WHEN url = '' THEN 'https://reports.ofsted.gov.uk/provider/33/' || coalesce(nullif(urn, ''), ukprn)
         ELSE regexp_replace(url, '^http://', 'https://') END AS repaired,
       CASE WHEN NOT regexp_matches(url, '^https?://www\\.ofsted\\.gov\\.uk/') THEN url
         ELSE 'https://reports.ofsted.gov.uk/provider/' || CASE type WHEN 'state_school' THEN '23' WHEN 'independent_school' THEN '21'
           WHEN 'sixth_form_college' THEN '46' WHEN 'fe_college' THEN '31' WHEN 'itp' THEN '33' ELSE '23' END || '/' ||
           coalesce(nullif(regexp_extract(url, '/provider/[^/]+/([0-9]{4,8})', 1), ''), nullif(regexp_extract(url, '/([0-9]{4,8})(?:[/?#]|$)', 1), ''))
         END AS resolved
       FROM (SELECT id, institution_id, url, urn, ukprn FROM {messy}) m JOIN (SELECT id AS iid, type FROM {institutions}) i ON i.iid = m.institution_id""",
)
def _(v: Views) -> DataFrame:
    df = v.messy.join(v.institutions.select(F.col("id").alias("institution_id"), "type"), "institution_id")
    return df.select(
        "id",
        fn.repair_report_url(F.col("url"), F.col("urn"), F.col("ukprn"), True).alias("repaired"),
        fn.resolve_report_url(F.col("url"), F.col("type")).alias("resolved"),
    )


_SIX = "CASE {x} WHEN 'outstanding' THEN 1 WHEN 'good' THEN 2 WHEN 'meets_standard' THEN 2 WHEN 'requires_improvement' THEN 3 WHEN 'inadequate' THEN 4 WHEN 'does_not_meet_standard' THEN 4 END"
_SUBS = ["quality_of_education", "behaviour_attitudes", "personal_development", "leadership_management", "apprenticeships", "adult_learning_programmes"]


@query(
    "synthesise_overall",
    f"""SELECT id, coalesce(CASE WHEN overall_grade <> 'not_judged' THEN overall_grade END, (SELECT arg_max(g, r * 10 - p) FROM
        (VALUES {', '.join(f'({c}, {_SIX.format(x=c)}, {i})' for i, c in enumerate(_SUBS))}) t(g, r, p) WHERE r IS NOT NULL)) AS overall
        FROM {{inspections}}""",
)
def _(v: Views) -> DataFrame:
    stated = F.when(F.col("overall_grade") != "not_judged", F.col("overall_grade"))
    return v.inspections.select("id", fn.synthesise_overall(stated, *[F.col(c) for c in _SUBS]).alias("overall"))


@query(
    "safeguarding",
    f"SELECT id, coalesce({sql_bool('raw_bool')}, CASE raw_standards WHEN 'Met' THEN TRUE WHEN 'Not met' THEN FALSE END) AS safe FROM {{messy}}",
)
def _(v: Views) -> DataFrame:
    return v.messy.select("id", fn.safeguarding(F.col("raw_bool"), F.col("raw_standards")).alias("safe"))


@query(
    "clean_report_text",
    """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, chr(13), ''), '-\\n([a-z])', '\\1', 'g'),
        '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]+', ' ', 'g'), ' ' || chr(9) || chr(10) || chr(13)) AS cleaned
       FROM (SELECT doc_id, replace(replace(text, 'th', 'th-' || chr(10)), '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || '  ') AS text FROM {documents}) d""",
)
def _(v: Views) -> DataFrame:
    df = v.sql(
        "SELECT doc_id, replace(replace(text, 'th', 'th-' || chr(10)), '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || '  ') AS text FROM {documents}"
    )
    return df.select("doc_id", fn.clean_report_text(F.col("text")).alias("cleaned"))


_W = {
    "legal": "\\b(ltd|limited|llp|plc|cic|cio)\\b",
    "article": "\\b(the|a|an)\\b",
    "filler": "\\b(group|holdings|services|company)\\b",
}


def sql_name(x: str, variant: str = "notice") -> str:
    out = f"lower({x})"
    if variant == "company":
        rules = ["\\b(ltd|limited|llp|plc|cic|cio|t/a)\\b"]
    elif variant == "dedup":
        rules = [_W["legal"], "\\b(the|a|an|t/a|trading as)\\b", _W["filler"]]
    else:
        rules = [_W["legal"], _W["article"], "\\b(t/a|trading as)\\b.*$", _W["filler"]]
    for r in rules:
        out = f"regexp_replace({out}, '{r}', ' ', 'g')"
    return f"trim(regexp_replace(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'), ' +', ' ', 'g'))"


_NAMES = """SELECT id, name || CASE id % 4 WHEN 0 THEN ' t/a The Learning Co' WHEN 1 THEN ' trading as A&B Skills' WHEN 2 THEN ' (St. Mary''s) School' ELSE '' END AS name FROM {institutions}"""


@query(
    "norm_name",
    f"""SELECT id, {sql_name('name')} AS notice_key, {sql_name('name', 'news')} AS news_key, {sql_name('name', 'company')} AS company_key,
        {sql_name('name', 'dedup')} AS dedup_key FROM ({_NAMES}) n""",
)
def _(v: Views) -> DataFrame:
    return v.sql(_NAMES).select(
        "id", *[fn.norm_name(F.col("name"), k).alias(f"{k}_key") for k in ("notice", "news", "company", "dedup")]
    )


@query(
    "norm_school_name",
    f"""SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(lower(name), '''', ''), '&', 'and'),
        '\\b(school|college|the|of|and|st\\.?)\\b', '', 'g'), '[^a-z0-9]', ' ', 'g'), '\\s+', ' ', 'g')) AS school_key FROM ({_NAMES}) n""",
)
def _(v: Views) -> DataFrame:
    return v.sql(_NAMES).select("id", fn.norm_school_name(F.col("name")).alias("school_key"))


@query(
    "slugify",
    "SELECT id, left(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60) AS slug FROM {institutions}",
)
def _(v: Views) -> DataFrame:
    return v.institutions.select("id", fn.slugify(F.col("name"), width=60).alias("slug"))


@query(
    "split_person_name",
    """SELECT id, p[1] AS first_name, nullif(array_to_string(p[2:], ' '), '') AS last_name FROM
       (SELECT id, CASE WHEN head_name <> '' THEN string_split_regex(trim(regexp_replace(head_name, '^(mr|mrs|ms|miss|mx|dr|prof)\\.?\\s+', '', 'i')), '\\s+') END AS p
        FROM {institutions}) x""",
)
def _(v: Views) -> DataFrame:
    return v.institutions.select("id", fn.split_name(F.col("head_name")).alias("p")).select(
        "id", F.col("p.first").alias("first_name"), F.col("p.last").alias("last_name")
    )


@query(
    "phrase_label",
    """SELECT id, array_to_string(list_transform(string_split(replace(regexp_replace(phrase_id, '^[a-z_]+\\.', ''), '_', ' '), ' '),
       lambda w: upper(w[1]) || w[2:]), ' ') AS label FROM {findings}""",
)
def _(v: Views) -> DataFrame:
    return v.findings.select("id", fn.phrase_label(F.col("phrase_id")).alias("label"))


@query(
    "reclassify_universities",
    """SELECT id, CASE WHEN t = 'itp' AND in_scope AND regexp_matches(name, '(?i)\\buniversity of \\w+|\\b\\w+ university\\b|\\buniversity college \\w+')
       AND NOT regexp_matches(name, '(?i)\\b(nhs|hospital|hospitals|trust|primary|secondary|further education|fe college)\\b')
       THEN 'university' ELSE t END AS type
       FROM (SELECT id, name, in_scope, CASE type WHEN 'university' THEN 'itp' ELSE type END AS t FROM {institutions}) x""",
)
def _(v: Views) -> DataFrame:
    return v.institutions.select(
        "id", fn.reclassify_universities(F.col("type"), F.col("name"), F.col("in_scope")).alias("type")
    )


@query(
    "classify_register_status",
    """SELECT id, CASE WHEN s = '' THEN NULL WHEN s LIKE '%not currently starting%' THEN 'apar.not_currently_starting_new_apprentices'
         WHEN s LIKE '%removed%' THEN 'apar.removed' WHEN s LIKE '%suspended%' THEN 'apar.suspended'
         WHEN s LIKE '%conditions%' THEN 'apar.conditions_imposed' ELSE 'apar.status_other' END AS notice_type,
       CASE WHEN s = '' THEN NULL WHEN s LIKE '%not currently starting%' THEN 'APAR status: Not currently starting new apprentices (regulatory restriction)'
         WHEN s LIKE '%removed%' THEN 'APAR status: Removed from register' WHEN s LIKE '%suspended%' THEN 'APAR status: Suspended'
         WHEN s LIKE '%conditions%' THEN 'APAR status: Conditions imposed' ELSE 'APAR status: ' || trim(register_status) END AS subject
       FROM (SELECT id, register_status, lower(trim(register_status)) AS s FROM {messy}) x""",
)
def _(v: Views) -> DataFrame:
    return v.messy.select("id", fn.classify_register_status(F.col("register_status")).alias("c")).select("id", "c.*")


@query(
    "notice_severity",
    """SELECT id, CAST(CASE notice_type WHEN 'apar.removed' THEN 95 WHEN 'apar.suspended' THEN 92 WHEN 'apar.conditions_imposed' THEN 80
         WHEN 'apar.status_other' THEN 60 WHEN 'esfa.notice_to_improve_quality' THEN 95 WHEN 'esfa.notice_to_improve_financial' THEN 88
         WHEN 'esfa.notice_to_improve_other' THEN 80 WHEN 'companies_house.accounts_overdue' THEN 70 ELSE 50 END AS INT) AS rated FROM {notices}""",
)
def _(v: Views) -> DataFrame:
    return v.notices.select("id", fn.severity_for(F.col("notice_type")).alias("rated"))


_ENTRIES = """SELECT event_id AS id, 'Provider ' || CAST(user_id AS STRING) || ': ' || CASE event_type WHEN 'click' THEN 'Notice to Improve issued'
  WHEN 'view' THEN 'FE  Commissioner visit' WHEN 'purchase' THEN 'open day' WHEN 'error' THEN 'fraud charges, report on Site ' || CAST(user_id AS STRING) || '. Details'
  ELSE 'statutory intervention: quality' END AS title,
  CASE WHEN value > 100 THEN 'Removed from the register after a notice issued to Some Body' WHEN value > 40 THEN 'Minimum standards not kept' ELSE 'Nothing to add' END AS summary,
  CASE WHEN value > 150 THEN 'Closed notices' ELSE 'Open notices' END AS section
  FROM {events}"""
_KEYS = [
    "\\bnotice to improve\\b", "\\bfinancial notice\\b", "\\bquality notice\\b", "\\bgovernance notice\\b", "\\bintervention\\b",
    "\\bremoved from\\s+(?:the\\s+)?(?:register|apar|roatp)\\b", "\\bsuspended from\\s+(?:apar|roatp)\\b",
    "\\bsubcontracting standard\\b", "\\bminimum standards\\b", "\\b(?:fe\\s+)?commissioner\\b",
    "\\bsafeguarding (?:concern|failure|investigation)\\b", "\\bfraud (?:investigation|charges?)\\b",
]


@query(
    "classify_feed_entry",
    f"""SELECT id, CASE WHEN matched IS NULL THEN NULL WHEN regexp_matches(t, '(?i)notice to improve|financial notice|quality notice|governance notice')
          THEN 'govuk.notice_issued' WHEN regexp_matches(t, '(?i)intervention|commissioner') THEN 'govuk.intervention_announced'
          ELSE 'govuk.compliance_action' END AS notice_type, matched
        FROM (SELECT id, t, coalesce({', '.join(f"nullif(regexp_extract(t, '(?i){k}', 0), '')" for k in _KEYS)}) AS matched
              FROM (SELECT id, title || chr(10) || summary AS t FROM ({_ENTRIES}) e) x) y""",
)
def _(v: Views) -> DataFrame:
    df = v.sql(_ENTRIES).select("id", fn.classify_feed_entry(F.col("title"), F.col("summary")).alias("c"))
    return df.select("id", "c.notice_type", "c.matched")


@query(
    "name_candidates",
    f"""SELECT id, array_to_string(list_filter(list_transform(string_split(title, ':'), lambda p: trim(p)),
          lambda p: length(p) >= 6 AND regexp_matches(p, '[A-Z]')), '|')
        || CASE WHEN regexp_extract(title, '(?i)(?:report on|notice (?:issued )?to)\\s+(.+?)(?:\\.|$)', 1) <> ''
             THEN '|' || trim(regexp_extract(title, '(?i)(?:report on|notice (?:issued )?to)\\s+(.+?)(?:\\.|$)', 1)) ELSE '' END AS names
        FROM ({_ENTRIES}) e""",
)
def _(v: Views) -> DataFrame:
    return v.sql(_ENTRIES).select("id", F.array_join(fn.name_candidates(F.col("title")), "|").alias("names"))


@query(
    "classify_notice_title",
    f"""SELECT id, coalesce(nullif(list_filter(list_transform(string_split(title, ':'), lambda p: trim(p)),
          lambda p: NOT regexp_matches(p, '(?i)notice to improve|financial|quality|governance'))[1], ''), title) AS college,
        CASE WHEN regexp_matches(title, '(?i)financial') THEN 'esfa.notice_to_improve_financial' WHEN regexp_matches(title, '(?i)quality')
          THEN 'esfa.notice_to_improve_quality' ELSE 'esfa.notice_to_improve_other' END AS notice_type,
        section LIKE 'Closed%' AS closed,
        CAST(CASE WHEN section LIKE 'Closed%' THEN 30 WHEN regexp_matches(title, '(?i)quality') THEN 95 ELSE 80 END AS INT) AS severity,
        CASE WHEN section LIKE 'Closed%' THEN '{AS_OF}' END AS withdrawn_at FROM ({_ENTRIES}) e""",
)
def _(v: Views) -> DataFrame:
    c = fn.classify_notice_title(F.col("title"), F.col("section"), AS_OF)
    return v.sql(_ENTRIES).select("id", c.alias("c")).select("id", "c.*")


@query(
    "keyword_gate",
    """SELECT id, hit, CAST(CASE WHEN hit THEN relevance WHEN length(title) > 0 THEN 30 ELSE 10 END AS INT) AS relevance,
       CAST(CASE WHEN hit THEN trigger_severity ELSE 0 END AS INT) AS trigger_severity,
       CASE WHEN hit THEN angle ELSE 'filtered: no signal keywords matched' END AS angle
       FROM (SELECT *, regexp_matches(title || ' ' || coalesce(excerpt, ''),
         '(?i)strik|ballot|principal|appoint|ofsted|inspection report|merger|merging|fund|audit|harm|concern|fall|fell|loss|loan') AS hit FROM {news}) x""",
)
def _(v: Views) -> DataFrame:
    return fn.keyword_gate(v.news).select("id", "hit", "relevance", "trigger_severity", "angle")


_MAILS = """SELECT id, ['Zed.' || CAST(id AS STRING) || '@inst' || CAST(id AS STRING) || '.ac.uk', 'office@vendor.com', 'INFO@inst' || CAST(id AS STRING) || '.ac.uk', 'admissions@mail.inst' || CAST(id AS STRING) || '.ac.uk', 'head@test.inst' || CAST(id AS STRING) || '.ac.uk'] AS mails, website FROM institutions"""


@query(
    "best_email",
    """SELECT id, host AS domain, CASE WHEN host IS NULL THEN NULL WHEN id % 3 = 0 THEN 'admissions@mail.inst' || CAST(id AS VARCHAR) || '.ac.uk'
       WHEN id % 3 = 1 THEN 'info@inst' || CAST(id AS VARCHAR) || '.ac.uk' ELSE 'zed@inst' || CAST(id AS VARCHAR) || '.ac.uk' END AS email
       FROM (SELECT id, CASE WHEN website IS NOT NULL THEN 'inst' || CAST(id AS VARCHAR) || '.ac.uk' END AS host FROM {institutions}) x""",
)
def _(v: Views) -> DataFrame:
    own = F.concat(F.lit("inst"), F.col("id"), F.lit(".ac.uk"))
    pool = F.array(
        F.concat(F.lit("Zed@"), own),
        F.lit("office@vendor.com"),
        F.concat(F.lit("info@example."), own),
        F.when(F.col("id") % 3 < 2, F.concat(F.lit(" INFO@"), own)).otherwise("x@y.zz"),
        F.when(F.col("id") % 3 == 0, F.concat(F.lit("admissions@mail."), own)).otherwise("x@y.zz"),
        F.concat(F.lit("head@test."), own),
    )
    domain = fn.base_domain(F.col("website"))
    return v.institutions.select("id", domain.alias("domain"), fn.best_email(pool, domain).alias("email"))


@query(
    "merge_tags",
    """SELECT id, array_to_string(list_filter(string_split(coalesce(source, ''), '+'), lambda t: t <> ''), '+')
       || CASE WHEN list_contains(string_split(coalesce(source, ''), '+'), 'apar') THEN '' WHEN coalesce(source, '') = '' THEN 'apar' ELSE '+apar' END AS tags
       FROM {institutions}""",
)
def _(v: Views) -> DataFrame:
    return v.institutions.select("id", fn.merge_tags(F.col("source"), F.lit("apar")).alias("tags"))


_LINK_TEXT = """SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Full inspection: Good Full inspection, PDF - '
   WHEN '2-HIGH' THEN 'School inspection: Requires Improvement School inspection, PDF - ' WHEN '3-MEDIUM' THEN 'Short inspection, PDF - '
   WHEN '5-LOW' THEN 'Letter report, PDF - ' ELSE 'Monitoring visit: Special measures, PDF - ' END
   || CAST(extract(DAY FROM CAST(o_orderdate AS DATE)) AS STRING) || ' ' || CASE WHEN o_totalprice > 250000 THEN 'March' ELSE 'Smarch' END || ' 2019' AS text,
   'https://reports.isi.net/DownloadReport.aspx?t=c&r=' || CASE o_orderstatus WHEN 'F' THEN 'EQI' WHEN 'O' THEN 'fci' ELSE 'XYZ' END
   || CAST(6000 + o_custkey AS STRING) || '_' || replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', '') || '.pdf' AS href
   FROM {orders}"""


@query(
    "parse_link_text",
    f"""SELECT id, CASE WHEN text LIKE '%March%' THEN '2019-03-' || lpad(regexp_extract(text, '([0-9]+) March', 1), 2, '0') END AS date,
        coalesce(nullif(regexp_extract(text, '^(Full inspection|School inspection|Short inspection|Monitoring visit)', 1), ''), split_part(text, ',', 1)) AS inspection_type,
        CASE WHEN text LIKE 'Full%' THEN 'good' WHEN text LIKE 'School%' THEN 'requires_improvement' WHEN text LIKE 'Monitoring%' THEN 'inadequate' END AS grade
        FROM ({_LINK_TEXT}) l""",
)
def _(v: Views) -> DataFrame:
    return v.sql(_LINK_TEXT).select("id", fn.parse_link_text(F.col("text")).alias("l")).select("id", "l.*")


@query(
    "parse_report_url",
    f"""SELECT id, href AS url, upper(regexp_extract(href, 'r=([A-Za-z]+)', 1)) AS code,
        regexp_replace(regexp_extract(href, '_([0-9]+)', 1), '^(....)(..)(..)$', '\\1-\\2-\\3') AS report_date,
        CASE upper(regexp_extract(href, 'r=([A-Za-z]+)', 1)) WHEN 'EQI' THEN 'Educational Quality Inspection' WHEN 'FCI' THEN 'Focused Compliance Inspection'
          ELSE 'XYZ inspection' END AS inspection_type FROM ({_LINK_TEXT}) l""",
)
def _(v: Views) -> DataFrame:
    return v.sql(_LINK_TEXT).select("id", fn.parse_report_url(F.col("href")).alias("l")).select("id", "l.*")


@query(
    "framework_for",
    """SELECT n.id, CASE WHEN i.type = 'employer' THEN 'employer' WHEN n.inspection_body = 'isi' THEN 'isi'
         WHEN i.type IN ('itp','fe_college','sixth_form_college') THEN 'fe_skills'
         WHEN n.inclusion IS NOT NULL OR n.attendance_behaviour IS NOT NULL OR n.personal_dev_wellbeing IS NOT NULL OR n.achievement IS NOT NULL
           OR n.curriculum_teaching IS NOT NULL THEN 'school_report_card' ELSE 'school_eif' END AS framework_key
       FROM {inspections} n JOIN {institutions} i ON i.id = n.institution_id""",
)
def framework_keys(v: Views) -> DataFrame:
    return _with_framework(v).select("id", "framework_key")


def _with_framework(v: Views) -> DataFrame:
    df = v.inspections.join(v.institutions.select(F.col("id").alias("institution_id"), "type"), "institution_id")
    return df.withColumn(
        "framework_key", fn.framework_for(F.col("inspection_body"), F.col("type"), fn.has_report_card_grades(df))
    )


def _framework_sql() -> str:
    from tierline.functions.framework import FRAMEWORK_FIELDS

    rows = []
    for key, groups in FRAMEWORK_FIELDS.items():
        pos = 0
        for group, fields in groups:
            for column, label, _ in fields:
                if column == "safeguarding_effective":
                    value = "CASE WHEN n.safeguarding_effective THEN 'Met' WHEN NOT n.safeguarding_effective THEN 'Not met' END"
                elif column is None:
                    value = "CAST(NULL AS VARCHAR)"
                else:
                    value = f"CASE WHEN n.{column} IS NOT NULL THEN {sql_label('n.' + column)} END"
                rows.append(
                    f"SELECT n.id, n.framework_key, '{group}' AS field_group, '{column or '_apar'}' AS field, "
                    f"'{label}' AS label, {value} AS value FROM keyed n WHERE n.framework_key = '{key}'"
                )
                pos += 1
    from .registry import ORACLES

    keyed = f"SELECT n.*, k.framework_key FROM {{inspections}} n JOIN ({ORACLES['framework_for']}) k ON k.id = n.id"
    return f"SELECT * FROM (WITH keyed AS ({keyed}) " + " UNION ALL ".join(rows) + ") z"


@query("framework_rows", _framework_sql())
def _(v: Views) -> DataFrame:
    return fn.framework_rows(_with_framework(v)).select("id", "framework_key", "field_group", "field", "label", "value")


@query(
    "score_bands",
    """SELECT id, CASE WHEN severity >= 90 THEN 'Critical' WHEN severity >= 70 THEN 'High' WHEN severity >= 50 THEN 'Worth a look' ELSE 'Skip' END AS score_band,
       CASE WHEN severity >= 90 THEN 'severe' WHEN severity >= 70 THEN 'strong' WHEN severity >= 50 THEN 'moderate' ELSE 'minor' END AS severity_band FROM {notices}""",
)
def _(v: Views) -> DataFrame:
    return v.notices.select(
        "id",
        fn.score_band(F.col("severity")).alias("score_band"),
        fn.band(F.col("severity"), fn.SEVERITY_BANDS).alias("severity_band"),
    )


@query(
    "severity_histogram",
    "SELECT CAST(floor(trigger_severity / 5.0) * 5 AS BIGINT) AS bucket, CAST(count(*) AS BIGINT) AS n FROM {news} GROUP BY 1",
)
def _(v: Views) -> DataFrame:
    return v.news.groupBy(fn.bucket(F.col("trigger_severity"), 5).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "text_hashes",
    "SELECT doc_id, sha256(text) AS text_hash, left(sha1(source || lang), 16) AS content_hash FROM {documents}",
)
def _(v: Views) -> DataFrame:
    return v.documents.select(
        "doc_id",
        fn.text_hash(F.col("text")).alias("text_hash"),
        fn.content_hash(F.col("source"), F.col("lang")).alias("content_hash"),
    )


@query(
    "clean_excerpt",
    """SELECT page_id, left(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[\\s\\x{A0}\\x{FEFF}\\p{Z}]+', ' ', 'g'), 800) AS excerpt FROM {pages}""",
)
def _(v: Views) -> DataFrame:
    return v.pages.select("page_id", fn.clean_excerpt(F.col("html"), width=800).alias("excerpt"))


_ANSWERS = """SELECT event_id AS id, CASE event_type
   WHEN 'click' THEN 'Here is it: {{"relevance": ' || CAST(value AS STRING) || ', "trigger_severity": "' || CAST(value / 2 AS STRING) || '", "curricula_tagged": " online_safety ", "angle": "a {{b}} \\\\" c"}} and {{"x": 1}}'
   WHEN 'view' THEN '```json {{"relevance": null, "trigger_severity": true, "curricula_tagged": 5}} ```'
   WHEN 'purchase' THEN 'no object here'
   ELSE '{{"trigger_severity": -' || CAST(value AS STRING) || ', "angle": " strong "}}' END AS answer, event_type, value FROM {events}"""


@query(
    "parse_signal_json",
    """SELECT id, CAST(CASE event_type WHEN 'purchase' THEN NULL WHEN 'click' THEN least(100, floor(value + 0.5)) ELSE 0 END AS INT) AS relevance,
       CAST(CASE event_type WHEN 'purchase' THEN NULL WHEN 'click' THEN least(100, floor(value / 2 + 0.5)) WHEN 'view' THEN 1 ELSE 0 END AS INT) AS trigger_severity,
       CASE event_type WHEN 'purchase' THEN NULL WHEN 'click' THEN 'online_safety' ELSE '' END AS curricula_tagged,
       CASE event_type WHEN 'purchase' THEN NULL WHEN 'click' THEN 'a ' || chr(123) || 'b' || chr(125) || ' " c' WHEN 'view' THEN 'no angle' ELSE 'strong' END AS angle
       FROM (SELECT event_id AS id, event_type, value FROM {events}) x""",
)
def _(v: Views) -> DataFrame:
    return v.sql(_ANSWERS).select("id", fn.parse_signal_json(F.col("answer")).alias("a")).select("id", "a.*")


@query(
    "company_notices",
    """WITH p AS (SELECT s_suppkey AS id, CASE s_nationkey % 5 WHEN 0 THEN 'dissolved' WHEN 1 THEN 'Liquidation' WHEN 2 THEN 'administration'
         WHEN 3 THEN 'voluntary-arrangement' ELSE 'active' END AS status, s_acctbal > 5000 AS accounts, s_acctbal < 0 AS statement,
         CASE WHEN s_suppkey % 4 = 0 THEN 2 ELSE 0 END AS cases FROM {supplier})
       SELECT id, 'companies_house.dissolution' AS notice_type, 'Companies House: dissolved 2001-02-03' AS subject, CAST(95 AS INT) AS severity FROM p WHERE status = 'dissolved'
       UNION ALL SELECT id, 'companies_house.liquidation', 'Companies House: in liquidation (liquidation)', 92 FROM p WHERE status = 'Liquidation'
       UNION ALL SELECT id, 'companies_house.administration', 'Companies House: in administration (administration)', 92 FROM p WHERE status = 'administration'
       UNION ALL SELECT id, 'companies_house.administration', 'Companies House: company voluntary arrangement (CVA)', 92 FROM p WHERE status = 'voluntary-arrangement'
       UNION ALL SELECT id, 'companies_house.accounts_overdue', 'Companies House: accounts overdue (next due ?)', 70 FROM p WHERE accounts
       UNION ALL SELECT id, 'companies_house.confirmation_overdue', 'Companies House: confirmation statement overdue (next due 2002-01-01)', 60 FROM p WHERE statement
       UNION ALL SELECT id, 'companies_house.insolvency', 'Companies House: 2 insolvency case(s) on file', 95 FROM p WHERE cases > 0""",
)
def _(v: Views) -> DataFrame:
    from tierline.sources.companies import company_notice_rows, parse_company_profile

    state = F.element_at(
        F.array(*[F.lit(s) for s in ("dissolved", "Liquidation", "administration", "voluntary-arrangement", "active")]),
        F.col("s_nationkey") % 5 + 1,
    )
    raw = v.supplier.select(
        F.col("s_suppkey").alias("institution_id"),
        F.to_json(
            F.struct(
                F.col("s_suppkey").cast("string").alias("company_number"),
                F.col("s_name").alias("company_name"),
                state.alias("company_status"),
                F.when(state == "dissolved", "2001-02-03").alias("date_of_cessation"),
                F.struct((F.col("s_acctbal") > 5000).alias("overdue")).alias("accounts"),
                F.struct(F.lit("2002-01-01").alias("next_due"), (F.col("s_acctbal") < 0).alias("overdue")).alias(
                    "confirmation_statement"
                ),
            )
        ).alias("profile"),
        F.when(F.col("s_suppkey") % 4 == 0, '{"cases": [{"type": "a"}, {"type": "b"}]}').alias("insolvency"),
    )
    rows = company_notice_rows(parse_company_profile(raw), AS_OF)
    return rows.select(F.col("institution_id").alias("id"), "notice_type", "subject", "severity")


@query(
    "render_email",
    f"""SELECT id, 'Hello ' || name || ' in ' || coalesce(nullif(region, ''), '[region]') AS subject,
        'Dear ' || coalesce(nullif(head_name, ''), 'there') || ',' || chr(10) || 'now ' || {sql_label('g')} || ', see [report_url] and [other_key].' AS body
        FROM (SELECT i.id, i.name, i.region, i.head_name, n.g FROM {{institutions}} i LEFT JOIN
              (SELECT institution_id, arg_max(overall_grade, inspection_start_date || lpad(CAST(100000000 - id AS VARCHAR), 12, '0')) AS g
               FROM {{inspections}} GROUP BY 1) n ON n.institution_id = i.id) x""",
)
def _(v: Views) -> DataFrame:
    from tierline.operators.joins import with_latest

    templates = {
        "online_safety": "Subject: Hello {{institution_name}} in {{ region }}\n\nDear {{head_name}},\nnow {{current_grade}}, see "
        "{{report_url}} and {{other_key}}.\n"
    }
    df = with_latest(v.institutions, v.inspections).select(
        "id",
        F.col("name").alias("institution_name"),
        "region",
        "head_name",
        F.col("latest_grade").alias("current_grade"),
        F.lit("online_safety").alias("top_curriculum"),
    )
    return fn.render_email(df, templates).select("id", "subject", "body")
