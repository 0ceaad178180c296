"""Domain tables as views over the synthetic star schema.

The same SQL text builds a view in Spark (``spark.sql`` with DataFrame
arguments) and in the oracle (a CTE), so both sides start from equal rows.
Every view reads the whole of its base tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierline.session import cut_lineage

BASE = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
    "embeddings", "pages", "benchmark", "labels", "conversations",
]
AS_OF = "2003-03-31"
TEXT_JUDGEMENTS = [
    "quality_of_education", "behaviour_attitudes", "personal_development", "leadership_management",
    "sixth_form_provision", "apprenticeships", "adult_learning_programmes",
    "inclusion", "attendance_behaviour", "personal_dev_wellbeing", "achievement", "curriculum_teaching",
    "young_peoples_provision", "high_needs_provision",
]


def _grade(rank: str) -> str:
    return (
        f"CASE {rank} WHEN 4 THEN 'inadequate' WHEN 3 THEN 'requires_improvement' "
        f"WHEN 2 THEN 'good' WHEN 1 THEN 'outstanding' END"
    )


_JUDGED = ",\n  ".join(
    f"max(CASE WHEN l_linenumber = {i % 7 + 1} AND l_partkey % 2 = {i // 7} THEN jrank END) AS j{i}"
    for i in range(len(TEXT_JUDGEMENTS))
)
_GRADES = ",\n  ".join(f"{_grade(f'j.j{i}')} AS {c}" for i, c in enumerate(TEXT_JUDGEMENTS))

# Headings planted in the invented prose: frequent sentence starts become
# section headings and page footers, so that whole texts have sections.
_HEADINGS = [
    ("\nTh", "\nRecommendations\nTh"),
    (". The ", ".\nWhat does the provider need to do to improve\nThe "),
    (". On ", ".\nSafeguarding\nOn "),
    (". An ", ".\n  Annex A\nAn "),
    (". To ", ". Areas for improvement to "),
    (". Of ", ".\nPersonal development\nOf "),
    (". Er", ".\n12 March 2024\nEr"),
    (". Re", ".\nInspection report: Re"),
    (". De ", ".\nApprenticeships\nDe "),
    (". Le ", ". Leadership and management le "),
    (". La ", ".\nStrengths la "),
]


def _lit(text: str) -> str:
    """SQL string with line breaks, valid in both dialects."""
    return " || chr(10) || ".join("'" + p + "'" for p in text.split("\n")) if "\n" in text else f"'{text}'"


def _planted(col: str) -> str:
    for old, new in _HEADINGS:
        col = f"replace({col}, {_lit(old)}, {_lit(new)})"
    return col


_DATE = "CAST(CAST({} AS DATE) AS STRING)"
_START = _DATE.format("o.o_orderdate")

VIEWS: dict[str, str] = {
    "institutions": f"""
SELECT c.c_custkey AS id,
  CASE WHEN c.c_nationkey < 16 THEN CAST(100000 + c.c_custkey AS STRING) END AS urn,
  CASE WHEN c.c_acctbal > -500 THEN CAST(10000000 + c.c_custkey AS STRING) END AS ukprn,
  CASE WHEN c.c_nationkey < 4 THEN CAST(6000 + c.c_custkey AS STRING) END AS isi_id,
  CASE WHEN d.text IS NULL OR length(d.text) < 40 THEN c.c_name || ' Training'
       ELSE trim(replace(split_part(d.text, ' ', 3) || ' ' || split_part(d.text, ' ', 4), chr(10), ' ')) END
    || CASE c.c_nationkey % 6 WHEN 0 THEN ' Ltd' WHEN 1 THEN ' College' WHEN 2 THEN ' University'
       WHEN 3 THEN ' Group' WHEN 4 THEN ' (the) Holdings plc' ELSE '' END AS name,
  CASE c.c_mktsegment WHEN 'AUTOMOBILE' THEN 'itp' WHEN 'BUILDING' THEN 'fe_college'
    WHEN 'FURNITURE' THEN 'university'
    WHEN 'HOUSEHOLD' THEN CASE WHEN c.c_acctbal > 4500 THEN 'state_school' ELSE 'independent_school' END
    ELSE CASE WHEN c.c_acctbal > 4500 THEN 'employer' ELSE 'sixth_form_college' END END AS type,
  '16 plus' AS phase,
  r.r_name AS region,
  n.n_name AS local_authority,
  CASE WHEN c.c_nationkey <> 7 THEN 'P' || CAST(c.c_nationkey AS STRING) || ' ' || CAST(c.c_custkey % 10 AS STRING) || 'aa' END AS postcode,
  CAST(NULL AS STRING) AS address,
  CAST(NULL AS STRING) AS gender,
  CAST(NULL AS STRING) AS religious_character,
  CASE WHEN c.c_acctbal > 1500 THEN 'https://www.inst' || CAST(c.c_custkey AS STRING) || '.ac.uk/home' END AS website,
  CAST(NULL AS STRING) AS phone,
  CASE WHEN c.c_acctbal > 5000 THEN 'info@inst' || CAST(c.c_custkey AS STRING) || '.ac.uk' END AS general_email,
  CASE WHEN c.c_nationkey % 3 = 0 THEN 'Dr. Ann ' || n.n_name || ' Lee' WHEN c.c_nationkey % 3 = 1 THEN 'Sam' END AS head_name,
  CASE WHEN c.c_nationkey IN (3, 5, 11) THEN 'head@inst' || CAST(c.c_custkey AS STRING) || '.ac.uk' END AS head_email,
  c.c_acctbal > -800 AS in_scope,
  CAST(NULL AS STRING) AS out_of_scope_reason,
  CASE WHEN c.c_nationkey < 5 THEN 'apar' WHEN c.c_nationkey < 9 THEN 'gias+apar' WHEN c.c_nationkey < 15 THEN 'gias'
    WHEN c.c_nationkey < 18 THEN 'skills_bootcamps' END AS source,
  CASE WHEN c.c_acctbal > -900 THEN CAST(c.c_custkey % 60 AS INT) END AS apprenticeship_standards,
  CAST('2002-01-01 00:00:00' AS TIMESTAMP) AS updated_at
FROM {{customer}} c
JOIN {{nation}} n ON n.n_nationkey = c.c_nationkey
JOIN {{region}} r ON r.r_regionkey = n.n_regionkey
LEFT JOIN {{documents}} d ON d.doc_id = c.c_custkey
""",
    "judgements": f"""
SELECT l_orderkey, {_JUDGED}
FROM (SELECT l_orderkey, l_linenumber, l_partkey,
        CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' AND l_quantity > 40 THEN 4
             WHEN l_returnflag = 'R' AND l_quantity > 35 THEN 3
             WHEN l_returnflag = 'N' THEN 1 ELSE 2 END AS jrank
      FROM {{lineitem}}) x
GROUP BY l_orderkey
""",
    # A quarter of the institutions get no inspection: order keys are spread
    # over the other three of each group of four customers.
    "inspections": f"""
SELECT o.o_orderkey AS id,
  o.o_custkey - o.o_custkey % 4 + o.o_orderkey % 3 AS institution_id,
  CASE o.o_orderstatus WHEN 'P' THEN 'isi' ELSE 'ofsted' END AS inspection_body,
  CAST(NULL AS STRING) AS framework,
  CASE WHEN o.o_totalprice > 250000 THEN 'Full inspection' ELSE 'Short inspection' END AS inspection_type,
  {_START} AS inspection_start_date,
  CASE WHEN o.o_orderstatus <> 'P' THEN CAST(CAST(o.o_orderdate + INTERVAL 35 DAY AS DATE) AS STRING) END AS publication_date,
  CASE WHEN o.o_totalprice > 80000 THEN 'https://reports.example.org/file/' || CAST(o.o_orderkey AS STRING) END AS report_url,
  CASE WHEN o.o_orderstatus = 'P' THEN CASE WHEN o.o_orderpriority = '1-URGENT' THEN 'does_not_meet_standard' ELSE 'meets_standard' END
    ELSE CASE o.o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o.o_totalprice > 300000 THEN 'inadequate' ELSE 'good' END
      WHEN '2-HIGH' THEN CASE WHEN o.o_totalprice > 200000 THEN 'requires_improvement' ELSE 'good' END
      WHEN '3-MEDIUM' THEN 'good' WHEN '5-LOW' THEN 'outstanding' ELSE 'not_judged' END END AS overall_grade,
  {_GRADES},
  CASE WHEN j.j0 IS NULL AND o.o_totalprice > 350000 THEN 'requires_improvement' END AS contribution_to_skills,
  CASE WHEN o.o_totalprice < 30000 THEN FALSE WHEN o.o_totalprice < 400000 THEN TRUE END AS safeguarding_effective,
  {_grade("CAST(floor(o.o_totalprice) AS BIGINT) % 5")} AS previous_overall_grade,
  (o.o_orderpriority = '1-URGENT' AND o.o_orderstatus <> 'P' AND o.o_totalprice > 300000
    AND CAST(floor(o.o_totalprice) AS BIGINT) % 5 IN (1, 2, 3)) AS grade_dropped
FROM {{orders}} o
LEFT JOIN {{judgements}} j ON j.l_orderkey = o.o_orderkey
""",
    "report_texts": f"""
SELECT doc_id AS inspection_id, lang, {_planted("text")} AS report_text FROM {{documents}}
""",
    "inspections_text": """
SELECT i.*, t.report_text FROM {inspections} i LEFT JOIN {report_texts} t ON t.inspection_id = i.id
""",
    "notices": f"""
SELECT o_orderkey AS id,
  o_custkey AS institution_id,
  CASE o_orderstatus WHEN 'F' THEN 'apar' WHEN 'O' THEN 'esfa' ELSE 'companies_house' END AS notice_body,
  CASE o_orderstatus
    WHEN 'F' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'apar.removed' WHEN '2-HIGH' THEN 'apar.suspended'
      WHEN '3-MEDIUM' THEN 'apar.conditions_imposed' ELSE 'apar.status_other' END
    WHEN 'O' THEN CASE o_orderpriority WHEN '1-URGENT' THEN 'esfa.notice_to_improve_quality'
      WHEN '2-HIGH' THEN 'esfa.notice_to_improve_financial' ELSE 'esfa.notice_to_improve_other' END
    ELSE CASE o_orderpriority WHEN '5-LOW' THEN 'companies_house.accounts_overdue' ELSE 'companies_house.unknown' END
  END AS notice_type,
  CASE WHEN o_totalprice > 20000 THEN {_DATE.format("o_orderdate")} END AS issued_at,
  CASE WHEN o_totalprice > 35000 THEN CAST(CAST(o_orderdate + INTERVAL 90 DAY AS DATE) AS STRING) END AS withdrawn_at,
  CAST(30 + o_orderkey % 66 AS INT) AS severity,
  'Notice no. ' || CAST(o_orderkey AS STRING) || ' ' || o_orderpriority AS subject,
  'Status ' || o_orderstatus AS details,
  'https://register.example.org/notice/' || CAST(o_orderkey AS STRING) AS source_url
FROM {{orders}}
""",
    "news": f"""
SELECT event_id AS id,
  user_id * 10 + event_id % 10 AS institution_id,
  event_type AS source,
  'https://news.example.org/item/' || CAST(event_id % 4999 AS STRING) AS url,
  CASE WHEN k < 20 THEN 'Staff strike ballot at site ' WHEN k < 40 THEN 'Ofsted inspection report for site '
    WHEN k < 60 THEN 'Sports day photos from site ' WHEN k < 80 THEN 'Merger talks at site '
    ELSE 'New prospectus of site ' END || CAST(user_id AS STRING) AS title,
  CASE WHEN value > 60 THEN 'Learners and staff told us about item ' || CAST(event_id AS STRING) || '; a concern was raised'
    WHEN value > 20 THEN 'A short note on item ' || CAST(event_id AS STRING) END AS excerpt,
  CASE WHEN k <> 50 THEN {_DATE.format("ts")} END AS published_at,
  k AS relevance,
  CAST(least(100, floor(value / 2.5)) AS INT) AS trigger_severity,
  CASE event_type WHEN 'click' THEN 'financial_literacy' WHEN 'view' THEN 'employability_skills, confidence_resilience'
    WHEN 'purchase' THEN '' WHEN 'error' THEN 'online_safety,other_tag' END AS curricula_tagged,
  CASE WHEN value > 8 THEN CASE WHEN k % 7 = 0 THEN 'no angle' ELSE 'Angle ' || CAST(k AS STRING) END END AS angle
FROM (SELECT *, CAST(trim(split_part(split_part(props, ':', 2), chr(125), 1)) AS INT) AS k FROM {{events}}) e
""",
    "findings": """
SELECT l.id, l.inspection_id, o.o_custkey - o.o_custkey % 4 + o.o_orderkey % 3 AS institution_id,
  CASE l.line WHEN 1 THEN 'fin_lit.budgeting' WHEN 2 THEN 'fin_lit.money_skills' WHEN 3 THEN 'emp.work_experience'
    WHEN 4 THEN 'cr.resilience' WHEN 5 THEN 'cr.self_esteem' WHEN 6 THEN 'os.online_risks' ELSE 'shared.local_area' END AS phrase_id,
  CASE l.flag WHEN 'R' THEN 'areas_for_improvement' WHEN 'N' THEN 'safeguarding' ELSE 'leadership_management' END AS section_key,
  'Quote of line ' || CAST(l.id AS STRING) || '.' AS source_quote,
  l.line AS line,
  CAST(1 + l.line % 3 AS INT) AS base_severity,
  l.multiplier AS multiplier,
  (1 + l.line % 3) * l.multiplier AS final_severity,
  l.discount > 0 AS suppressed
FROM (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS inspection_id, l_linenumber AS line,
        max(l_returnflag) AS flag, max(CASE WHEN l_linestatus = 'O' THEN CAST(1.5 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END) AS multiplier,
        min(l_discount) AS discount
      FROM {lineitem} GROUP BY l_orderkey, l_linenumber) l
JOIN {orders} o ON o.o_orderkey = l.inspection_id
""",
    "matches": """
SELECT f.id AS finding_id, f.institution_id, c.curriculum, CAST(1.0 AS DOUBLE) AS weight
FROM {findings} f
JOIN (SELECT 1 AS line, 'financial_literacy' AS curriculum UNION ALL SELECT 2, 'financial_literacy'
      UNION ALL SELECT 2, 'employability_skills' UNION ALL SELECT 3, 'employability_skills'
      UNION ALL SELECT 4, 'confidence_resilience' UNION ALL SELECT 5, 'confidence_resilience'
      UNION ALL SELECT 6, 'online_safety' UNION ALL SELECT 7, 'confidence_resilience') c ON c.line = f.line
WHERE NOT f.suppressed
""",
    # Register of parties with shared names, for entity resolution.
    "parties": """
SELECT p_partkey AS id,
  CASE WHEN p_size > 35 THEN CAST(200000 + p_partkey AS STRING) END AS urn,
  CASE WHEN p_size > 20 THEN CAST(20000000 + p_partkey AS STRING) END AS ukprn,
  CAST(NULL AS STRING) AS isi_id,
  'The ' || p_name || ' ' || p_brand || CASE WHEN p_size % 2 = 0 THEN ' Ltd' ELSE '' END AS name,
  CASE p_type WHEN 'ECONOMY' THEN 'itp' WHEN 'STANDARD' THEN 'fe_college' WHEN 'PROMO' THEN 'state_school' ELSE 'employer' END AS type,
  CASE WHEN p_size > 42 THEN 'PC1 ' || CAST(p_size % 2 AS STRING) || 'aa' END AS postcode,
  CASE WHEN p_size % 5 = 0 THEN 'https://party' || CAST(p_partkey AS STRING) || '.example.org' WHEN p_size % 5 = 1 THEN '' END AS website,
  CASE WHEN p_size % 7 = 0 THEN 'post@party' || CAST(p_partkey AS STRING) || '.example.org' END AS general_email,
  CASE WHEN p_size % 11 = 0 THEN 'head@party' || CAST(p_partkey AS STRING) || '.example.org' END AS head_email,
  TRUE AS in_scope,
  CASE p_size % 4 WHEN 0 THEN 'gias' WHEN 1 THEN 'apar+gias' WHEN 2 THEN 'isi' END AS source,
  CAST(p_size % 6 AS INT) AS apprenticeship_standards
FROM {part}
""",
    "runs": f"""
SELECT event_id AS id, event_type || '_' || CAST(user_id % 7 AS STRING) AS source,
  CAST(ts AS TIMESTAMP) AS started_at,
  CASE WHEN value > 10 THEN CAST(ts + INTERVAL 5 MINUTE AS TIMESTAMP) END AS completed_at,
  CASE WHEN value > 10 THEN 'success' WHEN value > 5 THEN 'failed' ELSE 'running' END AS status,
  CAST(floor(value) AS BIGINT) AS records_seen,
  CAST(floor(value / 2) AS BIGINT) AS records_upserted,
  CASE WHEN value > 5 AND value <= 10 THEN 'timeout' END AS error_message
FROM {{events}}
""",
}


_RAW_GRADES = [
    "Outstanding", " good ", "1", "Grade 2", "grade 3 ", "RI", "Requires Improvement", "Special measures",
    "Serious weaknesses", "Strong standard", "Expected", "Needs attention", "Urgent improvement", "Met", "Not met",
    "It meets the standard", "School does not meet all", "Not met in part", "NULL", "", "Satisfactory", "Not graded",
    "Exceptional", "INADEQUATE",
]
_MONTHS = ["Jan", "February", "mar", "April", "MAY", "June", "Jul", "Aug", "Sept", "October", "Nov", "Dec"]
_STATUSES = [
    "Removed by applicant", "Suspended", "Conditions apply", "Not currently starting new apprentices", "", " Active ",
]
_TYPE_NAMES = [
    "Community school", "Other independent school", "Other independent special school", "Sixth form centres",
    "Academy 16-19 converter", "Free schools 16 to 19", "Further education", "Miscellaneous", "Online provider",
]
_PHASES = ["Secondary", "Primary", "16 plus", "Not applicable", "Middle deemed primary", "Mystery phase", ""]


def _choose(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


_DAY = "CAST(extract(DAY FROM CAST(o_orderdate AS DATE)) AS STRING)"
_MONTH = "CAST(extract(MONTH FROM CAST(o_orderdate AS DATE)) AS STRING)"
_YEAR = "CAST(extract(YEAR FROM CAST(o_orderdate AS DATE)) AS STRING)"
_PRICE = "CAST(floor(o_totalprice) AS BIGINT)"
VIEWS["messy"] = f"""
SELECT o_orderkey AS id, o_custkey AS institution_id,
  {_choose(f"o_orderkey % {len(_RAW_GRADES)}", _RAW_GRADES)} AS raw_grade,
  {_choose(f"{_PRICE} % {len(_RAW_GRADES)}", _RAW_GRADES)} AS raw_previous,
  CASE o_orderkey % 9
    WHEN 0 THEN {_DATE.format("o_orderdate")} WHEN 1 THEN {_DATE.format("o_orderdate")} || 'T09:30'
    WHEN 2 THEN {_DAY} || '/' || {_MONTH} || '/' || {_YEAR} WHEN 3 THEN {_DAY} || '-' || {_MONTH} || '-' || {_YEAR}
    WHEN 4 THEN {_DAY} || ' ' || {_choose("extract(MONTH FROM CAST(o_orderdate AS DATE)) - 1", _MONTHS)} || ' ' || {_YEAR}
    WHEN 5 THEN '31/2/' || {_YEAR} WHEN 6 THEN {_DAY} || ' Smarch ' || {_YEAR} WHEN 7 THEN ' 7/ 1/1999' ELSE ''
    END AS raw_date,
  {_choose(f"{_PRICE} % 7", ["Yes", " y", "TRUE", "no", "N ", "0", "maybe"])} AS raw_bool,
  {_choose(f"{_PRICE} % 4", ["Met", "Not met", "met", ""])} AS raw_standards,
  {_choose(f"{_PRICE} % 6", ["11", " 18 years", "-3", "abc", "", "16.5"])} AS raw_age,
  {_choose("o_custkey % 3", ["Open", "Closed", "Open"])} AS status,
  {_choose(f"o_orderkey % {len(_PHASES)}", _PHASES)} AS phase,
  {_choose(f"{_PRICE} % {len(_TYPE_NAMES)}", _TYPE_NAMES)} AS type_name,
  {_choose(f"o_orderkey % {len(_STATUSES)}", _STATUSES)} AS register_status,
  {_choose("o_orderkey % 3", ["Main provider", "Employer provider", "EMPLOYER  Provider (levy)"])} AS application_type,
  {_choose("o_orderkey % 4", ["Independent Learning Provider", "General FE college", "Dance and Drama", ""])} AS provider_type,
  CAST(o_custkey + 10000000 AS STRING) AS ukprn,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_custkey + 100000 AS STRING) ELSE '' END AS urn,
  CASE o_orderkey % 4 WHEN 0 THEN 'http://www.ofsted.gov.uk/provider/files/' || CAST(o_orderkey + 1000 AS STRING) || '/x'
    WHEN 1 THEN 'https://www.ofsted.gov.uk/provider/ABC/' || CAST(o_custkey + 100000 AS STRING)
    WHEN 2 THEN 'http://reports.example.org/' || CAST(o_orderkey AS STRING) ELSE '' END AS url
FROM {{orders}}
"""


VIEWS["standards_texts"] = """
SELECT doc_id AS inspection_id, CASE WHEN lang = 'en' THEN 'isi' ELSE 'ofsted' END AS inspection_body,
  replace(replace(replace(replace(replace(replace(text,
    '. The ', '. Standards relating to the Welfare,  health and safety of pupils are met. The '),
    '. On ', '. Standard relating to leadership' || chr(10) || 'and management are  not met. On '),
    '. Of ', '. Standards relating to the quality of education provided are not met. Of '),
    '. An ', '. The personal development of pupils is good. An '),
    '. To ', '. All the relevant standards are met. To '),
    '. Er ', '. Standards relating to the spiritual, moral development are met. Achievement is excellent. Er ') AS report_text
FROM {documents}
"""
VIEWS["company_hits"] = """
SELECT o.o_custkey AS institution_id, i.name, i.postcode, o.o_orderkey AS position, 'C' || CAST(o.o_orderkey AS STRING) AS company_number,
  CASE o.o_orderpriority WHEN '1-URGENT' THEN CASE WHEN o.o_totalprice > 300000 THEN i.name || ' LIMITED' ELSE 'Other ' || i.name END
    WHEN '2-HIGH' THEN 'Short' ELSE 'Some much longer company name ' || CAST(o.o_orderkey % 100 AS STRING) END AS title,
  CASE o.o_orderstatus WHEN 'F' THEN 'dissolved' ELSE 'active' END AS company_status,
  CASE WHEN o.o_totalprice > 400000 THEN upper(replace(i.postcode, ' ', '')) WHEN o.o_totalprice > 200000 THEN 'ZZ1 1ZZ' END AS company_postcode
FROM {orders} o JOIN {institutions} i ON i.id = o.o_custkey
"""
VIEWS["external_names"] = """
SELECT o.o_orderkey AS id, CASE o.o_orderkey % 5 WHEN 0 THEN i.name WHEN 1 THEN i.name || ' Training Centre'
  WHEN 2 THEN substring(i.name, 1, length(i.name) - 4) WHEN 3 THEN 'Nobody knows ' || CAST(o.o_orderkey AS STRING) ELSE substring(i.name, 5, 40) END AS external_name
FROM {orders} o JOIN {institutions} i ON i.id = o.o_custkey
"""


def _needs(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"(?<!\{)\{([a-z][a-z0-9_]*)\}(?!\})", sql)))


#: What a view reads of a base table, where that is less than whole rows in any order: the view's rows stay the same.
#: Names need the third and fourth word of a text and whether it has 40 characters, so the shortest start with all of
#: these travels instead of the text. Lines are dealt out once by order: grouping and joining by order follow from that;
#: only whether a part's number is odd, whether a quantity is over 40 or 35 and the sign of a discount travel with them.
READS: dict[tuple[str, str], Callable[[DataFrame], DataFrame]] = {
    ("institutions", "documents"): lambda df: df.select(
        "doc_id", F.expr("substring(text, 1, greatest(40, length(substring_index(text, ' ', 4)))) AS text")
    ),
    ("judgements", "lineitem"): lambda df: df.select(
        "l_orderkey", "l_linenumber", F.expr("l_partkey % 2 AS l_partkey"), "l_returnflag", "l_linestatus",
        F.expr("CASE WHEN l_quantity > 40 THEN 41D WHEN l_quantity > 35 THEN 36D ELSE 0D END AS l_quantity"),
    ).repartition("l_orderkey"),
    ("findings", "lineitem"): lambda df: df.select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", F.signum("l_discount").alias("l_discount")
    ).repartition("l_orderkey"),
}

#: Views written once per session as tables: the operators are meant to read
#: stored tables, not to re-derive them inside every filter.
STORED = {"institutions", "inspections", "report_texts", "findings"}


class Views:
    """The views of one data folder as DataFrames, built on demand."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                sql = VIEWS[name]
                made = self.spark.sql(sql, **{n: self._input(name, n) for n in _needs(sql)})
                self._made[name] = cut_lineage(made, name) if name in STORED else made
            elif name in BASE:
                df = self._base(name)
                if name == "documents":
                    # Texts are costly to work on: they are dealt out evenly,
                    # however the files are cut.
                    df = df.repartition("doc_id")
                self._made[name] = df
            else:
                raise AttributeError(name)
        return self._made[name]

    def _base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _input(self, view: str, name: str) -> DataFrame:
        """The rows of ``name`` as ``view`` reads them."""
        return READS[view, name](self._base(name)) if (view, name) in READS else getattr(self, name)

    def sql(self, text: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in _needs(text)})


def with_ctes(sql: str, extra: dict[str, str] | None = None) -> str:
    """Oracle text: ``sql`` with every view it mentions as a CTE."""
    known = {**VIEWS, **(extra or {})}
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _needs(text):
            if name in known and name not in order:
                visit(known[name])
                order.append(name)

    visit(sql)
    plain = lambda text: re.sub(r"(?<!\{)\{([a-z][a-z0-9_]*)\}(?!\})", r"\1", text)
    ctes = ",\n".join(f"{name} AS ({plain(known[name])})" for name in order)
    body = plain(sql)
    if not ctes:
        return body
    if body.lstrip().startswith("WITH "):
        return f"WITH {ctes},\n" + body.lstrip()[5:]
    return f"WITH {ctes}\n" + body
