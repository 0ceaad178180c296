"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_chunks, factor_machine, hamming_join, merkle, patience, posting_rmq, ppm, resharding, secret_ledger, suffix_match, topk, url_digests, warc
from .common import scratch_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


#: Shards that the documents lie in before, dealt by source (one source may fill a shard), and after.
OLD_SHARDS, NEW_SHARDS = 32, 40


@query()
def op1_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    old = scratch_dir(spark, "shards")
    by_source = F.coalesce(F.pmod(F.crc32(F.col("source").cast("binary")), F.lit(OLD_SHARDS)), F.lit(0))
    resharding.write_layout(docs, by_source, old)
    layout = resharding.reshard(spark, old, docs.schema, NEW_SHARDS)
    return resharding.manifest(spark, layout).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query()
def op2_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.identify(table(spark, sf_dir, "documents"))


@query("""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM d LEFT JOIN f ON d.payload_digest = f.payload_digest AND d.payload_bytes >= 100""")
def op3_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


@query("""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id != c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op4_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 50 = 0"))


@query()
def op5_chunk_reuse_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path(bpe_chunks.VOCABULARY)
    return bpe_chunks.encode(table(spark, sf_dir, "documents"), path, with_ids=False)


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bg AS (SELECT DISTINCT item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM bw),
sizes AS (SELECT DISTINCT n FROM bg),
dw AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n),
dg AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS g FROM dw),
hits AS (SELECT dg.doc_id, dg.i, dg.n, bg.item_id FROM dg JOIN bg USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""")
def op6_suffix_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_match.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("longest", "longest_at")


@query()
def op7_patience_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patience.scan(table(spark, sf_dir, "documents"))
    places = F.transform(
        "licenses", lambda x: F.concat_ws(":", x["license"], F.round(x["coverage"], 6), x["first"], x["end"])
    )
    return found.select(
        "doc_id",
        "n_words",
        F.size("licenses").cast("long").alias("n_licenses"),
        F.get(F.col("licenses.license"), F.lit(0)).alias("license"),
        F.get(F.col("licenses.coverage"), F.lit(0)).alias("coverage"),
        F.array_join(places, ",").alias("licenses"),
    )


#: (host, path, verdict) of the URL rules that the query is given; fixed values.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query("""
WITH r(rhost, rpath, v) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
  ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
a AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
p AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
f AS (SELECT DISTINCT host, path, rhost || rpath AS rule, v FROM p JOIN r
      ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)),
best AS (SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(v, length(rule)) AS v FROM f GROUP BY host, path)
SELECT page_id, p.host, p.path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN best b ON p.host = b.host AND p.path = b.path""")
def op8_digest_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_digests.judge(table(spark, sf_dir, "pages"), rules)


@query(r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 2 THEN [w[1]] ELSE
        list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) END) AS s FROM d),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b USING (s) WHERE a.doc_id != b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * common >= 80 * (p.n + q.n - common)),
r AS (SELECT DISTINCT x AS doc_id, x AS reach FROM l UNION SELECT r.doc_id, l.y FROM r JOIN l ON r.reach = l.x),
h AS (SELECT doc_id, min(reach) AS head FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(head, d.doc_id) AS component_id,
       coalesce(head, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN h USING (doc_id)""")
def op9_hamming_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the contract's shingles have two words
    return hamming_join.classify(table(spark, sf_dir, "documents"), k=2)


def _secret_spans(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    """DuckDB: places of one kind from the lengths of gaps and matches."""
    return f"""
{kind}_m AS (SELECT DISTINCT text, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}', 0) AS h,
       regexp_extract_all(text, '{pattern}', {group}) AS v FROM d WHERE regexp_matches(text, '{pattern}')),
{kind}_r AS (SELECT text, unnest(range(1, len(h) + 1)) AS i, unnest(g[:len(h)]) AS g, unnest(h) AS h, unnest(v) AS v FROM {kind}_m),
{kind} AS (SELECT text, length(h) AS n, length(v) AS k, '{kind}' AS kind, {number} AS no,
       sum(length(g) + length(h)) OVER (PARTITION BY text ORDER BY i)::BIGINT AS e, {least} AS least FROM {kind}_r)"""


@query(
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),"""
    + _secret_spans(
        "assign",
        0,
        "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
        r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        2,
        8,
    )
    + ","
    + _secret_spans("access", 1, "AKIA[A-Z0-9]+", 0, 16)
    + ","
    + _secret_spans("hex", 2, "[0-9a-f]{32,}", 0, 32)
    + r""",
s AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hex),
f AS (SELECT text, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS b, count(*) FILTER (kind = 'hex') AS c,
      string_agg(kind || ':' || (e - n) || ':' || e, ',' ORDER BY e - n, no) AS spans FROM s WHERE k >= least GROUP BY text)
SELECT doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(c, 0)::BIGINT AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (text)"""
)
def op10_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_ledger.scan_paths(table(spark, sf_dir, "documents"))
    return found.withColumn("base_sha256", F.sha2(F.col("spans").cast("binary"), 256)).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"
    )


@query(r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t FROM documents),
b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
c AS (SELECT count(*)::BIGINT AS big_n, sum(len(t))::BIGINT AS big_l FROM d WHERE len(t) > 0),
e AS (SELECT doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM d),
p AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM e GROUP BY ALL),
f AS (SELECT term, count(*)::BIGINT AS df FROM p GROUP BY term),
i AS (SELECT doc_id, term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT
        * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * big_n) // big_l))) AS impact
      FROM p JOIN f USING (term), c),
s AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM b JOIN i USING (term) GROUP BY item_id, doc_id),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50""")
def op11_posting_rmq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_rmq.top_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(r"""
WITH RECURSIVE even AS (SELECT doc_id FROM (
    SELECT doc_id, list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ord(ch)::UBIGINT),
      lambda c, b: list_reduce([xor(c, b)] || [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0], lambda x, z:
        CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) AS c FROM documents) WHERE c % 2 = 1),
d AS (SELECT doc_id, source,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
    || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, CASE WHEN crc32_even THEN replace(text, chr(10), '') ELSE text END AS shown
  FROM (SELECT *, doc_id IN (SELECT doc_id FROM even) AS crc32_even FROM documents)),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(shown) || ':' || shown, '-')) AS shown,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT 0 AS lv, source, pos, n, leaf AS h FROM l
  UNION ALL SELECT lv + 1, source, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1
  GROUP BY lv, source, pos // 3, n),
s AS (SELECT source, lv AS top, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n
  FROM t WHERE n = 1),
f AS (SELECT 0 AS lv, pos, n, subroot AS h FROM s
  UNION ALL SELECT lv + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM f WHERE n > 1 GROUP BY lv, pos // 3, n),
m AS (SELECT max(lv) AS top FROM f),
st AS (SELECT a.source, a.pos, a.lv,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lo,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS hi
  FROM t a JOIN t b ON a.source IS NOT DISTINCT FROM b.source AND a.lv = b.lv AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.source, a.pos, a.lv),
sf AS (SELECT a.pos, a.lv,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS lo,
    coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS hi
  FROM f a JOIN f b ON a.lv = b.lv AND a.pos // 3 = b.pos // 3 WHERE a.n > 1 GROUP BY a.pos, a.lv),
x AS (SELECT l.doc_id, l.source, l.pos AS i, s.pos AS sat, top, 0 AS lv, shown AS h, '' AS proof
    FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source
  UNION ALL SELECT x.doc_id, x.source, x.i // 3, sat, top, x.lv + 1, sha256(lo || h || hi), proof || lo || hi
    FROM x JOIN st ON x.source IS NOT DISTINCT FROM st.source AND st.lv = x.lv AND st.pos = x.i WHERE x.lv < top),
y AS (SELECT doc_id, sat, 0 AS lv, h, proof FROM x WHERE lv = top
  UNION ALL SELECT doc_id, sat // 3, y.lv + 1, sha256(lo || h || hi), proof || lo || hi
    FROM y JOIN sf ON sf.lv = y.lv AND sf.pos = sat WHERE y.lv < (SELECT top FROM m))
SELECT l.doc_id, l.leaf, s.subroot, f.h AS root, sha256(y.proof) AS proof_sha256, y.h AS folded_root, y.h = f.h AS verified
FROM l JOIN s ON l.source IS NOT DISTINCT FROM s.source JOIN y ON y.doc_id = l.doc_id AND y.lv = (SELECT top FROM m)
  CROSS JOIN (SELECT h FROM f WHERE n = 1) f""")
def op12_cogrouped_subtrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    tampered = F.when(even, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered)


@query()
def op13_factor_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return factor_machine.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
