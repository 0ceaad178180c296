"""Matching records to institutions by name.

No candidate pairs are formed: each test is rewritten as an equality on
derived keys, and the side that may repeat a key is aggregated per key first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import norm_name, norm_school_name
from ..functions.runs import BITS, RunFilter, key_bits
from ..functions.text import non_blank
from ..session import cut_lineage
from .ranking import top_n_per

# ---- fixed values ---------------------------------------------------------
MIN_TARGET = 4
MIN_CONTAINED = 5
MIN_RATIO = 0.5
MIN_MENTION = 8
MIN_MENTION_TOKENS = 2
MIN_TOKEN = 3
MIN_SCHOOL_KEY = 4
# ---------------------------------------------------------------------------


GRAM = 5  # no longer than MIN_CONTAINED, so the shorter name always has one
HOT = 256  # holders of a run beyond which a rarer run is looked for


def _grams(key: Column) -> Column:
    """Distinct runs of ``GRAM`` characters: L - 4 of them."""
    return F.array_distinct(
        F.transform(F.sequence(F.lit(1), F.length(key) - GRAM + 1), lambda at: key.substr(at, F.lit(GRAM)))
    )


def _rarest(asked: DataFrame, held: DataFrame) -> DataFrame:
    """(short, g, holders): of the asked runs of each key (k, g) the one that the fewest longer keys hold.

    A key with a run that no longer key has is dropped.
    """
    often = held.groupBy("g").agg(F.count(F.lit(1)).alias("holders"))
    least = F.min(F.struct(F.coalesce("holders", F.lit(0)).alias("holders"), "g")).alias("r")
    found = asked.join(often.hint("merge"), "g", "left").groupBy("k").agg(least).where("r.holders > 0")
    return found.select(F.col("k").alias("short"), F.col("r.g").alias("g"), F.col("r.holders").alias("holders"))


def _contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """(short, long) pairs of distinct keys where the one lies inside the other.

    Both sides are one column ``k`` of distinct keys of ``GRAM`` characters or
    more. A longer key holds the first and the last run of each key inside it,
    so a short key is asked for by the rarer of these two, and of the longer
    keys only runs that begin or end a short key are counted and joined. Where
    more than ``HOT`` longer keys hold even the rarer one, the short key is
    asked for by its rarest run of all.

    Names are cut into many runs, which no size that Spark guesses for a side
    takes into account; so sides of runs are shuffled, not sent to all tasks.
    """
    held = long.select(F.col("k").alias("long"), F.explode(_grams(F.col("k"))).alias("g"))
    ends = F.array_distinct(F.array(F.substring("k", 1, GRAM), F.substring("k", -GRAM, GRAM)))
    ends = short.select("k", F.explode(ends).alias("g"))
    near = held.join(ends.select("g").distinct().hint("merge"), "g", "left_semi")
    asked = cut_lineage(_rarest(ends, near), "asked")
    met = asked.where(F.col("holders") <= HOT).join(near.hint("merge"), "g").select("short", "long")
    hot = asked.where(F.col("holders") > HOT).select(F.col("short").alias("k"))
    if not hot.isEmpty():
        runs = hot.select("k", F.explode(_grams(F.col("k"))).alias("g"))
        met = met.unionByName(_rarest(runs, held).join(held.hint("merge"), "g").select("short", "long"))
    ratio = F.length("short") >= F.length("long") * MIN_RATIO
    longer = F.length("long") > F.length("short")
    return met.where(longer & ratio & F.col("long").contains(F.col("short")))


def match_by_name(left: DataFrame, dimension: DataFrame, name: str, out: str = "institution_id") -> DataFrame:
    """Institution id by exact key, else by the only containment partner.

    Names are compared once per distinct key, and the dimension is counted per
    key first: a key that millions of names share is one row with their number,
    and "exactly one partner" is a comparison of that number. Containment with
    a length ratio of at least one half is asked for by a rare run of five
    characters of the shorter key and then tested. Exact, no candidate cap.
    The distinct keys of both sides are stored once and read by all steps.
    """
    # Each name is normalised once, however many rows hold it.
    key = norm_name(F.col("__raw"), "notice")
    named = left.select(F.col(name).alias("__raw")).where(F.col("__raw").isNotNull()).distinct()
    named = cut_lineage(named.withColumn("__key", key), "names")
    named = named.where(F.length("__key") >= MIN_TARGET)
    index = (
        dimension.where(F.col("in_scope"))
        .select("id", norm_name(F.col("name"), "notice").alias("k"))
        .where(F.col("k") != "")
        .groupBy("k")
        .agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    )
    index = cut_lineage(index, "name-keys")
    targets = named.select("__key").distinct()
    exact = cut_lineage(targets.join(index, F.col("__key") == F.col("k"), "left").select("__key", "first_id"), "asked-keys")
    # Containment is only asked where there is no exact key.
    open_keys = exact.where(F.col("first_id").isNull() & (F.length("__key") >= MIN_CONTAINED)).select("__key")

    names = index.where(F.length("k") >= MIN_CONTAINED)
    asked = open_keys.select(F.col("__key").alias("k"))
    inside = _contained(names.select("k"), asked).select(F.col("long").alias("__key"), F.col("short").alias("k"))
    around = _contained(asked, names.select("k")).select(F.col("short").alias("__key"), F.col("long").alias("k"))
    only = (
        inside.unionByName(around)
        .join(index, "k")
        .groupBy("__key")
        .agg(F.sum("n").alias("n"), F.min("first_id").alias("contained_id"))
        .where(F.col("n") == 1)
        .select("__key", "contained_id")
    )
    resolved = exact.join(only, "__key", "left").select("__key", F.coalesce("first_id", "contained_id").alias(out))
    found = named.join(resolved.where(F.col(out).isNotNull()), "__key").select("__raw", out)
    return left.join(found, F.col(name) == F.col("__raw"), "left").drop("__raw")


RUN_TOKENS = 8  # tokens of a run taken from a text; longer keys are tested on the text
FIRST = 1 << 17  # keys of the lowest ids that all tasks have
MOST_BITS = 28  # bits of the bitmap of all keys at most, as a power of two: 32 MB


def mention_keys(dimension: DataFrame) -> DataFrame:
    """Searchable keys of the institutions in scope: id, k, n_tokens."""
    tokens = F.split("k", " ")
    return (
        dimension.where(F.col("in_scope"))
        .select("id", norm_name(F.col("name"), "news").alias("k"))
        .withColumn("n_tokens", F.size(tokens))
        .where(
            (F.length("k") >= MIN_MENTION)
            & (F.size(F.filter(tokens, lambda t: F.length(t) >= MIN_TOKEN)) >= MIN_MENTION_TOKENS)
        )
    )


def mention_index(dimension: DataFrame) -> DataFrame:
    """Keys by what a text is asked for first: id, k, n_tokens, head (its first eight tokens), lead (its first two)."""
    head = F.when(F.col("n_tokens") > RUN_TOKENS, F.substring_index("k", " ", RUN_TOKENS)).otherwise(F.col("k"))
    return mention_keys(dimension).withColumn("head", head).withColumn("lead", F.substring_index("k", " ", 2))


def lowest_ids(index: DataFrame, per_article: int | None) -> DataFrame:
    """The rows of a :func:`mention_index` that can be among the lowest ``per_article`` ids of an article.

    A text that names a key names all institutions of that key, so only the
    key's lowest ids count; with None all of them do.
    """
    return top_n_per(index, ["k"], [F.col("id").asc()], per_article)


def match_mentions(
    articles: DataFrame, dimension: DataFrame, article_id: str, text: str, per_article: int | None = None
) -> DataFrame:
    """(article, institution_id, relevance) of institutions named in a text.

    Key and text are both blank-padded token strings, so "contains" is the
    same as "some run of tokens equals the key". All tasks have a bitmap of the
    keys, a few bits for each, and ask it for the runs of each text that have
    as many tokens as some key; what it lets pass is compared with the keys. So
    neither texts nor all their runs are shuffled. With ``per_article`` only the
    lowest ids of each article stay: a text that names so many of the ``FIRST``
    keys of the lowest ids, which all tasks have too, gives no others.
    """
    # names are normalised once; the match reads the index several times
    keys = cut_lineage(lowest_ids(mention_index(dimension), per_article), "mention-keys")
    texts = articles.select(article_id, norm_name(F.col(text), "news").alias("t"))
    runs = _named_runs(texts, keys, per_article)
    # an article names a key once, a key of more tokens than RUN_TOKENS once for each of its texts
    long = F.col("n") > RUN_TOKENS
    runs = runs.where(~long | F.col(article_id).isNotNull())
    runs = runs.select(article_id, "k", F.when(long, F.monotonically_increasing_id()).otherwise(0).alias("nth")).distinct()
    found = runs.join(keys.select("k", F.col("id").alias("institution_id")), "k")
    return _lowest(found, article_id, per_article)


def _named_runs(texts: DataFrame, keys: DataFrame, per_article: int | None) -> DataFrame:
    """(article, k, n): runs of ``n`` tokens of the ``texts`` (article, t) that may be keys, once for each text."""
    spark = texts.sparkSession
    ids = F.struct(F.col("id").isNotNull(), "id")  # a null id comes first
    each = cut_lineage(keys.groupBy("k").agg(F.min("n_tokens").alias("n"), F.min(ids).alias("id")), "distinct-keys")
    lengths = [r.n for r in each.select("n").distinct().orderBy("n").collect()]  # a few numbers
    first = each.orderBy("id", "k").limit(FIRST).select("k").collect() if per_article else []
    size = 1 << max(18, min(MOST_BITS, (BITS * each.count()).bit_length()))

    def bits(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(key_bits(batch.column(0).to_pylist(), size) + 1, pa.int64())], ["bit"])

    slots = each.select("k").mapInArrow(bits, "bit long")
    maps = slots.groupBy(F.expr("bitmap_bucket_number(bit)").alias("at")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(bit))").alias("bits"))
    table = np.zeros(size // 8, np.uint8)
    for at, part in maps.toLocalIterator():  # size / 8 bytes at most
        table[(at - 1) * len(part) : at * len(part)] = np.frombuffer(part, np.uint8)[: len(table)]
    asked = spark.sparkContext.broadcast((table, lengths, [r.k.encode() for r in first]))

    def find(batches):
        known = RunFilter(*asked.value)
        for batch in batches:
            places, runs = [], []
            for place, run in known.named(batch.column(1).to_pylist(), per_article):
                places.append(place)
                runs.append(run.decode())
            n = pa.array([r.count(" ") + 1 for r in runs], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(places, pa.int64())), pa.array(runs, pa.string()), n], ["a", "k", "n"])

    (name, kind), _ = texts.dtypes
    return texts.mapInArrow(find, f"a {kind}, k string, n int").withColumnRenamed("a", name)


def _lowest(found: DataFrame, article_id: str, per_article: int | None) -> DataFrame:
    """Found keys (article, institution_id, k) with their relevance, the lowest ids of each article."""
    relevance = F.lit(50) + F.least(F.lit(40), F.floor(F.length("k") / 2).cast("int"))
    scored = found.select(article_id, "institution_id", relevance.alias("relevance"))
    return top_n_per(scored, [article_id], [F.col("institution_id").asc()], per_article)


def match_indexed(
    articles: DataFrame, keys: DataFrame, article_id: str, text: str, per_article: int | None = None
) -> DataFrame:
    """:func:`match_mentions` of a few articles, as of a batch, against an index that was stored before.

    One pass takes the run of up to eight tokens that begins at each token; a run is kept if its first two tokens
    begin some key, and then compared with the keys of the lengths that this beginning has. Keys of more than eight
    tokens are found by their first eight; texts are read again, and meet their hits, only if there are such keys.
    """
    has_long = keys.where(F.col("n_tokens") > RUN_TOKENS).limit(1).count() > 0
    lengths = F.collect_set(F.least("n_tokens", F.lit(RUN_TOKENS)))
    leads = keys.groupBy("lead").agg(lengths.alias("lengths"))
    texts = articles.select(article_id, norm_name(F.col(text), "news").alias("t"))
    # Each match consumes one token and captures the run that starts there, so
    # the regex is tried once per token.
    pattern = r"(?=([^ ]++(?: [^ ]++){1,%d}+))[^ ]++ ?" % (RUN_TOKENS - 1)
    runs = texts.select(
        article_id, F.explode_outer(F.array_distinct(F.regexp_extract_all("t", F.lit(pattern), F.lit(1)))).alias("run")
    ).where(F.col("run").isNotNull())
    led = runs.withColumn("lead", F.substring_index("run", " ", 2)).join(leads, "lead")
    tried = led.select(article_id, "run", F.explode("lengths").alias("n")).where(F.size(F.split("run", " ")) >= F.col("n"))
    heads = tried.select(article_id, F.expr("substring_index(run, ' ', n)").alias("head")).distinct()
    hits = heads.join(keys.select("head", "k", "n_tokens", F.col("id").alias("institution_id")), "head")
    columns = [article_id, "institution_id", "k"]
    found = hits.where(F.col("n_tokens") <= RUN_TOKENS).select(*columns)
    if has_long:
        tested = hits.where(F.col("n_tokens") > RUN_TOKENS).join(texts.withColumnRenamed(article_id, "__a"), F.col(article_id) == F.col("__a"))
        padded = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
        found = found.unionByName(tested.where(padded("t").contains(padded("k"))).select(*columns))
    return _lowest(found, article_id, per_article)


def link_or_create(schools: DataFrame, dimension: DataFrame) -> DataFrame:
    """Listing rows (isi_id, name, address) with their institution id.

    Linked by id, else by the school-name key among independent schools, else
    given a new deterministic id; ``how`` says which.
    """
    from .upsert import surrogate_id

    by_id = dimension.where(F.col("isi_id").isNotNull()).groupBy("isi_id").agg(F.min("id").alias("__by_id"))
    by_name = (
        dimension.where(F.col("type") == "independent_school")
        .groupBy(norm_school_name(F.col("name")).alias("__name"))
        .agg(F.min("id").alias("__by_name"))
    )
    key = norm_school_name(F.col("name"))
    keyed = schools.withColumn("__key", F.when(F.length(key) >= MIN_SCHOOL_KEY, key))
    # Unusable keys must not meet in one task: give them a value of their own.
    joined = keyed.join(by_id, "isi_id", "left").join(
        by_name, F.coalesce("__key", F.concat(F.lit("\x00"), F.col("isi_id"))) == F.col("__name"), "left"
    )
    how = F.when(F.col("__by_id").isNotNull(), "id").when(F.col("__by_name").isNotNull(), "name").otherwise("new")
    return joined.select(
        *schools.columns,
        F.coalesce("__by_id", "__by_name", surrogate_id("isi", "isi_id")).alias("institution_id"),
        how.alias("how"),
    )


def rank_company(candidates: DataFrame, institution: str = "institution_id") -> DataFrame:
    """Best company per institution among its search results.

    Columns: institution, name, postcode, position, company_number, title,
    company_status, company_postcode. First exact name key; else first equal
    postcode; else, among active ones if any, the nearest key length. The
    three winners are folded by one aggregate.
    """
    key, title_key = norm_name(F.col("name"), "company"), norm_name(F.col("title"), "company")
    squash = lambda c: F.upper(F.regexp_replace(c, r"\s", ""))
    active = F.col("company_status") == "active"
    same_place = (non_blank(F.col("postcode")).isNotNull()) & (
        squash(non_blank(F.col("company_postcode"))) == squash(F.col("postcode"))
    )
    gap = F.abs(F.length(title_key) - F.length(key))

    def first(cond: Column, order: Column) -> Column:
        return F.min_by("company_number", F.when(cond, order))

    at = F.struct(F.col("position"))
    by_gap = F.struct(gap, F.col("position"))
    return candidates.groupBy(institution).agg(
        F.coalesce(
            first(title_key == key, at), first(same_place, at), first(active, by_gap), F.min_by("company_number", by_gap)
        ).alias("company_number")
    )


def filter_feed_hits(
    items: DataFrame, provider: str, name: str, position: str, words: int = 2, first: int | None = None
) -> DataFrame:
    """Search results that really mention the provider, of its ``first`` ones (None: of all).

    ``words=2`` asks for the first two words of the name; ``words=1`` is the
    bulk rule: the first word, unchecked when shorter than four characters.
    """
    asked = top_n_per(items, [provider], [F.col(position).asc()], first)
    text = F.lower(F.concat_ws(" ", F.col("title"), F.coalesce("summary", F.lit(""))))
    lead = F.array_join(F.slice(F.split(F.lower(F.col(name)), " "), 1, words), " ")
    keep = text.contains(lead)
    if words == 1:
        keep = keep | (F.length(lead) < 4)
    return asked.where(keep)
