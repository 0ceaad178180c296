"""Plans and results under skew: one key that owns a third of the rows."""

import random

import pytest
from pyspark.sql import functions as F

from tierline.operators import dedup, joins, matching, ranking, upsert
from tierline.functions.text import all_indexes, portable
from tierline.functions.walk import Walk
from tierline.operators.findings import extract_findings, quote_spans
from tierline.operators.sections import sectionise
from tierline.session import _bytes, cut_lineage, tune


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_n_cuts_before_the_exchange(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    out = ranking.top_n_per(df, ["k"], [F.col("v").desc()], 3)
    text = plan(out)
    assert "WindowGroupLimit" in text and ", Partial" in text
    assert [r.v for r in out.where("k = 0").orderBy(F.desc("v")).collect()] == [8997, 8994, 8991]


def test_evidence_needs_one_exchange_of_flags(spark):
    facts = spark.range(1000).select((F.col("id") % 7).alias("institution_id"), F.lit("u").alias("report_url"))
    notices = facts.select("institution_id", F.lit(None).cast("string").alias("withdrawn_at"))
    news = facts.select("institution_id", F.lit(60).alias("trigger_severity"))
    flags = joins.evidence_flags(facts, notices, news)
    assert plan(flags).count("Exchange hashpartitioning") == 1
    assert flags.count() == 7


def test_upsert_is_idempotent_and_sequential(spark):
    target = spark.createDataFrame([(1, "a", "w"), (None, "n", "w")], "k int, x string, y string")
    source = spark.createDataFrame([(1, "b", None, 1), (1, "c", "z", 2), (2, "d", None, 3), (2, "e", None, 4), (None, "f", "g", 5)], "k int, x string, y string, o int")
    once = upsert.upsert(target, source, ["k"], overwrite=["x"], keep_if_null=["y"], order="o", null_keys=True)
    want = sorted([(1, "c", "z"), (2, "e", None), (None, "f", "g"), (None, "n", "w")], key=str)
    assert sorted(map(tuple, once.collect()), key=str) == want
    keyed = source.where("k is not null")
    twice = upsert.upsert(once, keyed, ["k"], overwrite=["x"], keep_if_null=["y"], order="o", null_keys=True)
    assert sorted(map(tuple, twice.collect()), key=str) == want


def test_surrogate_ids_tell_nulls_apart(spark):
    df = spark.createDataFrame([("123", None), (None, "123"), (None, None), ("123", "123")], "a string, b string")
    for make in (upsert.surrogate_id, upsert.wide_id):
        assert df.select(make("k", "a", "b").alias("i")).distinct().count() == 4
    wide = df.select(upsert.wide_id("k", "a", "b").alias("i"))
    assert wide.dtypes == [("i", "decimal(38,0)")] and wide.where("i IS NULL").count() == 0


def test_missing_providers_read_in_order(spark):
    from tierline import schemas
    from tierline.operators.ingest import missing_providers

    def created(pairs):
        rows = spark.createDataFrame(
            [(i, u, k, f"n{i}", "itp", None, None) for i, (u, k) in enumerate(pairs)],
            "row_no long, urn string, ukprn string, name string, type string, region string, local_authority string",
        )
        return {r.name for r in missing_providers(rows, spark.createDataFrame([], schemas.INSTITUTIONS)).collect()}

    assert created([("A", "X"), ("A", "Y"), (None, "Y")]) == {"n0", "n2"}
    rng = random.Random(4)
    pairs = [(rng.choice([None, *"abcdefghij"]), rng.choice([None, *"0123456789"])) for _ in range(60)]
    pairs = [p for p in pairs if p != (None, None)]
    seen, want = set(), set()
    for i, (u, k) in enumerate(pairs):
        if ("u", u) not in seen and ("k", k) not in seen:
            want.add(f"n{i}")
            seen |= {x for x in (("u", u), ("k", k)) if x[1] is not None}
    assert created(pairs) == want


def _names(rng, n):
    words = ["north", "south", "skills", "college", "training", "of", "arts", "tech", "academy", "city"]
    return [" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(n)]


@pytest.mark.parametrize("hot", [1, matching.HOT])
def test_match_by_name_equals_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(matching, "HOT", hot)  # 1: nearly all names take the way of hot runs
    rng = random.Random(5)
    dim = _names(rng, 80) + ["south college of arts"] * 40  # a third share one name
    targets = _names(rng, 120) + [n + " x" for n in dim[:30]] + [n[2:] for n in dim[:30]]
    d = spark.createDataFrame([(i, n, True) for i, n in enumerate(dim)], "id int, name string, in_scope boolean")
    t = spark.createDataFrame([(i, n) for i, n in enumerate(targets)], "i int, n string")
    got = {r.i: r.institution_id for r in matching.match_by_name(t, d, "n").collect()}

    def brute(name):
        key = name.strip()
        if len(key) < 4:
            return None
        exact = [i for i, n in enumerate(dim) if n == key]
        if exact:
            return exact[0]
        near = [i for i, n in enumerate(dim) if min(len(n), len(key)) >= 5 and (n in key or key in n) and min(len(n), len(key)) / max(len(n), len(key)) >= 0.5]
        return near[0] if len(near) == 1 else None

    assert got == {i: brute(" ".join(n.split())) for i, n in enumerate(targets)}


def test_match_mentions_equals_brute_force(spark):
    rng = random.Random(6)
    dim = _names(rng, 60) + ["skills academy"] * 30
    texts = [" ".join(_names(rng, rng.randint(1, 8))) for _ in range(80)]
    d = spark.createDataFrame([(i, n, True) for i, n in enumerate(dim)], "id int, name string, in_scope boolean")
    a = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "a int, x string")
    got = sorted((r.a, r.institution_id) for r in matching.match_mentions(a, d, "a", "x", per_article=3).collect())
    want = []
    for i, x in enumerate(texts):
        ids = [j for j, n in enumerate(dim) if len(n) >= 8 and sum(len(w) >= 3 for w in n.split()) >= 2 and f" {n} " in f" {x} "]
        want += [(i, j) for j in ids[:3]]
    assert got == sorted(want)


def test_match_mentions_keeps_all_by_default_and_long_keys(spark):
    long = "north skills college training of arts tech academy city south training centre"
    d = spark.createDataFrame([(i, "skills academy", True) for i in range(9)] + [(50, long, True)], "id int, name string, in_scope boolean")
    a = spark.createDataFrame([(1, f"The skills academy and the {long}."), (2, long.replace("centre", "x"))], "a int, x string")
    got = sorted((r.a, r.institution_id) for r in matching.match_mentions(a, d, "a", "x").collect())
    assert got == [(1, i) for i in [*range(9), 50]]


def test_match_mentions_normalises_names_and_texts_once(spark):
    d = spark.createDataFrame([(i, "skills academy", True) for i in range(9)], "id int, name string, in_scope boolean")
    a = spark.createDataFrame([(1, "The skills academy.")], "a int, x string")
    found = matching.match_mentions(a, d, "a", "x", per_article=3)
    # the names come from a stored index, and no text is joined where all keys are runs
    assert plan(found).count("Scan ExistingRDD") == 1
    assert sorted(r.institution_id for r in found.collect()) == [0, 1, 2]


def test_match_by_name_with_a_very_long_name(spark):
    words = " ".join(f"w{i}x" for i in range(5000))
    d = spark.createDataFrame([(1, words, True), (2, "alpha skills trust", True)], "id int, name string, in_scope boolean")
    t = spark.createDataFrame([(1, words[:-4]), (2, "alpha skills trust north"), (3, "alpha")], "i int, n string")
    got = {r.i: r.institution_id for r in matching.match_by_name(t, d, "n").collect()}
    assert got == {1: 1, 2: 2, 3: None}


def test_no_nested_loop_or_cartesian_in_matching(spark):
    d = spark.createDataFrame([(1, "north college", True)], "id int, name string, in_scope boolean")
    t = spark.createDataFrame([(1, "north")], "i int, n string")
    for text in (plan(matching.match_by_name(t, d, "n")), plan(matching.match_mentions(t, d, "i", "n"))):
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_name_runs_are_not_sent_through_the_driver(spark):
    """A name has many runs, which a guess from the names' file does not see."""
    short = cut_lineage(spark.createDataFrame([("north",)], "k string"), "short")
    long = cut_lineage(spark.createDataFrame([("north college",), ("the north star",)], "k string"), "long")
    met = matching._contained(short, long)
    assert "BroadcastHashJoin" not in plan(met)
    assert {tuple(r) for r in met.select("short", "long").collect()} == set()
    assert {r.long for r in matching._contained(short, cut_lineage(long.selectExpr("substring(k, 1, 9) AS k"), "cut")).collect()} == {"north col", "the north"}


def test_broadcast_limits_are_lowered_and_never_raised(spark):
    asked, measured = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    own = spark.newSession()
    for before, after in (("10485760b", ("1m", "10m")), ("256k", ("256k", "10m")), ("-1", ("-1", "10m"))):
        own.conf.set(asked, before)
        own.conf.unset(measured)
        tune(own)
        assert own.conf.get(asked) == after[0] and _bytes(own.conf.get(measured)) <= _bytes(after[1])
        tune(own)
        assert own.conf.get(asked) == after[0]


def test_splits_are_made_smaller_and_never_larger(spark):
    """What a map task reads of a stored table it may have to sort."""
    own, key = spark.newSession(), "spark.sql.files.maxPartitionBytes"
    for before, most in (("134217728", 24 << 20), ("128MB", 24 << 20), ("1m", 1 << 20), ("1000", 1000)):
        own.conf.set(key, before)
        for _ in range(2):
            tune(own)
            assert _bytes(own.conf.get(key)) == most


def test_survivorship_last_loser_wins(spark):
    rows = [(1, "100", None, None, "gias", 0), (2, None, None, "w2", "apar", 0), (3, None, "e3", "w3", "isi", 7)]
    inst = spark.createDataFrame(rows, "id long, urn string, general_email string, website string, source string, apprenticeship_standards int")
    for c in ("ukprn", "isi_id", "postcode", "head_email"):
        inst = inst.withColumn(c, F.lit(None).cast("string"))
    inst = inst.withColumns({"name": F.lit("Same Name Ltd"), "type": F.lit("itp"), "in_scope": F.lit(True)})
    mapping = dedup.id_map(inst)
    assert sorted(map(tuple, mapping.collect())) == [(2, 1), (3, 1)]
    r = dedup.survivorship(inst, mapping).collect()
    assert len(r) == 1 and (r[0].website, r[0].general_email, r[0].source, r[0].apprenticeship_standards) == ("w3", "e3", "gias+isi", 7)


def test_sections_keep_whole_text(spark):
    intro = "Intro. " * 40
    text = intro + "\nRecommendations\n" + "do this well. " * 20 + "\n\n  Annex\nnoise\nSafeguarding\n" + "is sound here. " * 10
    df = spark.createDataFrame([(1, text), (2, "short")], "inspection_id int, t string")
    rows = {(r.inspection_id, r.section_key): r for r in sectionise(df, "t").collect()}
    assert set(rows) == {(1, "summary"), (1, "recommendations"), (1, "safeguarding"), (2, "body")}
    assert rows[1, "summary"].section_text == intro.strip()
    assert rows[1, "recommendations"].section_text == ("Recommendations\n" + "do this well. " * 20).strip()
    assert rows[1, "safeguarding"].order_index == 2


def _spans(text, *phrases):
    return [(i, a, b) for i, a, b in quote_spans(text, Walk(list(phrases)))]


def test_quote_spans_grow_outward():
    text = "One. " + "a" * 300 + " hit " + "b" * 300 + "! Tail."
    assert _spans(text, ("hit", False)) == [(0, 4, text.index("!") + 1)]


def test_quote_spans_equal_a_plain_walk():
    """One walk of the automaton against one regex at a time: overlapping, nested, repeated and folded patterns."""
    import re
    from bisect import bisect_left

    rng = random.Random(8)
    parts = ["hit", "Hit ", "hihit", "aaa", "é", "😀", "É", "word " * 9, ". ", "!", "?", "\uffff", "K", "\n", "\u00a0"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 120))) for _ in range(150)]
    phrases = [("hit", False), ("it h", False), ("aa", False), ("a.", False), ("é", False), ("k", False), (r"(?i)\bword\s+hit\b", True),
               (r"(?i)(?:hit|aa)+", True), ("(?i)word", True), (r"(?i)[.!]\s", True), ("hit", False), ("😀", False)]

    def plain(text):
        ends = [m.start() for m in re.finditer(r"[.!?]", text)]
        out = set()
        for i, (source, regex) in enumerate(phrases):
            folded = portable(source) if regex else "(?i)" + re.escape(source)
            for hit in re.finditer(folded.replace("(?i)", "(?ia)"), text):
                left = bisect_left(ends, max(0, hit.start() - 200))
                right = bisect_left(ends, min(len(text), hit.end() + 200))
                out.add((i, ends[left - 1] + 1 if left else 0, ends[right] + 1 if right < len(ends) else len(text)))
        return out

    for t in texts:
        got = _spans(t, *phrases)
        assert len(got) == len(set(got)) and set(got) == plain(t)


def test_ten_thousand_phrases_in_one_pass(spark):
    """A section is walked once however large the library is: each lower-casing is one walk."""
    from tierline.functions import walk
    from tierline.sources.phrases import Phrase

    phrases = [Phrase(f"p{i}", f"word {i} x", False, 1, ("c",), ("not",)) for i in range(10_000)]
    rows = [(i, i, "body", 0, 1.0, f"So word {i} x. Not word {i} xy! Word {i} X" + " and on" * 200) for i in range(50)]
    sections = spark.createDataFrame(rows, "inspection_id long, institution_id long, section_key string, order_index int, multiplier double, section_text string")
    got = extract_findings(sections, phrases).collect()
    assert sorted({(r.inspection_id, r.phrase_id) for r in got}) == sorted((i, f"p{i}") for i in range(50))
    assert "MapInArrow" in plan(extract_findings(sections, phrases)) and "Exchange" not in plan(extract_findings(sections, phrases))
    seen, before = [], walk.lower
    walk.lower = lambda text: seen.append(1) or before(text)
    try:
        w = walk.Walk([(p.pattern, False) for p in phrases])
        seen.clear()
        assert len(list(w.all(rows[3][5]))) == 3
    finally:
        walk.lower = before
    assert len(seen) == 1


def test_portable_dots_and_line_edges():
    from tierline.functions.walk import compiled

    assert [m.start() for m in compiled(portable(r"(?im)^\s*annex\b")).finditer("Annex\u2028annex x annex\nannexe\rANNEX")] == [0, 6, 27]
    assert compiled(portable("a.b")).search("a\rb") is None


def test_all_indexes_are_linear_and_exact(spark):
    text = "ab😀" * 30_000
    df = spark.createDataFrame([(text,), ("x",), ("",), (None,)], "t string")
    got = [r[0] for r in df.select(all_indexes(F.col("t"), "b.")).collect()]
    assert got == [[3 * i + 1 for i in range(30_000)], [], [], []]
