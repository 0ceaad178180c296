"""Readers, phrase files, sinks and the stream on small landed files."""

import pytest
from pyspark.sql import functions as F

from tierline import schemas as S
from tierline.functions import render_email
from tierline.sources import feeds, phrases, registers, sinks, templates
from tierline.streaming.news import compact, current_news, stream_merge_news


def test_register_latin1_ragged_and_bom(spark, tmp_path):
    reg = tmp_path / "reg.csv"
    reg.write_bytes('URN,Name\n1,"École ""A"", x"\n\n2\n'.encode("latin-1"))
    rows = registers.read_register(spark, str(reg)).collect()
    assert [tuple(r) for r in rows] == [("1", 'École "A", x'), ("2", None)]
    (tmp_path / "b").mkdir()
    for name in ("20240101.csv", "20240301.csv"):
        (tmp_path / "b" / name).write_bytes(b"\xef\xbb\xbfUkprn,Name\n" + name[:8].encode() + b",n\n")
    df = registers.read_provider_register(spark, str(tmp_path / "b"))
    assert df.columns == ["Ukprn", "Name"] and df.first()[0] == "20240301"


@pytest.mark.parametrize("reader", ["read_register", "read_inspections_csv", "read_provider_register"])
def test_readers_keep_quoted_line_breaks(spark, tmp_path, reader):
    body = b'URN,Name,Town\n1,"two\nlines",a\n\n2,"say ""x"", y",b,extra,cells\n3\n4,lo"ose,c\n'
    bom = b"" if reader == "read_register" else b"\xef\xbb\xbf"
    (tmp_path / "f.csv").write_bytes(bom + body)
    path = str(tmp_path if reader == "read_provider_register" else tmp_path / "f.csv")
    df = getattr(registers, reader)(spark, path)
    assert df.columns == ["URN", "Name", "Town"]
    want = [("1", "two\nlines", "a"), ("2", 'say "x", y', "b"), ("3", None, None), ("4", 'lo"ose', "c")]
    assert sorted(map(tuple, df.collect())) == want


def test_feeds(spark, tmp_path):
    rss = tmp_path / "f.xml"
    rss.write_text(
        '<?xml version="1.0"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>c</title>'
        "<item><title>A</title><description>&lt;p&gt;x  y&lt;/p&gt;</description><link>http://a</link><pubDate>Tue, 05 Mar 2024 23:30:00 GMT</pubDate></item>"
        "<item><title>B</title><content:encoded>body</content:encoded><link>http://b</link></item>"
        "<item><title></title><link>http://c</link></item></channel></rss>"
    )
    rows = {r.title: r for r in feeds.read_rss(spark, str(rss)).collect()}
    assert set(rows) == {"A", "B"} and rows["A"].summary == " x y " and rows["A"].published_at == "2024-03-05"
    assert rows["B"].summary == "body" and len(rows["B"].content_hash) == 16
    atom = tmp_path / "a.xml"
    atom.write_text(
        '<feed><entry><title>T</title><summary>s</summary><link rel="x" href="http://t"/><link href="http://u"/><updated>2024-01-02T03:04:05Z</updated></entry></feed>'
    )
    r = feeds.read_atom(spark, str(atom)).first()
    assert (r.title, r.link, r.published_at) == ("T", "http://t", "2024-01-02")


def test_phrase_library(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "a.yaml").write_text('phrases:\n  - {id: a.x, pattern: "c++ (x)", severity: 2, curricula: [online_safety]}\n')
    (tmp_path / "b.yaml").write_text('phrases:\n  - id: a.y\n    pattern: "m\\\\s+n"\n    regex: true\n    severity: 1\n    curricula: [online_safety]\n    guards: ["no"]\n')
    lib = phrases.load_library(spark, str(tmp_path))
    assert [p.id for p in lib.phrases] == ["a.x", "a.y"] and len(lib.sha256) == 64
    assert phrases.load_phrases(spark, str(tmp_path)).count() == 2
    (tmp_path / "c.yaml").write_text('phrases:\n  - {id: a.x, pattern: z, severity: 2, curricula: [online_safety]}\n')
    with pytest.raises(ValueError, match="duplicate"):
        phrases.load_library(spark, str(tmp_path))


def test_templates(spark, tmp_path):
    (tmp_path / "online-safety.md").write_text("Subject: Hi {{institution_name}}\n\nDear {{head_name}}, {{region}}\n")
    (tmp_path / "notes.txt").write_text("no template")
    got = templates.read_templates(spark, str(tmp_path))
    assert list(got) == ["online_safety"]
    df = spark.createDataFrame([("A", "online_safety"), ("B", "other")], "institution_name string, top_curriculum string")
    rows = sorted(tuple(r)[2:] for r in render_email(df, got).collect())
    assert rows == [("(no template for other)", ""), ("Hi A", "Dear there, [region]")]


def test_export_quoting(spark, tmp_path):
    df = spark.createDataFrame([('a "q", b', None, " pad")], "x string, y string, z string")
    sinks.write_export(df, str(tmp_path / "e"))
    parts = [p.read_text().splitlines() for p in sorted((tmp_path / "e").glob("part-*.csv"))]
    assert {p[0] for p in parts} == {"x,y,z"}
    assert [line for p in parts for line in p[1:]] == ['"a ""q"", b",, pad']


def test_briefs_sink_keeps_reading_order(spark, tmp_path):
    lines = spark.range(200).select(
        F.lit(1).alias("institution_id"), F.lit("f.md").alias("file_name"), F.lit(0).alias("block"),
        (-F.col("id")).cast("double").alias("place"), F.col("id").alias("item_id"), F.col("id").cast("string").alias("text"),
    )
    sinks.write_briefs(lines, str(tmp_path / "b"))
    parts = sorted((tmp_path / "b" / "file_name=f.md").glob("part-*"))
    assert [x for p in parts for x in p.read_text().split()] == [str(i) for i in reversed(range(200))]


def test_stream_merge(spark, tmp_path):
    land, table, check = (str(tmp_path / x) for x in ("in", "table", "check"))

    def batch(rows):
        df = spark.createDataFrame(rows, "url string, institution_id long, source string, title string, excerpt string, published_at string, relevance int, content_hash string, seen_at timestamp_ntz")
        df.withColumn("seen_at", F.col("seen_at").cast("timestamp")).write.mode("append").parquet(land)
        return df

    import datetime as dt

    day = dt.datetime(2024, 1, 1)
    batch([("u", 1, "s", "one", None, None, 60, "h", day), ("v", 1, "s", "other", None, None, 60, "h", day)])
    schema = spark.read.parquet(land).schema
    stream = lambda: spark.readStream.schema(schema).parquet(land)
    stream_merge_news(stream(), table, check).awaitTermination()
    batch([("u", 1, "s", "two", None, None, 70, "h2", day + dt.timedelta(days=30))])
    stream_merge_news(stream(), table, check).awaitTermination()
    rows = {r.url: r for r in current_news(spark, table).collect()}
    assert set(rows) == {"u", "v"} and rows["u"].title == "two" and rows["u"].relevance == 70
    assert rows["u"].trigger_severity == 0 and S.NEWS_ITEMS
    # late rows of new keys are kept, late sights of known ones do not win, refreshed excerpts do
    batch([("w", 1, "s", "late", None, None, 60, "h", day - dt.timedelta(days=90)), ("u", 1, "s", "old", "x", None, 10, "h", day), ("v", 1, "s", "other", "new excerpt", None, 70, "h", day + dt.timedelta(days=1))])
    stream_merge_news(stream(), table, check).awaitTermination()
    want = {"u": ("two", None, 70), "v": ("other", "new excerpt", 70), "w": ("late", None, 60)}
    read = lambda: {r.url: (r.title, r.excerpt, r.relevance) for r in current_news(spark, table).collect()}
    assert read() == want
    compact(spark, table)
    assert read() == want
    # text A, then B, then A again
    batch([("v", 1, "s", "B", None, None, 70, "b", day + dt.timedelta(days=2)), ("v", 1, "s", "other", None, None, 71, "h", day + dt.timedelta(days=3))])
    stream_merge_news(stream(), table, check).awaitTermination()
    assert read() == want | {"v": ("other", None, 71)}
    compact(spark, table)
    compact(spark, table)
    assert read() == want | {"v": ("other", None, 71)}
