"""From feed files to the table of news: restarts, sights out of order, compaction and what it deletes."""

import os

from tierline.streaming import news

NAMES = [(1, "Northgate Training Centre Ltd", True), (2, "Harbour Skills College", True), (3, "Ltd", True), (4, "Harbour Skills College East", False)]


def land(folder, source, name, items, at, kind="rss"):
    os.makedirs(folder / f"source={source}", exist_ok=True)
    rss = "".join(f"<item><title>{t}</title><description>{d}</description><link>{u}</link><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate></item>" for t, d, u in items)
    atom = "".join(f'<entry><title>{t}</title><summary>{d}</summary><link href="{u}"/><updated>2024-03-05T10:00:00Z</updated></entry>' for t, d, u in items)
    path = folder / f"source={source}" / name
    path.write_text(f"<rss><channel>{rss}</channel></rss>" if kind == "rss" else f"<feed>{atom}</feed>")
    os.utime(path, (at, at))


def start(spark, tmp_path, **how):
    paths = (str(tmp_path / x) for x in ("feeds", "index", "table", "check"))
    news.stream_feeds(spark, *paths, **how).awaitTermination()
    rows = news.current_news(spark, str(tmp_path / "table")).collect()
    return {(r.url, r.institution_id): (r.source, r.title, r.excerpt, r.published_at) for r in rows}


def test_feed_files_become_news(spark, tmp_path):
    news.store_mention_index(spark.createDataFrame(NAMES, "id int, name string, in_scope boolean"), str(tmp_path / "index"))
    feeds = tmp_path / "feeds"
    day = "2024-03-05"
    land(feeds, "a", "1.xml", [("Visit to Northgate training centre", "short", "u1"), ("Nobody", "is named", "u2"), ("", "Northgate Training Centre", "u3")], 1000)
    assert start(spark, tmp_path) == {("u1", 1): ("a", "Visit to Northgate training centre", "short", day)}
    # a title and a summary are one text, an institution out of scope is no match, a repeated item counts once
    both = ("At Harbour Skills", "College East &amp; Northgate Training Centre", "u4")
    land(feeds, "b", "2.xml", [both, both], 2000)
    # a file that comes late but was seen before the stored state does not win
    land(feeds, "a", "0.xml", [("Old words on Northgate Training Centre", "old", "u1")], 500)
    want = {("u1", 1): ("a", "Visit to Northgate training centre", "short", day)}
    want |= {("u4", i): ("b", "At Harbour Skills", "College East & Northgate Training Centre", day) for i in (1, 2)}
    assert start(spark, tmp_path) == want
    assert start(spark, tmp_path) == want  # nothing new: no batch


def test_log_is_folded_and_cleaned_between_batches(spark, tmp_path):
    news.store_mention_index(spark.createDataFrame(NAMES, "id int, name string, in_scope boolean"), str(tmp_path / "index"))
    feeds = tmp_path / "feeds"
    for i in range(7):
        land(feeds, "a", f"{i}.xml", [(f"Day {i} at Northgate Training Centre", "x", "u"), (f"Harbour Skills College {i}", "y", f"v{i}")], 1000 + i, kind="atom")
    got = start(spark, tmp_path, kind="atom", files_per_batch=1, compact_every=2)
    assert got[("u", 1)][1] == "Day 6 at Northgate Training Centre" and len(got) == 8
    # batches 0 to 6; bases before batches 2, 4 and 6: the last but one (3) is the oldest still readable
    assert sorted(os.listdir(tmp_path / "table" / "log")) == [f"batch={n}" for n in (4, 5, 6)]
    assert sorted(d for d in os.listdir(tmp_path / "table" / "base") if d[0] == "u") == ["upto=3", "upto=5"]
    # a batch that runs again after its compaction changes nothing
    news.compact(spark, str(tmp_path / "table"), before=6, clean=True)
    assert sorted(os.listdir(tmp_path / "table" / "log")) == [f"batch={n}" for n in (4, 5, 6)]
    assert {(r.url, r.institution_id) for r in news.current_news(spark, str(tmp_path / "table")).collect()} == set(got)


def test_a_base_folds_in_only_bases_that_cover_no_more_batches(spark, tmp_path):
    news.store_mention_index(spark.createDataFrame(NAMES, "id int, name string, in_scope boolean"), str(tmp_path / "index"))
    for i in range(9):
        land(tmp_path / "feeds", "a", f"{i}.xml", [(f"Harbour Skills College {i}", "y", f"v{i}"), (f"Day {i} at Harbour Skills College", "y", "u")], 1000 + i)
    got = start(spark, tmp_path, files_per_batch=1, compact_every=2)
    assert got[("u", 2)][1] == "Day 8 at Harbour Skills College" and len(got) == 10
    # bases before batches 2, 4, 6 and 8 cover the batches 0-1, 0-3, 4-5 and 0-7
    table = str(tmp_path / "table")
    named = {r.upto: r.since for r in spark.read.parquet(f"{table}/bases").collect()}
    assert named == {1: -1, 3: -1, 5: 3, 7: -1}
    base = spark.read.parquet(f"{table}/base")
    assert {r.upto: r["count"] for r in base.groupBy("upto").count().collect()} == {3: 5, 5: 3, 7: 9}
    # a table whose bases were named before they had a ``since`` reads alike
    spark.range(7, 8).toDF("upto").write.mode("overwrite").parquet(f"{table}/bases")
    assert {(r.url, r.institution_id) for r in news.current_news(spark, table).collect()} == set(got)


def test_the_index_keeps_the_ids_that_an_item_can_be_given(spark, tmp_path):
    names = [(i, "Harbour Skills College", True) for i in range(9, 0, -1)] + [(20, "Harbour Skills College East", True)]
    news.store_mention_index(spark.createDataFrame(names, "id int, name string, in_scope boolean"), str(tmp_path / "index"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "index")).collect()) == [1, 2, 3, 20]
    land(tmp_path / "feeds", "a", "1.xml", [("At Harbour Skills College East", "x", "u")], 1000)
    assert sorted(start(spark, tmp_path)) == [("u", 1), ("u", 2), ("u", 3)]
