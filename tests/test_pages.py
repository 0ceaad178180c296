"""Pages of a stored ranking against offset paging."""

import random

from pyspark.sql import functions as F

from tierline.operators.pages import RankedTable
from tierline.operators.ranking import page


def order():
    return [F.col("score").desc_nulls_last(), F.col("name").asc(), F.col("id").asc()]


def rows(spark, n):
    rng = random.Random(n)
    data = [(i, rng.choice([None, 1, 2, 2, 2, 3]), rng.choice(["a", "b", None])) for i in range(n)]
    return spark.createDataFrame(data, "id long, score int, name string").repartition(5)


def test_pages_equal_offset_paging_with_ties_and_nulls(spark, tmp_path):
    df = rows(spark, 500)
    ranking = RankedTable.build(df, order(), str(tmp_path / "r"), ranges=7)
    assert ranking.total == 500 and len(ranking.firsts) >= 5
    for number in (1, 2, 9, 17, 18):
        want = [r.id for r in page(df, number, order(), 30).collect()]
        got = ranking.page(number, 30).collect()
        assert [r.id for r in got] == want
        assert [r.place for r in got] == list(range((number - 1) * 30, (number - 1) * 30 + len(want)))
    assert sorted(r.place for r in spark.read.parquet(f"{ranking.path}/rows").collect()) == list(range(500))
    assert RankedTable.open(spark, ranking.path) == ranking


def test_a_deep_page_reads_one_range(spark, tmp_path):
    df = spark.range(100_000).select("id", F.lit(1).alias("score"), F.lit("x").alias("name"))  # one long tie
    ranking = RankedTable.build(df, order(), str(tmp_path / "r"), ranges=8)
    deep = ranking.page(10_000, 10)
    assert [r.id for r in deep.collect()] == list(range(99_990, 100_000))
    plan = deep._jdf.queryExecution().executedPlan()
    assert "PartitionFilters: [isnotnull(range" in plan.toString()
    asked = [n for n in range(len(ranking.firsts)) if ranking.firsts[n] <= 99_990]
    assert max(asked) == len(ranking.firsts) - 1  # the last range alone holds the page
    assert ranking.after(99_999, 10).count() == 0


def test_the_end_of_a_page_opens_the_next(spark, tmp_path):
    ranking = RankedTable.build(rows(spark, 100), order(), str(tmp_path / "r"), ranges=3)
    seen, place = [], -1
    while got := ranking.after(place, 33).collect():
        seen += [r.id for r in got]
        place = got[-1].place
    assert len(seen) == len(set(seen)) == 100
