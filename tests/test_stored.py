"""Stored tables changed by bucket, and extraction that reads only what is new."""

import os
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tierline.operators import ledger as lg
from tierline.operators.buckets import BucketedTable
from tierline.sources.phrases import Library, Phrase

SCHEMA = "k int, x string, y string"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def bucket_of(path):
    return int(path.split("bucket=")[1].split("/")[0])


@pytest.fixture
def table(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path / "t"), SCHEMA, ("k",), buckets=8)
    table.write(spark.createDataFrame([(i, f"x{i}", None) for i in range(40)] + [(None, "n1", None), (None, "n2", None)], SCHEMA))
    return table


def rows(table):
    return sorted(map(tuple, table.read().collect()), key=str)


def test_an_upsert_writes_only_touched_buckets(spark, table):
    before, old = files(table.path), rows(table)
    # keys of another width hash alike once cast to the table's types
    source = spark.createDataFrame([(3, "a", "y", 1, 0), (3, "b", None, 2, 0), (1000, "new", "z", 3, 0)], "k long, x string, y string, o int, extra int")
    touched = table.upsert(source, ["k"], overwrite=["x"], keep_if_null=["y"], order="o")
    after = files(table.path)
    changed = {bucket_of(p) for p in before.keys() ^ after.keys()} | {bucket_of(p) for p in before if after.get(p) != before[p]}
    assert changed == set(touched) and len(touched) <= 2
    want = sorted([r for r in old if r[0] != 3] + [(3, "b", "y"), (1000, "new", "z")], key=str)
    assert rows(table) == want
    table.upsert(source, ["k"], overwrite=["x"], keep_if_null=["y"], order="o")
    assert rows(table) == want


def test_only_touched_folders_are_read(table):
    plan = table.read([2, 5])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "bucket" in plan.split("PartitionFilters")[1][:200]
    assert table.read([2, 5]).count() + table.read([b for b in range(8) if b not in (2, 5)]).count() == 42


def test_a_new_table_and_an_empty_source(spark, tmp_path, table):
    fresh = BucketedTable(spark, str(tmp_path / "fresh"), SCHEMA, ("k",), buckets=4)
    assert rows(fresh) == []
    assert fresh.upsert(spark.createDataFrame([], SCHEMA), ["k"]) == []
    fresh.upsert(spark.createDataFrame([(1, "a", None)], SCHEMA), ["k"])
    assert rows(fresh) == [(1, "a", None)]


def test_null_keys_are_inserted_and_stay(spark, table):
    table.upsert(spark.createDataFrame([(None, "n3", None), (5, "x5", "five")], SCHEMA), ["k"], keep_if_null=["y"])
    got = rows(table)
    assert [r for r in got if r[0] is None] == [(None, "n1", None), (None, "n2", None), (None, "n3", None)]
    assert (5, "x5", "five") in got and len(got) == 43


def test_children_of_a_parent_without_new_ones_go(spark, table):
    parents = spark.createDataFrame([(i,) for i in range(40)] + [(77,)], "k int")
    new = spark.createDataFrame([(7, "child", "1"), (7, "child", "2")], SCHEMA)
    table.replace_children(new, parents)
    assert [r for r in rows(table) if r[0] is not None] == [(7, "child", "1"), (7, "child", "2")]
    assert len(rows(table)) == 4  # rows without a key have no parent


def test_a_write_cannot_reach_buckets_that_were_not_read(spark, table):
    own = table.touched(spark.createDataFrame([(3,)], "k int"))
    stranger = next(k for k in range(40) if table.touched(spark.createDataFrame([(k,)], "k int")) != own)
    before = rows(table)
    with pytest.raises(ValueError, match="outside"):
        table.change(own, lambda t: t.withColumn("k", F.lit(stranger)))
    assert rows(table) == before


LIBRARY = Library([Phrase("p", "poor work", False, 2, ("c",), ("not",))], "v1")


def inspections(spark, texts):
    data = [(i, i % 3, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(data, "inspection_id long, institution_id long, report_text string")


def test_the_second_run_reads_nothing_and_a_changed_text_one(spark, tmp_path):
    folder = str(tmp_path / "ledger")
    texts = ["Some poor work here. " + "And on. " * 30, "x", None, "", "Recommendations\n" + "Poor work again! " * 20, "x"]
    sections, findings, read = lg.extract_incrementally(inspections(spark, texts), LIBRARY, folder)
    assert read == {"sections": 3, "findings": 3}  # equal texts once, no text for null and empty
    first = sorted(map(str, findings.collect()))
    assert {r.inspection_id for r in findings.collect()} == {0, 4}
    assert {r.inspection_id for r in sections.collect()} == {0, 1, 4, 5}

    _, again, read = lg.extract_incrementally(inspections(spark, texts), LIBRARY, folder)
    assert read == {"sections": 0, "findings": 0} and sorted(map(str, again.collect())) == first

    texts[1] = "Now it is not poor work."
    _, changed, read = lg.extract_incrementally(inspections(spark, texts), LIBRARY, folder)
    assert read == {"sections": 1, "findings": 1}
    assert {(r.inspection_id, r.suppressed) for r in changed.collect()} == {(0, False), (1, True), (4, False)}

    other = replace(LIBRARY, phrases=[Phrase("q", "again", False, 1, ("c",))], sha256="v2")
    _, new, read = lg.extract_incrementally(inspections(spark, texts), other, folder)
    assert read == {"sections": 0, "findings": 4} and {r.phrase_id for r in new.collect()} == {"q"}


def test_what_a_broken_run_left_is_not_read(spark, tmp_path):
    ledger = lg.Ledger(spark, str(tmp_path / "l"))
    texts = spark.createDataFrame([("h1", "a"), ("h2", "b")], "text_hash string, t string")
    found, n = ledger.process(texts, "k", "r", lambda new: new.select("text_hash", F.upper("t").alias("u")))
    assert n == 2 and sorted(map(tuple, found.collect())) == [("h1", "A"), ("h2", "B")]
    spark.createDataFrame([("h1", "broken")], "text_hash string, u string").write.parquet(f"{ledger.folder}/results/kind=k/rules=r/run=000")
    spark.createDataFrame([("k", "r", "h1", "zzz")], lg.DONE).write.mode("append").parquet(f"{ledger.folder}/done")
    found, n = ledger.process(texts, "k", "r", lambda new: new.select("text_hash", F.upper("t").alias("u")))
    assert n == 0 and sorted(map(tuple, found.collect())) == [("h1", "A"), ("h2", "B")]
