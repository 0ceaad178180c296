"""LIKE searches through the stored grams, against a scan."""

import random

import pytest

from tierline.operators.grams import GramIndex, pattern_grams

SCHEMA = "k long, t string, gram int"


@pytest.fixture(scope="module")
def names(spark, tmp_path_factory):
    rng = random.Random(3)
    words = ["the", "The", "an", "İzmir", "ΟΔΟΣ", "aaaa", "100%", "a_b", "back\\slash", "𝒳𝒴z", "training", "TRAIN", "ing", "x"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(5))), i) for i in range(300)]
    rows += [(7, "the same id again", -1), (None, "no id training", -2), (None, "no id either", -3), (500, None, 0), (501, "", 0), (502, "training " * 2000, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    return df, GramIndex.build(df, "k", "t", str(tmp_path_factory.mktemp("grams") / "i"), buckets=16)


def test_grams_of_patterns():
    assert pattern_grams("%abcd%") == {"abc", "bcd"}
    assert pattern_grams("ab%") == {"\x02ab"} and pattern_grams("%ab") == {"ab\x03"}
    assert pattern_grams("%a_bcd%") == {"bcd"} and pattern_grams("%a\\_b%") == {"a_b"}
    assert pattern_grams("%ab%") == set() and pattern_grams("") == set()


PATTERNS = [
    ["%training%"], ["the %"], ["%THE"], ["%the%train%"], ["%a\\_b%"], ["%100\\%%"], ["%100%"], ["%back\\\\slash%"], ["%𝒳𝒴Z%"], ["%i̇zmir%"],
    ["%ΟΔΟΣ%"], ["%οδος%"], ["%an%"], ["_he%"], [""], ["%"], ["%nowhere%"], ["%nowhere%", "%either"], ["%same%", "no id%", "%aaaa aaaa%"], ["%ing ing%", "x"], [],
]


@pytest.mark.parametrize("patterns", PATTERNS)
def test_search_equals_a_scan(names, patterns):
    df, index = names
    want = df.where(" OR ".join(["false"] + ["t ILIKE '{}'".format(p.replace("\\", "\\\\")) for p in patterns]))
    order = lambda rows: sorted(map(tuple, rows), key=str)
    assert order(index.search(patterns).collect()) == order(want.collect())


def test_only_asked_buckets_are_read(spark, names):
    _, index = names
    index = GramIndex.open(spark, index.path)
    read = index._of("postings", sorted(pattern_grams("%same%")))
    assert read.select("bucket").distinct().count() <= 2 and index._read("postings").select("bucket").distinct().count() > 8
    for df, column in ((read, "bucket"), (index.candidates(["%same%"]), "bucket"), (index.search(["%same%"]), "row_bucket")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        filters = plan.split("PartitionFilters: [")[1].split("]")[0]
        assert f"{column}#" in filters and (" IN (" in filters or " = " in filters)


def test_an_empty_table(spark, tmp_path):
    index = GramIndex.build(spark.createDataFrame([], SCHEMA), "k", "t", str(tmp_path / "i"))
    assert index.search(["%abc%"]).collect() == [] and index.search(["%a%"]).collect() == []
