"""What the views read of their base tables: the same rows from less, and nothing that no plan asks for."""

import time
from string import ascii_lowercase, ascii_uppercase

import pytest

from demo.q_reports import tables
from demo.views import READS, VIEWS, Views, _needs
from tierline.functions.walk import lower
from tierline.plans import profiles

ROWS = {
    "region": ("r_regionkey bigint, r_name string", [(0, "EUROPE")]),
    "nation": ("n_nationkey bigint, n_name string, n_regionkey bigint", [(0, "FRANCE", 0), (7, "SPAIN", 0)]),
    "customer": (
        "c_custkey bigint, c_name string, c_nationkey bigint, c_acctbal double, c_mktsegment string",
        [(i, f"C{i}", 7 * (i % 2), 100.0 * i, "AUTOMOBILE") for i in range(12)] + [(3, "twice", 0, None, None), (None, "none", 7, 5.0, "BUILDING")],
    ),
    "documents": (
        "doc_id bigint, text string",
        [
            (0, None), (1, ""), (2, "short one"), (3, "x" * 40), (4, "x" * 39), (5, "a b c d e f " * 9000), (6, "  two  blanks  " + "y" * 50),
            (7, "one two th\nree fo\nur five six seven eight nine ten"), (8, "é ü ö " + "ß" * 90 + " end"), (9, "w" * 60 + " " + "v" * 60 + " u t s"),
            (3, "another text of the same key, long enough"), (None, "a text without a key that is long enough"), (10, " " * 45),
        ],
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date, o_orderpriority string",
        [],
    ),
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_linenumber bigint, l_quantity double, l_discount double, l_returnflag string, l_linestatus string",
        [(k, p, n, q, d, f, s) for k in (1, 2, 3, 9, None) for p in (0, 1) for n, q, d, f, s in ((1, 41.0, 0.0, "R", "F"), (2, 36.0, 0.1, "R", "O"), (2, 1.0, 0.0, None, "O"), (None, 2.0, None, "N", None))],
    ),
    "events": ("event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string", [(1, None, 0, "click", 9.0, "{k: 5}"), (2, None, 0, "view", 90.0, "{k: 7}")]),
}


@pytest.fixture
def views(spark, tmp_path):
    for name, (schema, rows) in ROWS.items():
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    orders = "o_orderkey AS o_orderkey, o_orderkey * 4 AS o_custkey, 'F' AS o_orderstatus, 9e4D AS o_totalprice, DATE '2001-02-03' AS o_orderdate, '1-URGENT' AS o_orderpriority"
    spark.sql(f"SELECT {orders} FROM VALUES (1L), (2L), (2L), (4L), (NULL) t(o_orderkey)").write.mode("overwrite").parquet(str(tmp_path / "orders.parquet"))
    return Views(spark, str(tmp_path))


def plain(views, name):
    """The view over whole base tables."""
    return views.spark.sql(VIEWS[name], **{n: plain(views, n) if n in VIEWS else views._base(n) for n in _needs(VIEWS[name])})


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["institutions", "judgements", "inspections", "findings"])
def test_views_hold_the_rows_of_whole_tables(views, name):
    rows = bag(getattr(views, name))
    assert rows and rows == bag(plain(views, name))


def test_names_travel_without_the_text(views):
    read = READS["institutions", "documents"](views._base("documents"))
    longest = {r.doc_id: len(r.text) for r in read.where("text IS NOT NULL").collect()}
    assert longest[5] == 40 and longest[9] == 125


NAN = float("nan")


def test_odd_lines_travel_as_what_the_views_ask_of_them(spark, views, tmp_path):
    schema, _ = ROWS["lineitem"]
    odd = [(0, 40.0, 0.0), (-1, 40.5, -0.0), (-2, 35.0, -0.5), (-3, 35.5, NAN), (None, NAN, 0.3), (7, None, None), (10**12 + 1, -1.0, 1e-300), (4, float("inf"), -float("inf"))]
    lines = [(k, p, n % 9, q, d, f, s) for k in (1, 2) for n, (p, q, d) in enumerate(odd) for f in ("R", "N", None) for s in ("F", "O", None)]
    spark.createDataFrame(lines, schema).write.mode("overwrite").parquet(str(tmp_path / "lineitem.parquet"))
    for name in ("judgements", "inspections", "findings"):
        rows = bag(getattr(views, name))
        assert rows and rows == bag(plain(views, name))
    read = READS["judgements", "lineitem"](views._base("lineitem"))
    assert {r.l_partkey for r in read.collect()} <= {-1, 0, 1, None} and {r.l_quantity for r in read.collect()} == {0.0, 36.0, 41.0}
    assert {str(r.l_discount) for r in READS["findings", "lineitem"](views._base("lineitem")).collect()} <= {"1.0", "0.0", "-0.0", "-1.0", "nan", "None"}


@pytest.mark.parametrize("name, exchanges", [("judgements", 1), ("findings", 2)])
def test_lines_are_dealt_out_once(views, name, exchanges):
    made = views.spark.sql(VIEWS[name], **{n: views._input(name, n) for n in _needs(VIEWS[name])})
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= exchanges


def test_reports_make_only_the_tables_they_read(views):
    assert profiles.news_by_type(tables(views, False)).collect()
    assert "institutions" in views._made and not {"inspections", "findings", "matches"} & set(views._made)


def test_lower_changes_a_to_z_only_and_fast():
    table = str.maketrans(ascii_uppercase, ascii_lowercase)
    for text in ("", "AbZ[@`{", "ÀÉßİK Ω Q", "\ud800X\U0001f600Y"):
        assert lower(text) == text.translate(table)
    text, took = "Çà et LÀ, où " * 50_000, []
    for f in (lower, lambda t: t.translate(table)):
        start = time.perf_counter()
        f(text)
        took.append(time.perf_counter() - start)
    assert took[0] * 2 < took[1]
