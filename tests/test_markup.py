"""HTML readers on loose markup, against results written by hand."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tierline.functions import links, markup
from tierline.functions.contacts import contact_fields
from tierline.sources import pages as pg

LINKS = [
    ("<a href=/x class=y>one</a>", [("/x", "one")]),
    ("<A CLASS='a>b' HREF = '/x'>a<b>&amp;</b>b\n c</A>", [("/x", "a&b c")]),
    ('<!-- <a href="/no">no</a> --><a href="/yes">yes<!-- > --></a>', [("/yes", "yes")]),
    ("<script>'<a href=\"/no\">'</script ><style>a</style><a href=/y>y</a>", [("/y", "y")]),
    ("<p><a href=/1>one<p>two <a href=/2>three", [("/1", "one"), ("/2", "three")]),
    ("<b><a href=/1>one</b> two</a> three", [("/1", "one two")]),
    ("<ul><li><a href=/1>one<li><a href=/2>two</ul>rest", [("/1", "one"), ("/2", "two")]),
    ("<table><tr><td><a href=/1>one<td>two</a></table>", [("/1", "one")]),
    ('<a href="/x?a=1&amp;b=2&copy=3">&eacute;&nbsp;&#38;</a>', [("/x?a=1&b=2&copy=3", "é &")]),
    ("1 < 2 <a name=x>none</a></z><a/href=/q/>q</a>", [("/q/", "q")]),
    ('<a href="/x" href="/y">first</a><a href>empty</a>', [("/x", "first"), ("", "empty")]),
    ("<a href=/x>one</a><a href=/y", [("/x", "one")]),
    ('<a href=/x>one</a><a href="/y>two</a>', [("/x", "one"), ("", "two")]),
    ("<!-- cut <a href=/x>one</a>", []),
    ("", []),
    ("<", []),
]


def test_links(spark):
    rows = [(i, html) for i, (html, _) in enumerate(LINKS)] + [(-1, None)]
    got = spark.createDataFrame(rows, "page_id int, html string")
    found = {r.page_id: [(a.href, a.text) for a in r.a or []] for r in got.select("page_id", links.anchors(F.col("html")).alias("a")).collect()}
    assert found == {i: want for i, (_, want) in enumerate(LINKS)} | {-1: []}
    assert pg.extract_links(got.where("html IS NULL OR html = ''")).count() == 0


def text_of(spark, html):
    df = spark.createDataFrame([(html,)], "html string")
    return df.select(pg.html_main_text(F.col("html")).alias("t")).first().t


def test_main_text(spark):
    long = "word " * 120
    assert text_of(spark, f"<body>x<main>{long}<div><main>in</main></div>out</main><main>two</main></body>") == f"{long}inouttwo"
    assert text_of(spark, f"<body>x<div class='a govuk-main-wrapper'>{long}<div>in</div></div>y") == f"{long}in"
    assert text_of(spark, f"<body><main></main><article>{long} &lt;b&gt; &eacute;</article></body>") == f"{long.strip()} <b> é"
    assert text_of(spark, f"{long}<script>no</script>") == long.strip()
    assert text_of(spark, "<main>short</main>") is None and text_of(spark, None) is None and text_of(spark, "") is None


def test_contacts(spark):
    html = """<dl><dt>Email<dd><p><a href=#>x</a><a href='MAILTO:a@b.org?subject=1'>mail</a><dt> Website </dt>
      <dd>see <a href=//site>site</a></dd><dt>Phone</dt><p></p><dd>not beside</dd><dt>Head</dt><dd>A <b>B</b></dd></dl>(level 3)"""
    r = spark.createDataFrame([(html,), (None,), ("",)], "html string").select(contact_fields(F.col("html")).alias("c")).collect()
    assert tuple(r[0].c) == ("a@b.org", None, "//site", "A B", 1)
    assert all(x is None for x in tuple(r[1].c)) and tuple(r[2].c)[:4] == (None,) * 4


def test_listing(spark):
    html = """<table><tr class=result id=school_1><td class="x name"><a href=/no>no</a><a href=/institutions/school/s1#t>One</a>
      <a href=/institutions/school/s2>Two</a><td class=location>Here<td class=location>There
      <tr class=result><td class=name><a href=/institutions/school/s3>no id</a><tr id=school_4><td class=name><a href=/institutions/school/s4>no result</a></table>"""
    got = pg.school_listing(spark.createDataFrame([(7, html), (8, None)], "page_id int, html string")).drop("position").collect()
    assert [tuple(r) for r in got] == [(7, "1", "s1", "One", "Here")]


def test_collection(spark):
    html = """<h2>Not it</h2><section><h2>Open</h2><a href="/government/publications/a">A in section</a><ul class=gem-c-document-list>
      <li><a href=government/publications/a>no</a><a href="/government/publications/a">A in list</a></ul></section>
      <section><a href=https://x.org/government/publications/b>B</a></section><h3>Later</h3><a href=/government/publications/c>C</a>"""
    got = pg.collection_links(spark.createDataFrame([(1, html)], "page_id int, html string"), "https://www.gov.uk/x/y").collect()
    want = {("https://www.gov.uk/government/publications/a", "A in list", "Notices"), ("https://x.org/government/publications/b", "B", "Notices")}
    assert {tuple(r)[1:] for r in got} == want


def test_one_pass_per_page(spark):
    df = spark.createDataFrame([("",)], "html string")
    for column in (contact_fields(F.col("html")), pg.html_main_text(F.col("html")), pg.best_report_link(F.col("html"))):
        plan = df.select(column.alias("c"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("ArrowEvalPython") == 1 and plan.split("ArrowEvalPython")[1].split("\n")[0].count("pages(") == 1


@pytest.mark.parametrize("piece", ["<div>", "<b>", "</b>", '<a b="', "<a b='x\"' ", "<li>", "<!--", "</x>", "<script>", "<title>", "<", "&", "<a href=x>", "<td><b></td></b>"])
def test_long_loose_pages_take_linear_time(piece):
    begin = time.time()
    list(markup.fold(piece * 50_000, frozenset({"a"}), frozenset()))
    assert time.time() - begin < 10


def test_any_soup_folds_into_nested_numbers():
    rng = random.Random(5)
    parts = ["<a href=x>", "</a>", "<b>", "</b>", "<div>", "</div>", "<p>", "<table>", "<tr>", "<td>", "</table>", "</td>", "t", "<li>", "<ul>", "</ul>", "<br>", "<!-- -->", "<", '"']
    for _ in range(500):
        page = "".join(rng.choices(parts, k=rng.randrange(40)))
        found = list(markup.fold(page, frozenset({"a", "b", "div", "p", "td", "li", "br", markup.PAGE}), frozenset({"div"})))
        whole = found[0]["text"]
        assert [e["at"] for e in found] == sorted(e["at"] for e in found)
        for e in found:
            assert e["last"] >= e["at"] and e["text"] in whole and (e["parent"] is None or e["parent"] < e["at"])


def test_collection_links_reads_pages_once_and_joins_nothing(spark):
    html = '<section><h2>Open</h2><ul class="gem-c-document-list"><li><a href=/government/publications/a>A</a></ul></section>'
    pages = spark.createDataFrame([(1, html), (None, html)], "page_id int, html string")
    out = pg.collection_links(pages, "https://www.gov.uk/x/y")
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("ArrowEvalPython") == 1 and "Join" not in text
    assert [tuple(r) for r in out.collect()] == [(1, "https://www.gov.uk/government/publications/a", "A", "Notices")]


def test_elements_are_handed_on_in_small_batches(monkeypatch):
    monkeypatch.setattr(markup, "HELD_ELEMENTS", 100)
    pages = pa.array(["<a href=/x>x</a>" * 30 if n % 5 else None for n in range(50)])
    got = list(markup.folded([pages, pages[:0], pages], frozenset(["a"]), frozenset()))
    assert sum(map(len, got)) == 100
    assert max(sum(len(v or ()) for v in b.to_pylist()) for b in got) <= 120
    assert [len(v) if v else 0 for b in got for v in b.to_pylist()] == [30 if n % 5 else 0 for n in range(50)] * 2
