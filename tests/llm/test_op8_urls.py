import random

import pytest

from tierline.llm import url_digests as u
from tierline.llm.queries import URL_RULES

URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.org/es/1?q#f", "https://a.b.example.org/en/12", "http://example.org/en/2",
    "http://notexample.org/es/", "http://example.org.com/de/x", "http://a.com/fr/", "http://a.com/de", "http://org", "http://org/",
    "x://y://z.com/fr/?", "http://a.com/fr/" + "p" * 100_000, "http://a.com?/fr/", "http://example.org/es/", "http://example.org/es/",
    "http://EXÄMPLE.com/de/ü", "http://..com/de/", "http://u:p@h.org:80/a",
]


def plain(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host, rest = "".join(c.lower() if c.isascii() else c for c in rest[:cut]), rest[cut:]
        path = rest[: min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))]
    fits = [(h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "allow"))
    return host, path, rule, verdict


@pytest.mark.parametrize("by_join", [False, True])
def test_against_plain_rules(spark, by_join, monkeypatch):
    if by_join:
        monkeypatch.setattr(u, "ARRAY_BYTES", 0)
    pages = spark.createDataFrame([(i, x, "h", "r") for i, x in enumerate(URLS)], "page_id long, url string, html string, rule string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in u.judge(pages, rules).collect()}
    assert got == {i: plain(x) for i, x in enumerate(URLS)}
    assert u.judge(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in u.judge(pages, rules.limit(0)).collect()} == {"allow"}


def test_equal_digests_do_not_decide():
    array = u.DigestArray(["a/", "b/", "c/"], ["block"] * 3, hasher=lambda k: 7)
    assert [k and array.keys[k] if k >= 0 else None for k in array.find(["b/", "d/", "c/"])] == ["b/", None, "c/"]


def test_large_array_finds_all_and_only_its_keys():
    keys = [f"h{i}.org/p{random.random()}" for i in range(5000)]
    array = u.DigestArray(keys, ["block"] * len(keys))
    assert [array.keys[i] for i in array.find(keys)] == keys
    assert (array.find([k + "x" for k in keys]) == -1).all()
