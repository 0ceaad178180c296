import gzip
import hashlib

import pytest

from tierline.llm import warc as w
from tierline.llm.common import scratch_dir

LONG = "<p>" + "é" * 60


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", None) for i, u, h in rows], "page_id long, url string, html string, record_type string, refers_to long")


def plain(rows):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == data and j is not None]
        first = min(same) if len(data) >= 100 and same else i
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), first))
    return out


ROWS = [
    (7, "http://a/", LONG), (3, None, LONG), (9, "http://b c/\n", LONG), (4, "", "short"), (5, "http://e/", "short"), (6, "http://f/", None),
    (8, "http://g/", ""), (-2, "http://h/", "WARC/1.0\r\n\r\n" * 40), (2**62, "http://i/", "\r\n\r\nURL 1 2 3 4\n" * 30 + "\0"),
    (11, "http://j/", "z" * 300_000), (12, "http://k/", "z" * 300_000), (13, "http://ü/", "y" * 99), (14, "http://ü/", "y" * 99), (15, "u", "y" * 100), (16, "u", "y" * 100),
]


@pytest.mark.parametrize("archive_bytes", [1, 1 << 20])
def test_round_trip(spark, archive_bytes):
    arc, out = scratch_dir(spark, "arc"), scratch_dir(spark, "warc")
    w.write_arc(pages(spark, ROWS), arc, archive_bytes)
    w.convert(spark, arc, out)
    got = {r.page_id: r for r in w.read_warc(spark, out).collect()}
    assert len(got) == len(ROWS)
    for i, n, digest, first in plain(ROWS):
        r = got[i]
        kind, to = ("response", None) if first == i else ("revisit", first)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (n, digest, kind, to)
    versions = {x.version for f in w.read_archives(spark, arc).collect() for x in w.arc_records(bytes(f.content))}
    assert versions == ({b"1", b"2"} if archive_bytes == 1 else {b"1"})


def test_null_ids_and_repeated_rows(spark):
    rows = [(None, "u", LONG), (5, "u", LONG), (5, "u", LONG), (None, "v", "q" * 200), (None, "v", "q" * 200)]
    got = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in w.round_trip(pages(spark, rows)).collect())
    assert got == sorted([("None", "revisit", "5"), ("5", "response", "None"), ("5", "revisit", "5"), ("None", "response", "None"), ("None", "revisit", "None")])


def test_empty_table(spark):
    assert w.round_trip(pages(spark, [])).count() == 0


def test_files_are_whole_gzip_files_of_warc_records(spark):
    arc, out = scratch_dir(spark, "arc"), scratch_dir(spark, "warc")
    w.write_arc(pages(spark, ROWS), arc)
    w.convert(spark, arc, out)
    ids, kinds = [], []
    for f in w.read_archives(spark, out).collect():
        for headers, block in w.warc_records(gzip.decompress(bytes(f.content))):
            ids.append(headers["WARC-Record-ID"])
            kinds.append(headers["WARC-Type"])
            assert headers["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest()
            assert headers["WARC-Date"] == "2001-01-01T00:00:00Z"
    assert len(set(ids)) == len(ids) and "warcinfo" in kinds and "revisit" in kinds


def test_plain_arc_of_both_versions():
    body = b"HTTP/1.0 200 OK\r\n\r\nhello"
    for version, more in ((b"1", b""), (b"2", b" 200 - - 0 f.arc")):
        head = version + b" 0 o\n" + w.FIELDS[version] + b"\n"
        data = b"filedesc://f.arc 0.0.0.0 19970101 text/plain" + more + b" %d\n" % len(head) + head + b"\n"
        data += b"http://x/ 1.2.3.4 19970203040506 text/html" + more + b" %d\n" % len(body) + body + b"\n"
        first, doc = w.arc_records(data)
        assert (doc.version, doc.url, doc.ip, doc.http()[1], w.timestamp(doc.date)) == (version, b"http://x/", b"1.2.3.4", b"hello", "1997-02-03T04:05:06Z")
        with pytest.raises(ValueError):
            list(w.arc_records(data[:-4]))
        with pytest.raises(ValueError):
            list(w.arc_records(data.replace(b"1.2.3.4 ", b"")))
    with pytest.raises(ValueError):
        list(w.arc_records(b"filedesc://f 0 0 t 4\n9 0 \n"))


@pytest.mark.parametrize("page", [None, 0, 1, -1, 2**63 - 1, -(2**63)])
def test_identifiers_hold_the_page(page):
    one, two = w.record_id(page, b"a"), w.record_id(page, b"b")
    assert one != two and w.page_of(one) == page and one[24] == "8"
