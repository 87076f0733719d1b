"""ARC and WARC round trips."""

import base64
import gzip
import hashlib

import pytest

from veldrin.llm import warc


def back(spark, pages, least=0):
    arcs = warc.write_arcs(spark.createDataFrame(pages, "page_id long, url string, html string, key string").repartition(2))
    return arcs, warc.resolved(warc.scan_warcs(warc.convert(arcs, least)))


def test_pages_round_trip(spark):
    pages = [(i, f"http://x.example/{i} a", ["<p>é</p>", "", None, "unique %d" % i, "a\r\n\r\nWARC/1.1\r\nb" * (i % 3)][i % 5], "k") for i in range(60)]
    got = {int(r.key): r for r in back(spark, pages)[1].collect()}
    assert len(got) == len(pages)
    largest = {}
    for i, _, h, _ in pages:
        largest[h or ""] = i
    for i, _, h, _ in pages:
        raw, r = (h or "").encode(), got[i]
        assert r.payload_bytes == len(raw) and r.payload_digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
        first = largest[h or ""]
        assert (r.record_type, r.refers_to) == (("response", None) if first == i else ("revisit", str(first)))


def test_least_revisit_nulls_and_repeats(spark):
    pages = [(1, "u", "aa", ""), (2, "u", "aa", ""), (3, "u", "long enough", ""), (4, None, "long enough", ""), (None, "u", "long enough", ""), (4, "u", "long enough", "")]
    rows = back(spark, pages, 5)[1].collect()
    assert sorted((r.key, r.record_type) for r in rows) == [("-", "response"), ("1", "response"), ("2", "response"), ("3", "revisit"), ("4", "response"), ("4", "revisit")]
    assert back(spark, [])[1].count() == 0


def test_both_versions_are_read(spark):
    for version in (1, 2):
        body = b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nline\n\nhttp://not.a.header 1 2 3 4\n"
        records = [warc.ArcRecord("http://a/ b", "1.2.3.4", "20010203040506", "text/html", body), warc.ArcRecord("http://c/", "0.0.0.0", "2001", "text/plain", b"")]
        parts = [warc.arc_header(version, "f.arc")] + [warc.arc_record(r, version, "f.arc", 0) for r in records]
        for raw in (b"".join(parts), b"".join(gzip.compress(p) for p in parts), gzip.compress(b"".join(parts))):
            read = list(warc.read_arc(raw))
            assert [(r.url, r.ip, r.date, r.mime, r.body) for r in read] == [(r.url, r.ip, r.date, r.mime, r.body) for r in records]
        with pytest.raises(ValueError):
            list(warc.read_arc(b"".join(parts)[:-20]))
    with pytest.raises(ValueError):
        list(warc.read_arc(b"filedesc://x 0 1 t 9\n3 0 none\n\n"))
    with pytest.raises(ValueError):
        list(warc.read_arc(warc.arc_header(1, "x") + b"only three fields\n"))
    assert warc.iso_date("2001") == "2001-01-01T00:00:00Z" and warc.iso_date("20010203040506") == "2001-02-03T04:05:06Z"


def test_non_http_records_become_resources():
    raw = gzip.compress(warc.warc_record("resource", warc.record_id("a", 1), "2001-01-01T00:00:00Z", b"\x00\xff", "image/png", {"WARC-Target-URI": "http://a/"}))
    fields, block = next(warc.read_warc(raw))
    assert block == b"\x00\xff" and fields["warc-type"] == "resource" and fields["content-length"] == "2"
