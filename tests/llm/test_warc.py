import hashlib

import pytest

from barloom.llm import warc
from barloom.llm.common import scratch


def brute(rows):
    top = {}
    for p, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            top[b] = max(top.get(b, p), p)
    out = []
    for p, _, h in rows:
        b = (h or "").encode()
        to = top.get(b)
        out.append((p, len(b), hashlib.sha1(b).hexdigest(), "response" if to in (None, p) else "revisit", None if to == p else to))
    return sorted(out, key=str)


def test_round_trip(spark, sf):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    long = "<p>é🙂</p>" * 300
    rows += [(10**6, "http://x/a b%20\r\n", long), (10**6 + 1, None, long), (10**6 + 2, "u", None), (10**6 + 3, "u", ""), (10**6 + 4, "u", "P*M\x18\x00\x00\x00\x00\r\n\r\n"), (10**6 + 5, "u", "y" * 999), (10**6 + 6, "u", "y" * 999), (10**6 + 7, "u", long), (10**6 + 7, "u", long)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.contract(pages).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(rows)
    urls = dict((p, u) for p, u, _ in rows)
    assert all(r.url == urls[r.page_id] for r in got)


def test_payloads_come_back(spark):
    rows = [(i, f"http://h/{i}", f"<html>{i}</html>" * (1 + i % 7)) for i in range(60)] + [(None, "n", "z" * 2000), (None, "n", "z" * 2000), (99, "n", "z" * 2000)]
    path = scratch(spark, "warc-test")
    warc.write_archives(warc.revisits(spark.createDataFrame(rows, "page_id long, url string, html string")), path)
    got = warc.read_archives(spark, path).collect()
    assert {r.page_id: r.payload.decode() for r in got if r.record_type == "response"} == {p: h for p, _, h in rows if p is not None}
    assert [r.refers_to for r in got if r.page_id is None] == [99, 99]


def test_broken_records():
    good = warc.record_bytes(1, "u", b"abc", hashlib.sha1(b"abc").hexdigest(), None)
    assert warc.parse(good)[:3] == (1, "u", "response")
    for bad in (good.replace(b"abc", b"abd"), good[:-1], good.replace(b"WARC/1.1", b"WARD/1.1"), good.replace(b"WARC-Date", b"X")):
        with pytest.raises(warc.ArchiveError):
            warc.parse(bad)


def test_empty_table(spark):
    assert warc.contract(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
