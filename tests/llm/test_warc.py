"""Revisit resolution against a plain loop, URLs and WARC files."""

import gzip

import pytest

from pyspark.sql import functions as F

from loomwright.llm import queries, warc

H = lambda **kv: [{"name": k.replace("_", "-"), "value": v} for k, v in kv.items()]


@pytest.mark.parametrize("url,want", [
    ("HTTP://User@WWW.Example.com:80/a/b/?b=2&utm_source=x&a=1#top", "example.com/a/b?a=1&b=2"),
    ("https://example.com", "example.com"), ("https://example.com/?ref=x", "example.com"), ("example.com/x#y", "example.com/x"), ("", ""), (None, None),
])
def test_canonical_url(spark, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(warc.canonical_url(df.u)).first()[0] == want


def test_resolution_is_that_of_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(600):
        url = "http://hot.example/" if rng.random() < 0.4 else f"http://x.example/{rng.randrange(30)}"
        kind = "response" if rng.random() < 0.4 else "revisit"
        rows.append((i, rng.choice([url, url.replace("http", "https") + "#f"]), rng.randrange(200), kind, H(ETag=f'"{rng.randrange(3)}"') + H(Date=str(i), Server="s", Content_Length="5") if rng.random() < 0.9 else None))
    rows += [(1000, None, 5, "revisit", H(ETag='"1"')), (1001, "http://hot.example/", None, "revisit", []), (1002, "http://hot.example/", 3, "metadata", [])]
    found = {r.revisit_id: r for r in warc.resolve(spark.createDataFrame(rows, warc.RECORDS), ranges=7).collect()}
    assert len(found) == sum(r[3] == "revisit" for r in rows)
    canon = lambda u: u and u.split("#")[0].split("://")[1].rstrip("/")
    tag = lambda h: next((x["value"] for x in h or [] if x["name"] == "ETag"), None)
    for i, url, ts, kind, heads in rows:
        if kind != "revisit":
            continue
        before = [r for r in rows if r[3] == "response" and url and ts is not None and canon(r[1]) == canon(url) and r[2] < ts]
        last = max(before, key=lambda r: (r[2], r[0]), default=None)
        status = "none" if last is None else "unverified" if not (tag(heads) and tag(last[4])) else "resolved" if tag(heads) == tag(last[4]) else "mismatch"
        assert (found[i].status, found[i].response_id) == (status, last and last[0]), i
        got = [(h["name"], h["value"]) for h in found[i].headers]
        if status == "resolved":
            assert set(got) == {("Server", "s"), ("Content-Length", "5"), ("ETag", tag(heads)), ("Date", str(i))}


def test_no_records(spark):
    assert warc.resolve(spark.createDataFrame([], warc.RECORDS)).count() == 0


def test_headers_that_a_304_may_not_renew_stay(spark):
    rows = [(1, "http://a/", 1, "response", H(ETag='W/"x"', Content_Length="9", Set_Cookie="a")), (2, "http://a", 2, "revisit", H(etag='"x"', Content_Length="0", Expires="z"))]
    r = warc.resolve(spark.createDataFrame(rows, warc.RECORDS)).first()
    assert r.status == "resolved" and sorted((h["name"], h["value"]) for h in r.headers) == [("Content-Length", "9"), ("Expires", "z"), ("Set-Cookie", "a"), ("etag", '"x"')]


def record(kind, uri, date, block, **more):
    head = f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:{uri}:{date}>\r\nWARC-Target-URI: {uri}\r\nWARC-Date: {date}\r\n" + "".join(f"{k.replace('_', '-')}: {v}\r\n" for k, v in more.items())
    return (head + f"Content-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"


@pytest.mark.parametrize("packed", [False, True])
def test_files(spark, tmp_path, packed):
    parts = [
        record("response", "http://a/", "2024-01-01T00:00:00Z", b"HTTP/1.1 200 OK\r\nETag: \"1\"\r\n\r\nbody\r\n\r\nmore"),
        record("request", "http://a/", "2024-01-01T00:00:01Z", b"GET / HTTP/1.1\r\n\r\n"),
        record("revisit", "http://a/", "2024-01-02T00:00:00Z", b"HTTP/1.1 304 Not Modified\r\nETag: \"1\"\r\n\r\n", WARC_Profile="http://netpreserve.org/warc/1.1/revisit/server-not-modified"),
    ]
    (tmp_path / "x.warc").write_bytes(b"".join(gzip.compress(p) for p in parts) if packed else b"".join(parts) + b"WARC/1.1\r\ntorn")
    rows = warc.read(spark.read.format("binaryFile").load(str(tmp_path)))
    found = rows.collect()
    assert sorted((r.kind, bytes(r.payload)) for r in found if r.kind != "malformed") == [("response", b"body\r\n\r\nmore"), ("revisit", b"")]
    assert sum(r.kind == "malformed" for r in found) == (0 if packed else 1)
    assert warc.resolve(rows).first().status == "resolved"


def test_query_over_pages_has_every_visit(spark):
    found = queries.op9_revisits(spark, "/root/testdata/sf0.001")
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/pages.parquet").count()


def test_malformed_records_are_counted_and_reading_goes_on():
    good = lambda i, body: f"WARC/1.1\r\nWARC-Record-ID: <{i}>\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"
    bad = [b"WARC/1.1\r\nContent-Length: many\r\n\r\nxx\r\n\r\n", b"WARC/1.1\r\nno length\r\n\r\n", b"nonsense\r\n\r\n"]
    plain = good(1, b"a\r\n\r\nb") + bad[0] + good(2, b"") + bad[1] + bad[2] + good(3, b"x" * 3_000_000) + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ntorn"
    want = ["<1>", None, "<2>", None, "<3>", None]
    found = list(warc.parse(plain))
    assert [f.get("warc-record-id") for f, _ in found] == want and found[0][1] == b"a\r\n\r\nb" and len(found[4][1]) == 3_000_000
    members = gzip.compress(good(1, b"a")) + gzip.compress(good(2, b"y" * 5_000_000))
    assert [len(b) for _, b in warc.parse(members)] == [1, 5_000_000]
    assert [f.get("warc-record-id") for f, _ in warc.parse(members[:-2000])] == ["<1>", None]
    assert list(warc.parse(b"")) == [] and list(warc.parse(b"\r\n\r\n")) == []


def test_repeated_records_and_clashing_columns(spark):
    rows = [(1, "http://h.org/a", 10, "response", [("ETag", "x")], "s"), (1, "http://h.org/a", 10, "response", [("ETag", "x")], "s"), (2, "http://h.org/a", 20, "revisit", [("ETag", "x")], "s"), (2, "http://h.org/a", 20, "revisit", [("ETag", "x")], "s"), (None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, f"record_id long, url string, ts long, kind string, headers {warc.HEADERS}, status string").withColumns({"canonical_url": F.lit("clash"), "part": F.lit(7), "r": F.lit(1), "near": F.lit(2)})
    assert [(r.revisit_id, r.response_id, r.status) for r in warc.resolve(df).collect()] == [(2, 1, "resolved")] * 2
