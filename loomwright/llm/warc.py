"""WARC records and the resolution of not-modified revisits.

A revisit of profile server-not-modified has no payload: it says that an earlier full response still holds. resolve()
joins each revisit as of its time to the latest earlier full response of the same canonical URL, checks that their
validators agree, and merges the headers that a 304 may renew into those of the response.

The as-of join is two-level. Records are dealt by ranges of (URL, time), so that a URL with a third of all records is
spread over many ranges; a running window finds the latest response within a range, and one row for each URL and range
carries what came before.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.session import materialise

#: Header fields of a 304 that renew those of the stored response.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")
#: Plain bytes that are taken from a compressed file at once.
PIECE = 1 << 20
#: Query parameters that don't select content.
TRACKING = "^(utm_[^=]*|ref|fbclid|gclid)(=|$)"
URL = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?"

HEADERS = "array<struct<name:string,value:string>>"
RECORDS = f"record_id long, url string, ts long, kind string, headers {HEADERS}"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www., user and default port; path without last slash; sorted query without tracking; no scheme, no fragment.

    What is no absolute URL is only trimmed and cut at its fragment; null stays null.
    """
    text = F.regexp_replace(F.trim(url), "(?s)#.*$", "")
    part = lambda k: F.regexp_extract(text, URL, k)
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(part(2)), "^.*@", ""), "^www[.]", ""), ":(80|443)?$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.substring(part(4), 2, 1 << 30), "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    made = F.concat(host, F.regexp_replace(part(3), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(text.rlike(URL), made).otherwise(text)


def header(headers: Column, name: str) -> Column:
    """The first value of a header field, null without."""
    return F.try_element_at(F.filter(headers, lambda h: F.lower(h["name"]) == name), F.lit(1))["value"]


def _weak(etag: Column) -> Column:
    return F.regexp_replace(F.trim(etag), "^W/", "")


def merge_headers(response: Column, revisit: Column) -> Column:
    """The response's header fields, those that a 304 may renew replaced by the revisit's."""
    new = F.filter(revisit, lambda h: F.lower(h["name"]).isin(*PERMITTED))
    names = F.transform(new, lambda h: F.lower(h["name"]))
    return F.concat(F.filter(response, lambda h: ~F.coalesce(F.array_contains(names, F.lower(h["name"])), F.lit(False))), new)


def resolve(records: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row for each revisit of records(RECORDS; kind response or revisit).

    revisit_id, canonical_url, response_id, status, headers. status: `resolved` (a validator agrees: ETags by weak
    comparison if both have one, else Last-Modified), `mismatch` (it disagrees), `unverified` (no common validator), `none`
    (no earlier full response, or no URL; response_id is null and headers are the revisit's own). At one time a response
    of smaller record_id comes first, and only a strictly earlier time counts as earlier. Other kinds are left out; null
    times can't be placed and count as `none`. Records that repeat are resolved as often as they come.
    """
    spark = records.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    empty = F.array().cast(HEADERS)
    slim = records.filter(F.col("kind").isin("response", "revisit")).select("record_id", canonical_url(F.col("url")).alias("canonical_url"), "ts", "kind", F.coalesce("headers", empty).alias("headers"))
    placed = materialise(slim.repartitionByRange(n, "canonical_url", "ts", F.col("kind").desc(), "record_id").withColumn("part", F.spark_partition_id()), "records")
    full = placed.filter("kind = 'response' and canonical_url is not null and ts is not null")
    value = F.struct("ts", "record_id", "headers")
    last = full.groupBy("canonical_url", "part").agg(F.max(F.struct("ts", "record_id")).alias("k"), F.max_by(value, F.struct("ts", "record_id")).alias("last"))
    # every range of a URL needs what came before it, also ranges that hold no response
    ranges_of = placed.filter("canonical_url is not null").select("canonical_url", "part").distinct().join(last.select("canonical_url", "part", "last"), ["canonical_url", "part"], "left")
    before = Window.partitionBy("canonical_url").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ranges_of.select("canonical_url", "part", F.last("last", ignorenulls=True).over(before).alias("carried"))
    # revisits stand before responses of their own time, for these aren't earlier
    running = Window.partitionBy("canonical_url", "part").orderBy("ts", F.col("kind").desc(), "record_id").rowsBetween(Window.unboundedPreceding, -1)
    seen = placed.filter("canonical_url is not null and ts is not null").withColumn("near", F.last(F.when(F.col("kind") == "response", value), ignorenulls=True).over(running)).filter("kind = 'revisit'")
    timed = seen.join(carried, ["canonical_url", "part"], "left").withColumn("r", F.coalesce("near", "carried")).select("record_id", "canonical_url", "headers", "r")
    lost = placed.filter("kind = 'revisit' and (canonical_url is null or ts is null)").select("record_id", "canonical_url", "headers", F.lit(None).cast(timed.schema["r"].dataType).alias("r"))
    both = timed.union(lost)
    tag, held = _weak(header(F.col("headers"), "etag")), _weak(header(F.col("r.headers"), "etag"))
    since, stored = header(F.col("headers"), "last-modified"), header(F.col("r.headers"), "last-modified")
    agrees = F.when(tag.isNotNull() & held.isNotNull(), tag == held).when(since.isNotNull() & stored.isNotNull(), since == stored)
    status = F.when(F.col("r").isNull(), "none").when(agrees, "resolved").when(~agrees, "mismatch").otherwise("unverified")
    found = both.withColumn("status", status)
    merged = F.when(F.col("status").isin("resolved", "unverified"), merge_headers(F.col("r.headers"), F.col("headers"))).otherwise(F.col("headers"))
    return found.select(F.col("record_id").alias("revisit_id"), "canonical_url", F.col("r.record_id").alias("response_id"), "status", merged.alias("headers"))


def _plain(content: bytes) -> Iterator[bytes]:
    """Pieces of the plain bytes of a file, plain or one gzip member for each record; what follows a broken member is left out."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    try:
        while content[:2] == b"\x1f\x8b":
            tool = zlib.decompressobj(31)
            while content and not tool.eof:
                piece = tool.decompress(content, PIECE)
                content = tool.unconsumed_tail
                if not piece and not content:
                    break
                yield piece
            content = tool.unused_data if tool.eof else b""
    except zlib.error:
        yield b"\r\nbroken member"


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a WARC file, plain or one gzip member for each record.

    ({}, b"") stands for a stretch that is no whole record: a torn or malformed one, or one without a length. Reading goes on at
    the next line that begins with WARC/. Only one record and one piece of the file are held in plain form.
    """
    held, more = bytearray(), _plain(content)

    def fill(n: int) -> bool:
        while len(held) < n:
            if (piece := next(more, None)) is None:
                return False
            held.extend(piece)
        return True

    def find(mark: bytes, at: int) -> int:
        while (found := held.find(mark, at)) < 0 and fill(len(held) + 1):
            at = max(at, len(held) - PIECE - len(mark))
        return found

    while fill(1):
        if held[:1] in (b"\r", b"\n"):
            del held[: len(held) - len(held.lstrip(b"\r\n"))]
            continue
        end = find(b"\r\n\r\n", 0) if fill(5) and held.startswith(b"WARC/") else -1
        if end >= 0:
            lines = held[:end].decode("utf-8", "replace").split("\r\n")
            fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
            size = fields.get("content-length", "")
            if size.isascii() and size.isdigit() and fill(end + 4 + int(size)):
                yield fields, bytes(held[end + 4 : end + 4 + int(size)])
                del held[: end + 4 + int(size)]
                continue
        yield {}, b""
        if (at := find(b"\nWARC/", 1)) < 0:
            return
        del held[: at + 1]


def read(files: DataFrame) -> DataFrame:
    """RECORDS, and target_id and payload, from Spark's binaryFile source (path, content); a record's number is a hash of its WARC-Record-ID.

    HTTP header fields come from the block; revisits of profile server-not-modified and responses keep their kind, other types are left out.
    A stretch that is no whole record is a row of kind `malformed` without anything else, so that it can be counted; resolve() leaves it out. A file
    must fit into a cell, 2 GB at most; larger ones have to be cut between records before.
    """
    schema = pa.schema([("target_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("kind", pa.string()), ("headers", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("payload", pa.binary())])

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                rows = []
                for fields, block in parse(content or b""):
                    kind = fields.get("warc-type")
                    if not fields:
                        rows.append({"kind": "malformed"})
                    if kind == "response" or kind == "revisit" and "not-modified" in fields.get("warc-profile", "not-modified"):
                        head, _, body = block.partition(b"\r\n\r\n")
                        lines = [x.partition(":") for x in head.decode("latin-1").split("\r\n")[1:]]
                        rows.append({"target_id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"), "date": fields.get("warc-date"), "kind": kind, "headers": [{"name": k.strip(), "value": v.strip()} for k, c, v in lines if c], "payload": body})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    made = files.select("content").mapInArrow(records, f"target_id string, url string, date string, kind string, headers {HEADERS}, payload binary")
    return made.select(F.xxhash64("target_id").alias("record_id"), "url", F.unix_timestamp(F.to_timestamp("date")).alias("ts"), "kind", "headers", "target_id", "payload")
