"""SimHash fingerprints and near-duplicate groups by multi-index hashing.

Fingerprints: texts are lower-cased (A-Z), split at ASCII white space, and every run of `shingle` words, repeats
included, votes with its XXH64 (seed 42) on 64 bits.

Links: two fingerprints link at `radius` = 2 or fewer differing bits. The 64 bits are cut into two segments of 32.
If two fingerprints differ in at most 2 bits, either the first segments differ in at most 1 bit or the second ones are
equal. So each distinct fingerprint enumerates the ball of radius 1 in the first segment (33 keys) and radius 0 in the
second (1 key), fetches the fingerprints filed under these keys, and complete distances decide.

Hot keys: a segment value that over `bucket_cap` distinct fingerprints share would make that bucket quadratic. All
fingerprints that touch such a bucket go another exact way: each enumerates its full ball of radius 1 over all 64 bits
(65 centres). Two fingerprints are within 2 bits exactly if they share a centre, and a centre has at most 65
fingerprints, so no group can grow with the data and nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.graph import connected_components
from loomwright.session import materialise

SHINGLE = 3
BUCKET_CAP = 512
#: Hot keys up to this many are broadcast (16 bytes each), more are joined by a shuffle.
BROADCAST_KEYS = 500_000
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def majority(found: np.ndarray) -> bytes:
    """The 8 bytes that most of the hashes vote for; a hash is a row of 8 bytes, most significant first."""
    votes = np.concatenate([np.bincount(found[:, j], minlength=256) @ _BITS for j in range(8)])
    return np.packbits(votes * 2 > len(found)).tobytes()


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> bytes:
    """The 8 bytes, most significant first. No words: zero. Fewer words than a shingle: the whole sequence is one."""
    words = text.lower().split() if text else []
    if not words:
        return bytes(8)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        return digest(b" ".join(words), 42)
    joined = b" ".join(words)
    lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: 1 - shingle].tolist()
    return majority(np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist())]), dtype=np.uint8).reshape(-1, 8))


def _longs(texts: pa.Array) -> pa.Array:
    parts = (texts.slice(at, 512).cast(pa.binary()).to_pylist() for at in range(0, len(texts), 512))
    made = b"".join(fingerprint(x) for part in parts for x in part)
    return pa.array(np.frombuffer(made, dtype=">i8").astype(np.int64), pa.int64())


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), _longs(batch.column(1))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long) for each row of docs, whole texts; null and empty texts have fingerprint zero."""
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return two.mapInArrow(_fingerprints, "doc_id long, fp long")


def links(fps: DataFrame, bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """Edges (a, b) over the distinct values of fps(fp) whose components are those of all links at 2 bits or fewer."""
    high, low = F.shiftrightunsigned("fp", 32), F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))
    cell = lambda seg, key: F.struct(F.lit(seg).alias("seg"), key.alias("key"))
    table = fps.select("fp", F.inline(F.array(cell(0, high), cell(1, low))))
    hot = materialise(table.groupBy("seg", "key").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_cap).select("seg", "key"), "hot-keys", small=True)
    n_hot = hot.count()
    ball = [cell(0, high.bitwiseXOR(F.lit(m))) for m in (0, *(1 << i for i in range(32)))]
    probes = fps.select("fp", F.inline(F.array(*ball, cell(1, low))))
    if n_hot:
        known = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        table = table.join(known, ["seg", "key"], "left_anti")
    left, right = probes.withColumnRenamed("fp", "a"), table.withColumnRenamed("fp", "b")
    found = left.join(right, ["seg", "key"]).filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    if n_hot:
        near = probes.join(known, ["seg", "key"], "left_semi").select("fp").distinct()
        centres = near.select("fp", F.explode(F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(1 << i if i < 63 else -(1 << 63))) for i in range(64)))).alias("c"))
        stars = centres.groupBy("c").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("all")).filter(F.size("all") > 1)
        found = found.union(stars.select("a", F.explode("all").alias("b")).filter("a <> b"))
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """One row for each row of docs: doc_id, fp, fingerprint (16 hex digits), component_id, group_fp (a name of the group), kept.

    component_id is the smallest doc_id reachable over links, its own included; kept: doc_id = component_id. Rows that
    repeat a doc_id are returned as often as they come; a null doc_id stays null, has a component through its
    fingerprint (null if no row of the component has an id), and is never kept. Other columns of docs are ignored.
    """
    own = materialise(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    return labelled(own, fps, links(fps.select("fp"), bucket_cap))


def labelled(own: DataFrame, fps: DataFrame, edges: DataFrame) -> DataFrame:
    """The rows that near_duplicates() returns, for own(doc_id, fp), fps(fp, first_id) and edges(a, b) over fp."""
    comps = connected_components(edges)
    named = fps.join(comps, fps.fp == comps.node, "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of_fp = named.join(least, "component").select("fp", "component_id", F.col("component").alias("group_fp"))
    return own.join(of_fp, "fp").select(
        "doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "group_fp",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"),
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", grouped: Callable[..., DataFrame] = near_duplicates, tags: Callable[[pa.Array], pa.Array] = _longs) -> DataFrame:
    """The rows of docs, with its columns: of each group of near-duplicates one, that with the smallest id.

    grouped and tags: another rule for near-duplicates, and the fp of each of its texts.

    Rows that repeat id and text are one document; rows with one id and other texts stay if one of them is kept. Rows
    without an id stand behind all that have one: one of a group stays if no row of the group has an id.
    """
    columns = docs.columns
    groups = materialise(grouped(docs, id_col, text_col), "groups")
    by_id = groups.filter("doc_id is not null").groupBy(F.col("doc_id").alias(id_col)).agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n"))
    stay = docs.filter(F.col(id_col).isNotNull()).join(by_id.filter("not kept").select(id_col), id_col, "left_anti")
    again = by_id.filter("kept and n > 1").select(id_col)
    if not again.isEmpty():
        stay = stay.join(again, id_col, "left_anti").select(columns).union(stay.join(again, id_col, "left_semi").dropDuplicates([id_col, text_col]).select(columns))

    @F.arrow_udf("long")
    def tag(texts: pa.Array) -> pa.Array:
        return tags(texts)

    nameless = docs.filter(F.col(id_col).isNull()).select(F.struct("*").alias("row"), tag(F.col(text_col).cast("string")).alias("fp"))
    free = groups.filter("component_id is null").select("fp", "group_fp").distinct()
    return stay.select(columns).union(nameless.join(free, "fp").dropDuplicates(["group_fp"]).select("row.*"))
