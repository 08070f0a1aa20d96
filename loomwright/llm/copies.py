"""Near copies by the Jaccard similarity of 5-word shingles: candidates by SimHash and by MinHash bands, an exact check of each pair.

A text's shingles are the distinct runs of `SHINGLE` words (lower-cased A-Z, split at ASCII white space; fewer words are
one run), as XXH64 values. Two texts link if the Jaccard similarity of these sets is SIMILARITY or more. Equal sets are one
node, so exact copies link without any comparison.

SimHash first: each set has a fingerprint, for which its shingles vote, and simhash.links() finds by multi-index hashing which
fingerprints are near. Each set of a group of these is checked against the group's first one, and what is similar enough is linked.

Candidates beyond that ball (at the limit some 10 of 64 bits differ): BANDS bands of ROWS minima each, for pairs that aren't linked yet. A pair at the limit shares no band with chance (1 - 0.8^4)^27 = 7e-7, a closer
pair more rarely. Every candidate is checked on the whole sets, so no pair below the limit links.

Hot bands: members of a bucket with over `bucket_cap` sets are first compared with a few LEADERS of them only, those that are
in most hot buckets, in TURNS turns, each member in its largest bucket. Where that leaves a bucket in more than one component, every member outside the bucket's
largest component is compared with all members of other components, in blocks, and each pair in the first band that it shares:
minima estimate the similarity, and what may reach the limit (a pair at the limit falls short by more than SIGMAS deviations with
chance 3e-6) is checked on the whole sets, unless its components are linked by then. Pairs within one component can't change it. A
block sends the edges of a forest only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm import simhash
from loomwright.llm.chunks import release
from loomwright.llm.graph import connected_components
from loomwright.session import materialise, remove

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 27, 4
BUCKET_CAP, LEADERS, TURNS = 32, 4, 2
#: Copies of a set in a join, so that a leader's many pairs are spread.
SALTS, FEW_SALTS = 32, 8
#: Members of a block, and how many deviations an estimate may be too low.
BLOCK, SIGMAS = 1024, 4.5
#: Shingles and texts that are hashed at once.
PART, SLICE = 4096, 512
_rng = np.random.default_rng(11)
_FACTORS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _rng.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)


def shingles(text: bytes | None) -> np.ndarray:
    """The distinct shingles' hashes in ascending order; a text without words has the empty shingle."""
    words = text.lower().split() if text else []
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    if len(words) <= SHINGLE:
        return np.frombuffer(digest(joined, 42), dtype=">u8").astype(np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-SHINGLE] + 1]).tolist()
    return np.unique(np.frombuffer(b"".join([digest(joined[a:b], 42) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist())]), dtype=">u8").astype(np.uint64))


def name(found: np.ndarray) -> int:
    """The number that stands for a set of shingles."""
    return int(np.frombuffer(xxhash.xxh64_digest(found.tobytes(), 42), dtype=">i8")[0])


def bands(found: np.ndarray) -> tuple[np.ndarray, bytes]:
    """A key for each band, and one byte of each minimum."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), PART):
        mixed = found[at : at + PART, None] * _FACTORS + _SHIFTS
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        np.minimum(least, mixed.min(axis=0), out=least)
    key = np.zeros(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = (key ^ column) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(31)
    return key.view(np.int64), (least * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(56)).astype(np.uint8).tobytes()


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for at in range(0, len(texts), SLICE):
        for text in texts.slice(at, SLICE).cast(pa.binary()).to_pylist():
            yield shingles(text)


def tags(texts: pa.Array) -> pa.Array:
    return pa.array([name(x) for x in _sets(texts)], pa.int64())


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, sizes, keys, marks, prints = [], [], [], [], []
        for x in _sets(batch.column(1)):
            names.append(name(x))
            sizes.append(len(x))
            key, mark = bands(x)
            keys.append(key)
            marks.append(mark)
            prints.append(simhash.majority(x.astype(">u8").view(np.uint8).reshape(-1, 8)))
        flat = pa.array(np.concatenate(keys) if keys else np.empty(0, np.int64), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * BANDS, pa.int32()), flat)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.int64()), pa.array(sizes, pa.int32()), lists, pa.array(marks, pa.binary()), pa.array(np.frombuffer(b"".join(prints), ">i8").astype(np.int64))], names=["doc_id", "fp", "size", "keys", "marks", "print"])
    release()


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            found = list(_sets(batch.column(0).slice(at, SLICE)))
            flat = np.concatenate(found).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(x) for x in found])])
            yield pa.RecordBatch.from_arrays([pa.array([name(x) for x in found], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["fp", "shingles"])
    release()


def _checked(pairs: DataFrame, sets: DataFrame, salts: int = 1) -> DataFrame:
    """Those of pairs(a, b) whose sets are similar enough; sets(fp, shingles). The sets of a are joined in `salts` copies."""
    salt = F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int")
    left = sets.join(pairs.select(F.col("a").alias("fp")).distinct(), "fp", "left_semi").select(F.col("fp").alias("a"), F.col("shingles").alias("x"), F.explode(F.array(*map(F.lit, range(salts)))).alias("salt"))
    right = sets.select(F.col("fp").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    whole = F.size("x") + F.size("y") - common
    return pairs.distinct().withColumn("salt", salt).join(right, "b").join(left, ["a", "salt"]).filter(common >= F.lit(SIMILARITY) * whole).select("a", "b")


def _pairs(left: DataFrame, right: DataFrame, when: Column) -> DataFrame:
    """(a, b): members of left and right(key, fp, size, component) that share a bucket and whose sizes allow the similarity; when: over x.* and y.*."""
    fit = F.least("x.size", "y.size") >= F.lit(SIMILARITY) * F.greatest("x.size", "y.size")
    found = left.alias("x").join(right.alias("y"), (F.col("x.key") == F.col("y.key")) & fit & when)
    return found.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def seeds(signatures: DataFrame) -> DataFrame:
    """(a, b): of each group of near SimHash fingerprints the first set, and each of the others; one row at most for each of signatures(fp, print)."""
    near = simhash.links(materialise(signatures.select(F.col("print").alias("fp")).distinct(), "prints", small=True))
    comps = connected_components(near).withColumnRenamed("node", "print")
    named = signatures.select("fp", "print").join(comps, "print", "left").select("fp", F.coalesce("component", "print").alias("group"))
    first = named.groupBy("group").agg(F.min("fp").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return named.join(first, "group").filter("fp <> a").select("a", F.col("fp").alias("b"))


def _leaders(members: DataFrame) -> DataFrame:
    """Up to LEADERS members of each bucket, of those that are in most hot buckets; nearly the same ones in all buckets that they share."""
    least = [F.min(F.struct((-F.col("hot")).alias("rare"), F.xxhash64("fp", F.lit(i)).alias("order"), "fp", "size", "component")) for i in range(LEADERS)]
    one = members.groupBy("key").agg(F.array_distinct(F.transform(F.array(*least), lambda x: F.struct(x["fp"], x["size"], x["component"]))).alias("all"))
    return one.select("key", F.inline("all").alias("fp", "size", "component"))


def _strays(members: DataFrame) -> DataFrame:
    """Members outside their bucket's largest component; at first every set is its own."""
    most = members.groupBy("key", "component").agg(F.count("*").alias("m")).groupBy("key").agg(F.max_by("component", F.struct("m", "component")).alias("main"))
    return members.join(most, "key").filter("component <> main").drop("main")


def _compared(of_strays: pa.Table, of_members: pa.Table) -> pa.Table:
    """(a, b): edges that link components, of a block of strays and one of members of the same bucket; band, fp, component, marks, shingles."""
    edges: list[tuple[int, int]] = []
    if of_strays.num_rows and of_members.num_rows:
        band = of_strays["band"][0].as_py()
        (fa, ca, ma, xa), (fb, cb, mb, xb) = (
            (t["fp"].to_numpy(), t["component"].to_numpy(), np.frombuffer(b"".join(t["marks"].to_pylist()), np.uint8).reshape(t.num_rows, BANDS * ROWS), t["shingles"].combine_chunks()) for t in (of_strays, of_members)
        )
        sets: dict[tuple[int, int], np.ndarray] = {}

        def whole(side: int, i: int) -> np.ndarray:
            if (side, i) not in sets:
                sets[side, i] = (xa, xb)[side][i].values.to_numpy()
            return sets[side, i]

        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root.setdefault(up, up)
            return x

        wa, wb = ma.view(np.uint32), mb.view(np.uint32)
        least = SIMILARITY - SIGMAS * np.sqrt(SIMILARITY * (1 - SIMILARITY) / (BANDS * ROWS))
        sb = np.diff(xb.offsets.to_numpy())
        for i in range(len(fa)):
            share = (ma[i] == mb).mean(1)
            first = (wa[i] == wb).argmax(1) == band
            n = len(whole(0, i))
            fit = np.minimum(sb, n) >= SIMILARITY * np.maximum(sb, n)
            some = np.nonzero((share >= least) & first & fit & (cb != ca[i]))[0]
            for j in some[np.argsort(-share[some], kind="stable")].tolist():
                if (p := find(int(ca[i]))) != (q := find(int(cb[j]))):
                    common = len(np.intersect1d(whole(0, i), whole(1, j), assume_unique=True))
                    if common >= SIMILARITY * (n + int(sb[j]) - common):
                        root[max(p, q)] = min(p, q)
                        edges.append((int(fa[i]), int(fb[j])))
    return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})


def _apart(rest: DataFrame, signatures: DataFrame, sets: DataFrame, block: int) -> DataFrame:
    """Edges (a, b) between components of a bucket, all members outside its largest one compared with all members of others."""
    strays = _strays(rest)
    n = rest.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("m")).join(strays.groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("v")), "key")
    full = rest.select("fp").distinct().join(sets, "fp").join(signatures.select("fp", "marks"), "fp")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    own = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    left = strays.join(n, "key").select("key", "band", spread("m").alias("mb"), own("v").alias("vb"), "fp", "component").join(full, "fp")
    right = rest.join(n, "key").select("key", own("m").alias("mb"), spread("v").alias("vb"), "fp", "component").join(full, "fp")
    left, right = (side.select(*(F.col(c).alias(c) for c in side.columns)) for side in (left, right))  # the two sides come of one table
    keys = ["key", "mb", "vb"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_compared, "a long, b long")


def links(signatures: DataFrame, docs: DataFrame, bucket_cap: int = BUCKET_CAP, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) over signatures(fp, size, keys, marks, print, first_id), one row for a set, whose components are those of all links; docs(doc_id, text)."""
    # bands hash with factors of their own, so that their keys need no number
    filed = signatures.select("fp", "size", F.posexplode("keys").alias("band", "key"))
    shared = filed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    written = materialise(filed.join(shared, "key"), "bands")
    near = materialise(seeds(signatures), "seeds", small=True)
    some_sets = written.select("fp").union(near.select("a")).union(near.select("b")).distinct()
    ids = materialise(signatures.select("fp", F.col("first_id").alias("doc_id")).join(some_sets, "fp", "left_semi").select("doc_id").distinct(), "ids")
    some = F.broadcast(ids) if ids.count() <= simhash.BROADCAST_KEYS else ids
    texts = docs.filter("doc_id is not null").join(some, "doc_id", "left_semi").union(docs.filter("doc_id is null")).select("text")
    sets = materialise(texts.mapInArrow(_whole, "fp long, shingles array<long>").join(some_sets, "fp", "left_semi").dropDuplicates(["fp"]), "sets")
    found = materialise(_checked(near, sets, FEW_SALTS), "links", small=True)
    filed = written.join(connected_components(found).withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    few, hot = filed.filter(F.col("n") <= bucket_cap), filed.filter(F.col("n") > bucket_cap)
    found = found.union(materialise(_checked(_pairs(few, few, (F.col("x.fp") < F.col("y.fp")) & (F.col("x.component") != F.col("y.component"))), sets), "links", small=True))
    rest = materialise(hot.join(hot.groupBy("fp").agg(F.count("*").alias("hot")), "fp"), "hot-bands", small=True)
    for turn in range(TURNS + 1):
        if rest.isEmpty():
            break
        if turn < TURNS:
            # each member meets the leaders of its largest bucket, whatever the number of buckets that it shares with them
            largest = rest.groupBy("fp").agg(F.max_by("key", F.struct("n", "key")).alias("key"))
            pairs = _pairs(_leaders(_strays(rest)), rest.join(largest, ["fp", "key"]), F.col("x.component") != F.col("y.component"))
            found = found.union(materialise(_checked(pairs, sets, SALTS), "links", small=True))
            comps = connected_components(found)
            now = rest.drop("component").join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
            several = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
            rest = materialise(now.join(several, "key", "left_semi"), "apart")
        else:
            found = found.union(materialise(_apart(rest, signatures, sets, block), "links", small=True))
    remove(sets)
    remove(written)
    return found


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_cap: int = BUCKET_CAP) -> DataFrame:
    """One row for each row of docs, as simhash.near_duplicates() gives; fp is the number of the set of shingles."""
    two = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    own = materialise(two.mapInArrow(_signatures, "doc_id long, fp long, size int, keys array<long>, marks binary, print long"), "signatures")
    fps = materialise(own.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.any_value("size").alias("size"), F.any_value("keys").alias("keys"), F.any_value("marks").alias("marks"), F.any_value("print").alias("print")), "distinct-signatures")
    return simhash.labelled(own.select("doc_id", "fp"), fps.select("fp", "first_id"), links(fps, two, bucket_cap))
