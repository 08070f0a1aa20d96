"""A written collection of vectors with payload, searched by cosine under filters, without reading all of it.

Vectors fall into cells around directions that are told from a bounded sample, in an order in which neighbouring cells are
near each other. Every vector is filed once for the whole collection and once for each indexed payload column
under its value: a frequent value has its own buckets, each a run of cells; rare values share buckets by their hash. A search
takes the filter with the fewest rows and reads that value's buckets, those with the nearest cells first, so many as queries of
the sample needed for the wanted recall at that selectivity, and goes on while other filters leave it too few rows.

Changes are commits of a keyed table: a changed or deleted vector gets a mark with its new generation, and what was filed with
another one no longer counts. optimize() files all anew.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators.keyed import KeyedTable, put_once, read_text
from loomwright.operators.retrieval import payload_filter, vector_topk

#: Vectors from which the cells and the depth of searches are told, the most cells, vectors of a cell, rows of a bucket.
SAMPLE, MAX_CELLS, CELL, ROWS = 20_000, 4096, 64, 1024
#: Buckets of marks and of a column's rare values, at least.
MARKS, RARE = 8, 4
#: Queries of the sample, and what part of their neighbours a search of the told depth finds.
PROBES, RECALL = 300, 0.98


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: not null or empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.Array) -> np.ndarray:
    flat = np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64)
    x = flat.reshape(len(column), -1)
    x = x / np.maximum(np.abs(x).max(axis=1, initial=0), 1e-300)[:, None]
    return x / np.linalg.norm(x, axis=1)[:, None]


def _side_by_side(x: np.ndarray) -> np.ndarray:
    """An order of the rows of x in which those near each other mostly are: halves along the principal direction, again and again."""
    if len(x) < 3:
        return np.arange(len(x))
    some = x - x.mean(0)
    order = np.argsort(some @ np.linalg.eigh(some.T @ some)[1][:, -1], kind="stable")
    a, b = order[: len(x) // 2], order[len(x) // 2 :]
    return np.concatenate([a[_side_by_side(x[a])], b[_side_by_side(x[b])]])


def _means(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """The directions of k groups of unit vectors, each nearest to its own."""
    centres = x[np.linspace(0, len(x) - 1, k).astype(int)]
    for _ in range(rounds):
        own = np.concatenate([(x[at : at + 2048] @ centres.T).argmax(1) for at in range(0, len(x), 2048)])
        order = np.argsort(own, kind="stable")
        which, begin = np.unique(own[order], return_index=True)
        sums = np.add.reduceat(x[order], begin, axis=0)
        centres = centres.copy()
        centres[which] = sums / np.maximum(np.linalg.norm(sums, axis=1), 1e-12)[:, None]
    return centres


class Cells:
    """Groups of near directions, in an order in which neighbours are near each other."""

    def __init__(self, centres: np.ndarray, share: np.ndarray, depth: list[tuple[int, float]]) -> None:
        self.centres, self.share, self.depth = centres, share, depth
        #: How much of all vectors lies in the cells before each.
        self.before = np.concatenate([[0.0], np.cumsum(share)[:-1]])

    @staticmethod
    def grow(x: np.ndarray, total: int) -> Cells:
        """From a sample of unit vectors, of `total` vectors in all. One half makes the cells, the other tells how deep searches must go."""
        fit, other = (x[::2], x[1::2]) if len(x) > 1 else (x, x)
        centres = _means(fit, max(1, min(MAX_CELLS, total // CELL, len(fit) // 8)))
        centres = centres[_side_by_side(centres)]
        made = Cells(centres, np.full(len(centres), 1 / len(centres)), [])
        cell = made.cells(other)
        made = Cells(centres, np.bincount(cell, minlength=len(centres)) / len(other), [])
        chosen = np.linspace(0, len(other) - 1, min(PROBES, len(other))).astype(int)
        near = other[chosen] @ other.T
        near[np.arange(len(chosen)), chosen] = -np.inf
        best = np.argsort(-near, axis=1, kind="stable")[:, :-1]
        order = made.order(other[chosen])
        reached = np.cumsum(made.share[order], axis=1)
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], 1)
        needed = np.take_along_axis(np.take_along_axis(reached, place, 1), cell[best], 1) if best.size else np.ones((1, 1))
        k = 1
        while k < needed.shape[1]:
            made.depth.append((k, float(np.quantile(needed[:, :k], RECALL))))
            k *= 2
        made.depth.append((needed.shape[1], 1.0))
        return made

    def cells(self, x: np.ndarray) -> np.ndarray:
        if len(self.centres) == 1:
            return np.zeros(len(x), np.int64)
        return np.concatenate([np.zeros(0, np.int64), *((x[at : at + 2048] @ self.centres.T).argmax(1) for at in range(0, len(x), 2048))])

    def order(self, x: np.ndarray) -> np.ndarray:
        """Cells for each row of x, those with the most similar direction first."""
        if len(self.centres) == 1:
            return np.zeros((len(x), 1), np.int64)
        return np.argsort(-(x @ self.centres.T), axis=1, kind="stable")

    def enough(self, part: float) -> float:
        """How much of the vectors must be looked at to find the first ones, these being that part of all."""
        of_sample = part * max(1, self.depth[-1][0])
        return next(share for k, share in self.depth if k >= of_sample or k == self.depth[-1][0])

    def dump(self) -> dict:
        packed = lambda a: [list(a.shape), base64.b64encode(zlib.compress(np.ascontiguousarray(a, dtype="<f8").tobytes())).decode()]
        return {"centres": packed(self.centres), "share": packed(self.share), "depth": self.depth}

    @staticmethod
    def load(held: dict) -> Cells:
        opened = lambda p: np.frombuffer(zlib.decompress(base64.b64decode(p[1])), "<f8").reshape(p[0])
        return Cells(opened(held["centres"]), opened(held["share"]), [tuple(d) for d in held["depth"]])


class Directory:
    """Which buckets hold what: (column, value) has `many` buckets from `first`, in the order of the cells; other values of a column one of its rare ones."""

    def __init__(self, total: int, frequent: dict[tuple[str, str | None], int], rare: dict[str, int], rows: int) -> None:
        self.total, self.rows, self.buckets = total, frequent, MARKS
        self.runs, self.rare = {}, {}
        for key, n in sorted(frequent.items(), key=str):
            self.runs[key] = (self.buckets, max(1, -(-n // rows)))
            self.buckets += self.runs[key][1]
        for column, n in sorted(rare.items()):
            self.rare[column] = (self.buckets, max(RARE, -(-n // rows)))
            self.buckets += self.rare[column][1]

    def of_cells(self, key: tuple[str, str | None], before: np.ndarray) -> np.ndarray:
        """The bucket of each cell."""
        first, many = self.runs[key]
        return first + np.minimum((before * many).astype(np.int64), many - 1)

    def of_rare(self, column: str, value: str | None) -> int:
        first, many = self.rare[column]
        return first + zlib.crc32(repr(value).encode()) % many


class VectorIndex:
    """Create with create(), or open with VectorIndex(spark, root). Payload columns may be indexed; all can be filtered by."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.table = spark, KeyedTable(spark, root)
        held = [f for f in self.table.schema if f.name not in ("bucket", "id", "generation", "embedding")]
        self.payload = [f.name for f in held]
        about = self.table.extra
        self.indexed, self.cells, self.directory = about["indexed"], None, None
        if "file" in about:
            found = json.loads(read_text(spark, f"{root}/{about['file']}"))
            self.cells = Cells.load(found["cells"])
            self.directory = Directory(found["total"], {tuple(k): n for k, n in found["frequent"]}, found["rare"], found["rows"])

    @staticmethod
    def create(spark: SparkSession, root: str, id_type: str = "string", payload: str = "", indexed: list[str] | None = None) -> VectorIndex:
        """A new, empty collection. payload: `name type, ...` of the columns that come with vectors; indexed: those for which filters read little."""
        schema = f"bucket int, id {id_type}, generation long, embedding array<float>" + (f", {payload}" if payload else "")
        KeyedTable.create(spark, root, schema, ["bucket", "id"], 1, ["bucket"], direct=True, extra={"indexed": indexed or []})
        return VectorIndex(spark, root)

    def drop(self) -> None:
        self.table.drop()

    def _rows(self, vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
        """One row for each id, with its generation; of rows with one id the last by a hash of the row."""
        rows = vectors.select(F.col(id_col).cast(self.table.schema["id"].dataType).alias("id"), F.col(vector_col).cast("array<float>").alias("embedding"), *(F.col(c).cast(self.table.schema[c].dataType).alias(c) for c in self.payload))
        rows = rows.filter("id is not null").withColumn("generation", F.xxhash64("embedding", *self.payload))
        return rows.groupBy("id").agg(F.max_by(F.struct("generation", "embedding", *self.payload), "generation").alias("r")).select("id", "r.*")

    def build(self, vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding", rows: int = ROWS) -> VectorIndex:
        """File all vectors, in place of what the collection held. Vectors without a direction are left out, and all must have one length."""
        return self._build(self._rows(vectors, id_col, vector_col), rows, self.table.state())

    def _build(self, found: DataFrame, rows: int, state) -> VectorIndex:
        found = found.filter(usable(F.col("embedding")))
        total = found.count()
        sizes = found.agg(F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if sizes[0] != sizes[1]:
            raise ValueError("vectors of unlike lengths")
        sample = found.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).toArrow()["embedding"].combine_chunks()
        cells = Cells.grow(_unit(sample) if total else np.ones((1, 1)), total)
        frequent: dict[tuple[str, str | None], int] = {("", None): total}
        rare: dict[str, int] = {}
        for c in self.indexed:
            counts = found.groupBy(F.col(c).cast("string").alias("v")).count()
            often = [(r["v"], r["count"]) for r in counts.filter(F.col("count") >= rows).collect()]  # total / rows at most
            frequent |= {(c, v): n for v, n in often}
            rare[c] = total - sum(n for _, n in often)
        file = f"_directory/{uuid.uuid4().hex}.json"
        put_once(self.spark, f"{self.table.root}/{file}", json.dumps({"cells": cells.dump(), "total": total, "frequent": list(frequent.items()), "rare": rare, "rows": rows}))
        self.cells, self.directory = cells, Directory(total, frequent, rare, rows)
        self.table.overwrite(self._filed(found), state, self.directory.buckets, {"indexed": self.indexed, "file": file})
        return self

    def _filed(self, rows: DataFrame) -> DataFrame:
        """Rows for each bucket in which they are filed."""
        held = self.spark.sparkContext.broadcast((self.cells, self.directory, self.indexed))  # MAX_CELLS cells, and runs of total / ROWS values at most
        names = ["id", "generation", "embedding", *self.payload]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cells, directory, indexed = held.value
            whole = directory.of_cells(("", None), cells.before)
            for t in batches:
                if not t.num_rows:
                    continue
                cell = cells.cells(_unit(t["embedding"]))
                filed = [whole[cell]]
                for i, column in enumerate(indexed):
                    out = np.empty(t.num_rows, np.int64)
                    values = t[f"_{i}"].dictionary_encode(null_encoding="encode")
                    for code, value in enumerate(values.dictionary.to_pylist()):
                        some = np.nonzero(values.indices.to_numpy() == code)[0]
                        key = (column, value)
                        out[some] = directory.of_cells(key, cells.before)[cell[some]] if key in directory.runs else directory.of_rare(column, value)
                    filed.append(out)
                for bucket in filed:
                    yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *(t[n] for n in names)], names=["bucket", *names])

        typed = {f.name: f.dataType.simpleString() for f in self.table.schema}
        texts = [F.col(c).cast("string").alias(f"_{i}") for i, c in enumerate(self.indexed)]
        return rows.select(*names, *texts).mapInArrow(run, ", ".join(f"`{n}` {typed[n]}" for n in ("bucket", *names)))

    def _marks(self, rows: DataFrame) -> DataFrame:
        return rows.select(F.pmod(F.xxhash64("id"), F.lit(MARKS)).cast("int").alias("bucket"), "id", "generation")

    def upsert(self, vectors: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> int:
        """New and changed vectors, as one commit; a vector without a direction takes the one before out. The collection must have been built."""
        rows = self._rows(vectors, id_col, vector_col)
        return self.table.upsert(self._filed(rows.filter(usable(F.col("embedding")))).unionByName(self._marks(rows), allowMissingColumns=True))

    def delete(self, ids: DataFrame, id_col: str = "id") -> int:
        gone = ids.select(F.col(id_col).cast(self.table.schema["id"].dataType).alias("id"), F.lit(None).cast("long").alias("generation")).filter("id is not null").distinct()
        return self.table.upsert(self._marks(gone))

    @staticmethod
    def _counting(rows: DataFrame) -> DataFrame:
        marks = rows.filter(F.col("bucket") < MARKS).select("id", F.lit(True).alias("_marked"), F.col("generation").alias("_now"))
        held = rows.filter(F.col("bucket") >= MARKS).join(marks, "id", "left")
        return held.filter(F.col("_marked").isNull() | F.coalesce(F.col("generation") == F.col("_now"), F.lit(False))).drop("_marked", "_now")

    def _plan(self, query: np.ndarray, equal: dict[str, object]) -> tuple[list[int], int]:
        """The buckets that may hold matches, the most promising first, and how many a search begins with."""
        keys = [(c, self._text(c, v)) for c, v in equal.items() if c in self.indexed and v is not None]
        alone = [k for k in keys if k not in self.directory.runs]
        if alone:
            return [self.directory.of_rare(*alone[0])], 1
        key = min(keys or [("", None)], key=lambda k: self.directory.rows[k])
        bucket = self.directory.of_cells(key, self.cells.before)
        order = self.cells.order(query[None])[0]
        found = list(dict.fromkeys(bucket[order].tolist()))
        return found, self._needed(key, bucket, order)

    def _needed(self, key: tuple[str, str | None], bucket: np.ndarray, order: np.ndarray, k: int = 20) -> int:
        # the first k of a part of all vectors are like the first k / part of all
        share = self.cells.enough(k / max(1, self.directory.rows[key]))
        cells = int(np.searchsorted(np.cumsum(self.cells.share[order]), share - 1e-12)) + 1
        return len(set(bucket[order[:cells]].tolist()))

    def _text(self, column: str, value: object) -> str | None:
        kind = self.table.schema[column].dataType.simpleString()
        return self.spark.range(1).select(F.lit(value).cast(kind).cast("string")).first()[0]

    def search(self, query: list[float], k: int = 20, **equal: object) -> DataFrame:
        """id, score, rank of the nearest found by cosine, ties by id, among those that equal every given value that isn't None."""
        x = np.array(query, dtype=np.float64)
        if self.directory is None or not np.isfinite(x).all() or not x.any():
            return self.spark.createDataFrame([], f"id {self.table.schema['id'].dataType.simpleString()}, score double, rank int")
        buckets, n = self._plan(x / np.linalg.norm(x), equal)
        state = self.table.state()
        while True:
            rows = self._counting(self.table.read(state=state, buckets=[*range(MARKS), *buckets[:n]]))
            found = vector_topk(payload_filter(rows, **equal), query, k, "id")
            hits = found.collect()  # k rows
            if n >= len(buckets) or len(hits) >= k:
                return self.spark.createDataFrame(hits, found.schema)
            n *= 2  # other filters leave too few: the walk goes on

    def optimize(self) -> VectorIndex:
        """All vectors that count are filed anew, after which no marks are left."""
        state = self.table.state()
        first, many = self.directory.runs[("", None)]
        live = self._counting(self.table.read(state=state, buckets=[*range(MARKS), *range(first, first + many)])).drop("bucket")
        return self._build(live, ROWS, state)
