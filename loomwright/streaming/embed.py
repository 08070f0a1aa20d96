"""Incremental embedding: pending chunks become vectors, vectors are stored before flags are set."""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomwright.functions.ids import uuid5
from loomwright.operators import store
from loomwright.operators.keyed import KeyedTable, put_once, read_text
from loomwright.session import materialise


def hashing_encoder(dims: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A deterministic stand-in for a model: signed word hashes, of length 1."""

    def encode(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dims
            for w in (t or "").lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dims] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return encode


def embed(chunks: DataFrame, encode: Callable[[list[str]], list[list[float]]], batch: int = 64) -> DataFrame:
    """chunk_id, point_id, embedding of chunks(id, text), encoded in batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encode(part.column(1).to_pylist()), pa.list_(pa.float32()))], names=["chunk_id", "embedding"])

    made = chunks.select("id", "text").mapInArrow(run, "chunk_id string, embedding array<float>")
    return made.select("chunk_id", uuid5(F.col("chunk_id")).alias("point_id"), "embedding")


def embed_pending(chunks: KeyedTable, vectors: KeyedTable, encode: Callable[[list[str]], list[list[float]]], limit: int | None = None, dry_run: bool = False) -> int:
    """One round over chunks(id, text, embedded_at, ...) and vectors(chunk_id, point_id, embedding): the number of chunks that were pending.

    Vectors are written first, so a failure between the two repeats work and loses none. A chunk whose text changed meanwhile stays pending.
    """
    todo = store.pending(chunks.read(), limit)
    if dry_run:
        return todo.count()
    todo = materialise(todo, "pending")
    vectors.upsert(embed(todo, encode))
    kept = {c: F.col(f"old.{c}") for c in chunks.schema.names}
    same = F.col("old.text").eqNullSafe(F.col("new.text"))
    chunks.merge(todo, kept | {"embedded_at": F.when(same, F.current_timestamp())}, insert=False)
    return todo.count()


def stream_id(spark: SparkSession, checkpoint: str) -> str:
    """A name that lasts as long as a checkpoint folder; a new checkpoint, whose batches are numbered from 0 again, gets another."""
    put_once(spark, f"{checkpoint}/loomwright-stream", uuid.uuid4().hex)
    return read_text(spark, f"{checkpoint}/loomwright-stream")


def embed_stream(chunk_files: DataFrame, vectors: KeyedTable, checkpoint: str, encode: Callable[[list[str]], list[list[float]]]) -> StreamingQuery:
    """A stream of chunks(id, text) into a table of vectors: each micro-batch is upserted by chunk_id. A repeated batch changes nothing, and any number of streams may write to one table."""
    name = stream_id(chunk_files.sparkSession, checkpoint)

    def sink(rows: DataFrame, epoch: int) -> None:
        vectors.upsert(embed(rows.dropDuplicates(["id"]), encode), batch=(name, epoch))

    return chunk_files.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, time: str, keys: list[str], size: str, late: str, *aggregates: Column) -> DataFrame:
    """Aggregates by event-time window and keys, with a watermark; works on streams and tables alike."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    return stamped.withWatermark(time, late).groupBy(F.window(time, size).alias("w"), *keys).agg(*aggregates).select(F.col("w.start").alias("window_start"), *keys, *[F.col(c) for c in _names(aggregates)])


def _names(aggregates: tuple[Column, ...]) -> list[str]:
    return [a._jc.toString().rpartition(" AS ")[2] for a in aggregates]
