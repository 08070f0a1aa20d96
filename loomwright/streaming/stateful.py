"""A stream that embeds what changed, with each chunk's state kept by Spark.

Chunks come as (id, version, text), in any order and as often as one likes. For each id the state holds the newest version, the
hash of its text, and whether its vector is stored. Only a text that is new goes on to the encoder; late and repeated
rows end in the state. What was stored comes back as an acknowledgement; work that isn't acknowledged in time is sent again, a
bounded number of times. A null text deletes the vector.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from loomwright.operators.keyed import KeyedTable
from loomwright.session import materialise
from loomwright.streaming.embed import embed, stream_id

STATE = "version long, hash string, text string, tries int, done boolean"
WORK = "id string, action string, text string, hash string, version long, tries int"
ACK = "id string, hash string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Changes(StatefulProcessor):
    """Rows (id, version, text, done) become work. done: null in chunks, the hash that was stored in acknowledgements."""

    def __init__(self, patience: int, tries: int) -> None:
        # a timer set for the time of its own batch would run out in it
        self.patience, self.tries = max(1, patience), tries

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("chunk", STATE)

    def _keep(self, version: int, hashed: str, text: str | None, tries: int, done: bool) -> None:
        self.state.update((version, hashed, text, tries, done))

    def _wait(self, now: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(now + self.patience)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001
        held = self.state.get() if self.state.exists() else None
        newest, acknowledged = None, set()
        for r in rows:
            if r.done is not None:
                acknowledged.add(r.done)
            elif newest is None or (r.version, r.text or "") > (newest.version, newest.text or ""):
                newest = r
        version, hashed, text, tries, done = held or (None, None, None, 0, False)
        if held and hashed in acknowledged and not done:
            text, done = None, True
            self._keep(version, hashed, None, tries, True)
        if newest is not None and (held is None or newest.version > version):
            new = hashlib.sha256((newest.text or "").encode()).hexdigest() if newest.text is not None else "deleted"
            if held and new == hashed:
                self._keep(newest.version, hashed, text, tries, done)
            else:
                self._keep(newest.version, new, newest.text, 1, False)
                self._wait(timerValues.getCurrentProcessingTimeInMs())
                yield self._work(key[0], newest.text, new, newest.version, 1)

    @staticmethod
    def _work(key: str, text: str | None, hashed: str, version: int, tries: int) -> Row:
        return Row(id=key, action="delete" if hashed == "deleted" else "embed", text=text, hash=hashed, version=version, tries=tries)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: ANN001
        if self.state.exists():
            version, hashed, text, tries, done = self.state.get()
            if not done and tries < self.tries:
                self._keep(version, hashed, text, tries + 1, False)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience)
                yield self._work(key[0], text, hashed, version, tries + 1)
            elif not done and tries == self.tries:
                self._keep(version, hashed, text, tries + 1, False)
                yield Row(id=key[0], action="failed", text=None, hash=hashed, version=version, tries=tries)

    def close(self) -> None:
        pass


def safely(encode: Callable[[list[str]], list[list[float]]]) -> Callable[[list[str]], list[list[float] | None]]:
    """An encoder whose failures cost the texts that fail, not their batch: these get null."""

    def one(text: str) -> list[float] | None:
        try:
            return encode([text])[0]
        except Exception:  # noqa: BLE001  it isn't acknowledged, so it comes again
            return None

    def run(texts: list[str]) -> list[list[float] | None]:
        try:
            return list(encode(texts))
        except Exception:  # noqa: BLE001
            return [one(t) for t in texts]

    return run


def embed_changes(
    chunks: DataFrame, vectors: KeyedTable, folder: str, encode: Callable[[list[str]], list[list[float]]], patience: int = 600_000, tries: int = 3, failed: KeyedTable | None = None, once: bool = True
) -> StreamingQuery:
    """A stream of chunks(id, version, text) kept up in vectors(chunk_id, point_id, embedding).

    folder holds the checkpoint and the acknowledgements. patience: milliseconds after which work that wasn't acknowledged is
    sent again, `tries` times in all; then it goes to failed(id, hash, version). Of rows with one id and version the one with the
    last text counts. once: stop when all that is there now is done; what is overdue is then sent with the next run's data.
    Rows without an id or version take no part.
    """
    spark = chunks.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)  # the only store with timers
    acks = f"{folder}/acks"
    spark.createDataFrame([], ACK).write.mode("append").parquet(acks)
    name = stream_id(spark, f"{folder}/checkpoint")
    told = spark.readStream.schema(ACK).parquet(acks).select("id", F.lit(None).cast("long").alias("version"), F.lit(None).cast("string").alias("text"), F.col("hash").alias("done"))
    rows = chunks.filter("id is not null and version is not null").select("id", F.col("version").cast("long").alias("version"), "text", F.lit(None).cast("string").alias("done"))
    work = rows.unionByName(told).groupBy("id").transformWithState(Changes(patience, tries), StructType.fromDDL(WORK), "Update", "ProcessingTime")

    def sink(batch: DataFrame, epoch: int) -> None:
        batch = materialise(batch, "work")
        new = materialise(embed(batch.filter("action = 'embed'"), safely(encode)).filter("embedding is not null"), "vectors")
        vectors.upsert(new, batch=(f"{name}-embed", epoch))
        vectors.delete(batch.filter("action = 'delete'").select(F.col("id").alias("chunk_id")), batch=(f"{name}-delete", epoch))
        if failed is not None:
            failed.upsert(batch.filter("action = 'failed'"), batch=(f"{name}-failed", epoch))
        done = batch.filter("action = 'delete'").select("id", "hash").union(batch.join(new, batch.id == new.chunk_id, "left_semi").filter("action = 'embed'").select("id", "hash"))
        # a repeated acknowledgement changes nothing
        if not done.isEmpty():
            done.coalesce(1).write.mode("append").parquet(acks)

    writer = work.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint")
    # batches without data, in which timers run out, never end by themselves
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(idle)
    spark.conf.set(idle, str(not once).lower())
    try:
        return (writer.trigger(availableNow=True) if once else writer).start()
    finally:
        spark.conf.set(idle, before)
