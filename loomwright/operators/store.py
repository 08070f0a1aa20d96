"""Tables with change detection: upserts, stale rows, pending work, run logs. Inputs and results are DataFrames; publish() makes a result the table, keyed.py holds tables that change in place."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.operators.keyed import Conflict, file_system, names, put_once, read_text


def upsert(target: DataFrame, updates: DataFrame, key: str, set_columns: dict[str, Column] | None = None) -> DataFrame:
    """Rows of updates replace those of target with the same key; others stay. set_columns may read old.* and new.*; the last row of a repeated key isn't defined, so keys of updates must be unique."""
    old, new = target.alias("old"), updates.alias("new")
    hit = F.col(f"new.{key}").isNotNull()
    set_columns = set_columns or {}
    columns = [F.when(hit, set_columns.get(c, F.col(f"new.{c}") if c in updates.columns else F.col(f"old.{c}"))).otherwise(F.col(f"old.{c}")).alias(c) for c in target.columns]
    return old.join(new, F.col(f"old.{key}") == F.col(f"new.{key}"), "full_outer").select(columns)


def upsert_chunks(target: DataFrame, updates: DataFrame, now: Column | None = None) -> DataFrame:
    """upsert() by id; embedded_at is kept only where the content hash is the old one, created_at is always renewed."""
    same = F.col("old.content_hash").eqNullSafe(F.col("new.content_hash")) & F.col("old.id").isNotNull()
    return upsert(target, updates, "id", {"embedded_at": F.when(same, F.col("old.embedded_at")), "created_at": now if now is not None else F.current_timestamp()})


def stale(target: DataFrame, valid: DataFrame, parents: DataFrame) -> DataFrame:
    """Rows of target of one of parents(parent_id) whose id isn't in valid(id)."""
    return target.join(parents.select("parent_id").distinct(), "parent_id", "left_semi").join(valid.select("id"), "id", "left_anti")


def without_stale(target: DataFrame, valid: DataFrame, parents: DataFrame) -> DataFrame:
    return target.join(stale(target, valid, parents).select("id"), "id", "left_anti")


def cascade(children: DataFrame, parents: DataFrame, key: str = "parent_id", parent_key: str = "id") -> DataFrame:
    """Children whose parent still exists."""
    return children.join(parents.select(F.col(parent_key).alias(key)).distinct(), key, "left_semi")


def pending(chunks: DataFrame, limit: int | None = None, category: str | None = None) -> DataFrame:
    """Chunks that aren't embedded, the least recently stored first."""
    rows = chunks.filter("embedded_at is null")
    rows = rows if category is None else rows.filter(F.col("category_code") == category)
    rows = rows.orderBy("created_at", "id")
    return rows if limit is None else rows.limit(limit)


def mark_embedded(chunks: DataFrame, ids: DataFrame, now: Column | None = None) -> DataFrame:
    """embedded_at of chunks in ids(id) is set."""
    done = ids.select("id").distinct().withColumn("done", F.lit(True))
    at = now if now is not None else F.current_timestamp()
    return chunks.join(done, "id", "left").withColumn("embedded_at", F.when(F.col("done"), at).otherwise(F.col("embedded_at"))).drop("done").select(chunks.columns)


def reset(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("embedded_at", F.lit(None).cast(chunks.schema["embedded_at"].dataType))


def progress(chunks: DataFrame) -> DataFrame:
    """total, embedded, pending, percent (one digit, 0 without rows)."""
    one = chunks.agg(F.count("*").alias("total"), F.count_if(F.col("embedded_at").isNotNull()).alias("embedded"), F.count_if(F.col("embedded_at").isNull()).alias("pending"))
    return one.withColumn("percent", F.coalesce(F.round(F.lit(100.0) * F.col("embedded") / F.nullif("total", F.lit(0)), 1), F.lit(0.0)))


def latest_runs(log: DataFrame) -> DataFrame:
    """The last state of each run of an append-only log(id, logged_at, ...)."""
    last = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("logged_at")))
    return log.withColumn("n", last).filter("n = 1").drop("n")


RUN = "id string, logged_at timestamp, status string, fetch_attachments boolean, use_details boolean, enrich_local boolean, articles long, chunks long, listed long, attachment_counts map<string,long>, error string"


def start_run(spark: SparkSession, path: str, fetch_attachments: bool = False, use_details: bool = True, enrich_local: bool = False) -> str:
    """Append a run that has begun to the log at path; its id."""
    run = uuid.uuid4().hex
    _log(spark, path, {"id": run, "status": "running", "fetch_attachments": fetch_attachments, "use_details": use_details, "enrich_local": enrich_local})
    return run


def finish_run(spark: SparkSession, path: str, run: str, articles: int, chunks: int, listed: int, attachment_counts: dict[str, int], status: str = "success", error: str | None = None) -> None:
    """Append the end of a run; latest_runs() of the log then has its last state, with the flags of its beginning."""
    first = spark.read.schema(RUN).json(path).filter((F.col("id") == run) & (F.col("status") == "running")).first()
    flags = {k: first[k] for k in ("fetch_attachments", "use_details", "enrich_local")} if first else {}
    _log(spark, path, {"id": run, "status": status, "articles": articles, "chunks": chunks, "listed": listed, "attachment_counts": attachment_counts, "error": error} | flags)


def _log(spark: SparkSession, path: str, row: dict) -> None:
    kept = row | {"logged_at": datetime.now(timezone.utc).replace(tzinfo=None)}
    names = [c.strip().split(" ")[0] for c in RUN.split(", ")]
    spark.createDataFrame([tuple(kept.get(n) for n in names)], RUN).coalesce(1).write.mode("append").json(path)


def versions(spark: SparkSession, root: str) -> list[str]:
    """The published versions under root, the oldest first."""
    return [read_text(spark, f"{root}/_versions/{n}") for n in names(spark, f"{root}/_versions") if n[0] != "."]


def publish(df: DataFrame, root: str) -> str:
    """Write df as a new version under root, the current one as soon as it is whole; what is being read is never touched, and a writer that dies leaves the version before in place.

    The version's number is taken by a file that can be made only once: of two writers that saw the same last version one gets Conflict.
    """
    spark = df.sparkSession
    known = [n for n in names(spark, f"{root}/_versions") if n[0] != "."]
    number = int(known[-1]) + 1 if known else 0
    name = f"v-{number:012d}-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{name}")
    if not put_once(spark, f"{root}/_versions/{number:012d}", name):
        fs, path = file_system(spark, f"{root}/{name}")
        fs.delete(path, True)
        raise Conflict(f"version {number} of {root} was published by another writer")
    return name


def current(spark: SparkSession, root: str) -> DataFrame:
    """The version that was published last."""
    return spark.read.parquet(f"{root}/{versions(spark, root)[-1]}")


def vacuum(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete all but the last versions, how many. The files that took their numbers go too, but for the last."""
    old = [n for n in names(spark, f"{root}/_versions") if n[0] != "."][:-keep]
    for n in old:
        for folder in (read_text(spark, f"{root}/_versions/{n}"), f"_versions/{n}"):
            fs, path = file_system(spark, f"{root}/{folder}")
            fs.delete(path, True)
    return len(old)
