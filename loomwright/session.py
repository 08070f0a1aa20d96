"""Session construction and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", app: str = "loomwright", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with UTC time, AQE and Arrow on; conf overrides single settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    return SparkSession.builder.master(master).appName(app).config(map=settings).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where it is set.

    Only where it is unset and all runs in one process, as in tests, a temporary folder is made and set; on a cluster
    an unset folder is an error, for executors can't see each other's own folders.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if where is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="loomwright-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


#: Files of a written table for each core at most, and of a small one.
FILES, FEW_FILES = 16, 2


def materialise(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back.

    This cuts the lineage: a lost executor costs the tasks that it was running, not what was written before. Partitions are
    written one after the other by at most FILES tasks for each core; small: by FEW_FILES, for tables of a few columns
    whose many tiny files would cost more than their rows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomwright/{name}-{uuid.uuid4().hex}"
    df.coalesce((FEW_FILES if small else FILES) * spark.sparkContext.defaultParallelism).write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sweep(spark: SparkSession, hours: float = 24.0) -> int:
    """Delete the tables of materialise() in the shared folder that nothing has written to for so long; how many. For use between jobs: results are read lazily."""
    jvm = spark.sparkContext._jvm
    home = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/loomwright")
    fs = home.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    old = [f.getPath() for f in (fs.listStatus(home) if fs.exists(home) else []) if f.getModificationTime() < (time.time() - 3600 * hours) * 1000]
    for path in old:
        fs.delete(path, True)
    return len(old)


def remove(df: DataFrame) -> None:
    """Delete a table that materialise() returned and nothing reads any more; files outside the shared folder are never touched."""
    spark = df.sparkSession
    plain = lambda path: re.sub("^file:/+", "/", path)
    home = plain(shared_dir(spark)) + "/loomwright/"
    for folder in {f.rpartition("/")[0] for f in df.inputFiles() if plain(f).startswith(home)}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
