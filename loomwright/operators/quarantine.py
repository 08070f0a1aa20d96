"""Rows that fail are set aside with their stage, error and number of tries; the others go on, and a later run takes them up again.

A step takes a stage's rows and returns its result with a column `error`, null where all went well. attempt() makes such an error
of a Python function that raises; checks() makes it of conditions. What failed is kept as the stage got it, so that a run after
the repair of code or data goes on from there without the stages before.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from loomwright.operators.keyed import KeyedTable
from loomwright.session import materialise

ERROR = "error"


def attempt(f: Callable[[object], object], kind: T.DataType) -> Callable[[Column], Column]:
    """f for each value of a column, in Arrow batches: a struct of its value and, where it raised, an error. Nulls are f's to handle."""

    def run(values: pd.Series) -> pd.DataFrame:
        made: list[tuple[object, str | None]] = []
        for v in values:
            try:
                made.append((f(v), None))
            except Exception as error:  # noqa: BLE001  that is what the error column is for
                made.append((None, f"{type(error).__name__}: {error}"))
        return pd.DataFrame({"value": pd.Series([m[0] for m in made], dtype=object), ERROR: pd.Series([m[1] for m in made], dtype=object)})

    run.__annotations__ = {"values": pd.Series, "return": pd.DataFrame}
    return pandas_udf(run, T.StructType([T.StructField("value", kind), T.StructField(ERROR, T.StringType())]))


def checks(**conditions: Column) -> Column:
    """The name of the first condition that isn't true; null if all are."""
    return F.coalesce(*(F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in conditions.items()))


@dataclass
class Stage:
    """step: rows with the column `key` to rows with `key` and `error`; it may leave rows out or make several of one, which fail together."""

    name: str
    step: Callable[[DataFrame], DataFrame]


class Quarantine:
    """A keyed table of (stage, id): row as JSON, error, tries, and whether it came through since. Create with create(), or open with Quarantine(spark, root)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.table = spark, KeyedTable(spark, root)

    @staticmethod
    def create(spark: SparkSession, root: str, id_type: str = "string", buckets: int = 16) -> Quarantine:
        KeyedTable.create(spark, root, f"stage string, id {id_type}, row string, error string, tries int, solved boolean", ["stage", "id"], buckets)
        return Quarantine(spark, root)

    def open(self) -> DataFrame:
        """stage, id, row, error, tries of what hasn't come through."""
        return self.table.read().filter(~F.col("solved")).drop("solved")

    def held(self, stage: str, schema: T.StructType, most_tries: int | None = None) -> DataFrame:
        """A stage's open rows as it got them; those with so many tries stay aside."""
        rows = self.open().filter(F.col("stage") == stage)
        rows = rows if most_tries is None else rows.filter(F.col("tries") < most_tries)
        return rows.select(F.from_json("row", schema, {"mode": "FAILFAST", "timestampFormat": STAMP, "timestampNTZFormat": STAMP[:-3]}).alias("r")).select("r.*")

    def through(self, stage: Stage, rows: DataFrame, key: str, most_tries: int | None = None) -> tuple[DataFrame, DataFrame]:
        """(what went well, ids that the stage took) of rows and of what is held of the stage; a row replaces a held one of its key.

        Failed rows are in the table when this returns, each with one more try. ids are for solved(), once the results are where
        they belong. ValueError if keys of rows aren't unique among those that fail. A null key is a key like any other.
        """
        again = self.held(stage.name, rows.schema, most_tries)
        taken = materialise(rows.unionByName(_without(again, rows, key)), "stage")
        made = materialise(stage.step(taken), "step")
        why = made.filter(F.col(ERROR).isNotNull()).groupBy(key).agg(F.min(ERROR).alias("why"))
        a, b = taken.alias("a"), why.alias("b")
        whole = F.to_json(F.struct(*(F.col(f"a.{c}") for c in rows.columns)), {"ignoreNullFields": "false", "timestampFormat": STAMP, "timestampNTZFormat": STAMP[:-3]})
        bad = a.join(b, F.col(f"a.{key}").eqNullSafe(F.col(f"b.{key}"))).select(F.lit(stage.name).alias("stage"), F.col(f"a.{key}").alias("id"), whole.alias("row"), F.col("why").alias("error"), F.lit(1).alias("tries"), F.lit(False).alias("solved"))
        bad = materialise(bad, "failed", small=True)
        if not bad.groupBy("id").count().filter("count > 1").isEmpty():
            raise ValueError(f"keys of rows that fail in {stage.name} aren't unique")
        if not bad.isEmpty():
            self.table.merge(bad, {"tries": F.coalesce(F.when(~F.col("old.solved"), F.col("old.tries")), F.lit(0)) + 1})
        return _without(made.filter(F.col(ERROR).isNull()).drop(ERROR), why, key), _without(taken, why, key).select(F.col(key).alias("id"))

    def solved(self, stage: str, ids: DataFrame) -> int:
        """Open rows of a stage with these ids have come through; how many."""
        mine = self.open().filter(F.col("stage") == stage).alias("a")
        done = materialise(mine.join(ids.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")), "left_semi"), "solved", small=True)
        n = done.count()
        if n:
            self.table.merge(done.withColumn("solved", F.lit(True)), {}, insert=False)
        return n

    def run(self, stages: list[Stage], rows: DataFrame, key: str, sink: Callable[[DataFrame], object], most_tries: int | None = None) -> None:
        """Rows through all stages into a sink; what failed in earlier runs goes on with them from the stage where it failed.

        The sink takes rows more than once if a run is repeated, so it upserts. Only after it has returned are the rows marked as
        come through, so that a run that breaks off loses none of them. To take up what failed without new rows, pass rows.limit(0).
        """
        taken = []
        for stage in stages:
            rows, ids = self.through(stage, rows, key, most_tries)
            taken.append((stage.name, ids))
        sink(rows)
        for name, ids in taken:
            self.solved(name, ids)


#: How times are written in kept rows.
STAMP = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def _without(rows: DataFrame, others: DataFrame, *keys: str) -> DataFrame:
    a, b = rows.alias("a"), others.select(*keys).alias("b")
    return a.join(b, reduce(Column.__and__, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)), "left_anti")
