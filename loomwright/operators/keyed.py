"""A table with a key that merges on read: upserts and deletes write what they change, and a log of numbered commits says which files count.

Rows lie in buckets by the hash of some key columns. A bucket has base files and, after changes, delta files whose rows replace
those of the same key, or delete them. A commit is a small JSON file whose name is the next number and which can be made only
once, so of two writers one sees the other's commit first; writes that depend on what they read then fail with Conflict if the
other one touched the same buckets, while plain upserts and deletes go in after it. A reader holds the files of one version.

The file system must rename without replacing in one step (HDFS and the like) or make hard links (local ones).
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.session import FEW_FILES, FILES

#: Commits between two whole states in the log, and delta files of a bucket from which compact() takes it up.
CHECKPOINT, DELTAS = 25, 4
OWN = ("_bucket", "_deleted", "_commit")


class Conflict(RuntimeError):
    """Another writer changed what this one depends on."""


def file_system(spark: SparkSession, folder: str):
    """Hadoop's file system of a folder, and its path."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def put_once(spark: SparkSession, target: str, text: str) -> bool:
    """Make a file with a text, whole from its first moment; False, and nothing changes, if it exists."""
    fs, path = file_system(spark, target)
    fs.mkdirs(path.getParent())
    jvm = spark.sparkContext._jvm
    draft = jvm.org.apache.hadoop.fs.Path(path.getParent(), f".{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":  # renaming would replace
            os.link(draft.toUri().getPath(), path.toUri().getPath())
        else:
            none = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
            where = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
            where.rename(draft, path, none)
        return True
    except FileExistsError:
        return False
    except Py4JJavaError as error:
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(draft, False)


def read_text(spark: SparkSession, target: str) -> str:
    fs, path = file_system(spark, target)
    stream = fs.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names(spark: SparkSession, folder: str) -> list[str]:
    """What lies in a folder, in order; nothing if there is none."""
    fs, path = file_system(spark, folder)
    return sorted(f.getPath().getName() for f in fs.listStatus(path)) if fs.exists(path) else []


class State:
    """One version: its number, the table's description, its files (path: bucket, whether base, sequence) and the last batch of each stream."""

    def __init__(self, version: int, about: dict, files: dict[str, tuple[int, bool, int]], batches: dict[str, int]) -> None:
        self.version, self.about, self.files, self.batches = version, about, files, batches

    def after(self, version: int, commit: dict) -> State:
        files = {p: f for p, f in self.files.items() if p not in set(commit["removed"])}
        files |= {p: (b, base, version if seq is None else seq) for p, b, base, seq in commit["added"]}
        return State(version, commit.get("about", self.about), files, self.batches | commit["batch"])

    def in_buckets(self, buckets: Iterable[int] | None) -> dict[str, tuple[int, bool, int]]:
        wanted = None if buckets is None else set(buckets)
        return {p: f for p, f in self.files.items() if wanted is None or f[0] in wanted}

    def dump(self) -> str:
        return json.dumps({"version": self.version, "about": self.about, "files": self.files, "batches": self.batches})

    @staticmethod
    def load(text: str) -> State:
        held = json.loads(text)
        return State(held["version"], held["about"], {p: tuple(f) for p, f in held["files"].items()}, held["batches"])


class KeyedTable:
    """Create one with create(), or open what is there with KeyedTable(spark, root)."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        about = self.state().about
        self.key, self.bucket_by, self.buckets = about["key"], about["bucket_by"], about["buckets"]
        self.direct, self.extra, self.codec = about.get("direct", False), about.get("extra", {}), about.get("codec")
        self.schema = T.StructType.fromJson(about["schema"])

    @staticmethod
    def create(spark: SparkSession, root: str, schema: T.StructType | str, key: list[str], buckets: int = 64, bucket_by: list[str] | None = None, keep: bool = False, direct: bool = False, extra: dict | None = None, codec: str | None = None) -> KeyedTable:
        """A new, empty table; Conflict if there is one, but with keep that one is opened. bucket_by: some of the key's columns, by which rows are looked up; direct: it is one column that is the bucket's number itself. extra: what its user keeps with it. codec: how its files are compressed; as the session says, if None."""
        fields = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
        by = bucket_by or key
        if set(OWN) & set(fields.names) or not set(by) <= set(key) <= set(fields.names):
            raise ValueError("bad columns")
        about = {"schema": json.loads(fields.json()), "key": key, "bucket_by": by, "buckets": buckets, "direct": direct, "extra": extra or {}, "codec": codec}
        first = {"added": [], "removed": [], "batch": {}, "touched": [], "about": about}
        if not put_once(spark, f"{root.rstrip('/')}/_log/{0:012d}.json", json.dumps(first)) and not keep:
            raise Conflict(f"{root} exists")
        return KeyedTable(spark, root)

    def recreate(self, buckets: int | None = None) -> KeyedTable:
        """The table without rows, as its next version; older versions can be read until vacuum()."""
        state = self.state()
        about = state.about | {"buckets": buckets or self.buckets}
        self._commit({"added": [], "removed": sorted(state.files), "batch": {}, "touched": list(range(self.buckets)), "about": about}, state, blind=False)
        return KeyedTable(self.spark, self.root)

    def drop(self) -> None:
        fs, path = file_system(self.spark, self.root)
        fs.delete(path, True)

    def _log(self, version: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.root}/_log/{version:012d}.json"))

    def state(self, version: int | None = None) -> State:
        """The last version, or that one."""
        found = names(self.spark, f"{self.root}/_log")
        numbers = [int(n[:12]) for n in found if n.endswith(".json") and n[0] != "." and (version is None or int(n[:12]) <= version)]
        if not numbers or (version is not None and numbers[-1] != version):
            raise FileNotFoundError(f"no table or no such version: {self.root}")
        whole = [n for n in found if n.endswith(".state") and n[0] != "." and int(n[:12]) <= numbers[-1]]
        state = State.load(read_text(self.spark, f"{self.root}/_log/{whole[-1]}")) if whole else State(-1, {}, {}, {})
        for n in range(state.version + 1, numbers[-1] + 1):
            state = state.after(n, self._log(n))
        return state

    def _commit(self, commit: dict, seen: State, blind: bool) -> int:
        """Add a commit after all others; the number of the version. seen: the version that the writer saw."""
        state = self.state()
        while True:
            for n in range(seen.version + 1, state.version + 1):
                other = self._log(n)
                if any(other["batch"].get(app, -1) >= batch for app, batch in commit["batch"].items()):
                    return n  # another attempt of this batch was first
                if "about" in other or (not blind and set(other["touched"]) & set(commit["touched"])):
                    raise Conflict(f"version {n} changed the same rows")
            if not set(commit["removed"]) <= set(state.files):
                raise Conflict("files were compacted by another writer")
            seen = state
            if put_once(self.spark, f"{self.root}/_log/{state.version + 1:012d}.json", json.dumps(commit)):
                made = state.after(state.version + 1, commit)
                if made.version % CHECKPOINT == 0:
                    put_once(self.spark, f"{self.root}/_log/{made.version:012d}.state", made.dump())
                return made.version
            state = self.state()

    def bucket(self) -> Column:
        return F.col(self.bucket_by[0]).cast("int") if self.direct else F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")

    def buckets_of(self, rows: DataFrame) -> list[int]:
        """The buckets of rows that have the columns of bucket_by; no more than the table has."""
        typed = rows.select(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in self.bucket_by))
        return sorted(r[0] for r in typed.select(self.bucket().alias("b")).distinct().collect())

    def _write(self, rows: DataFrame, base: bool, seq: int | None, stay: bool = False) -> list:
        """Write rows with their bucket as new files; what a commit adds. stay: each task writes its own rows, a file for each of its buckets; at most FILES tasks for each core, FEW_FILES for changes."""
        commit = uuid.uuid4().hex
        rows = rows.withColumn("_bucket", self.bucket())
        rows = rows if base else rows.withColumn("_commit", F.lit(commit))
        # rebalanced: small buckets share a task, and large ones are dealt over several, so that no task grows with the table
        dealt = rows.coalesce((FILES if base else FEW_FILES) * self.spark.sparkContext.defaultParallelism) if stay else rows.hint("rebalance", F.col("_bucket"))
        to = dealt.sortWithinPartitions("_bucket", *self.key).write.partitionBy("_bucket")
        (to.option("compression", self.codec) if self.codec else to).parquet(f"{self.root}/data/{commit}")
        fs, path = file_system(self.spark, f"{self.root}/data/{commit}")
        found, added = fs.listFiles(path, True), []
        while found.hasNext():
            file = found.next().getPath()
            folder = file.getParent().getName()
            if folder.startswith("_bucket="):
                added.append([f"data/{commit}/{folder}/{file.getName()}", int(folder[8:]), base, seq])
        return sorted(added)

    def _typed(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        return rows.select(*(F.col(c).cast(self.schema[c].dataType).alias(c) for c in columns))

    def _one(self, rows: DataFrame, order_by: str | None) -> DataFrame:
        """One row for each key: the largest by order_by, then by a hash of the whole row."""
        plain = [F.col(f"v.{f.name}") for f in self.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
        order = F.struct(*([F.col("o")] if order_by else []), F.xxhash64(*plain))
        held = rows.select(F.struct(*self.schema.names).alias("v"), *([F.col(order_by).alias("o")] if order_by else []))
        keys = [F.col(f"v.{k}").alias(f"_{i}") for i, k in enumerate(self.key)]
        return held.groupBy(*keys).agg(F.max_by("v", order).alias("v")).select("v.*")

    def upsert(self, rows: DataFrame, order_by: str | None = None, batch: tuple[str, int] | None = None, unique: bool = False, stay: bool = False) -> int:
        """Rows replace those of the same key or are added; only they are written. The number of the new version.

        Of rows with one key the last by order_by counts, ties go by a hash of the row. Null is a key like any other. Columns
        that the table lacks are ignored, missing ones are null. batch: a stream's id and the number of its batch; a batch
        that is there already changes nothing. unique: no two of the rows have the same key, so they needn't be compared. stay: as in overwrite().
        """
        state = self.state()
        if batch and state.batches.get(batch[0], -1) >= batch[1]:
            return state.version
        missing = [f for f in self.schema if f.name not in rows.columns]
        rows = rows.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}) if missing else rows
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema] + ([F.col(order_by).alias("_order")] if order_by else [])
        one = rows.select(*columns[: len(self.schema)]) if unique else self._one(rows.select(*columns), "_order" if order_by else None)
        added = self._write(one.withColumn("_deleted", F.lit(False)), False, None, stay)
        return self._commit(self._entry(added, batch), state, blind=True)

    def _entry(self, added: list, batch: tuple[str, int] | None = None, removed: Iterable[str] = ()) -> dict:
        return {"added": added, "removed": sorted(removed), "batch": dict([batch]) if batch else {}, "touched": sorted({a[1] for a in added})}

    def delete(self, keys: DataFrame, batch: tuple[str, int] | None = None) -> int:
        """Rows with these keys go; only the keys are written."""
        state = self.state()
        if batch and state.batches.get(batch[0], -1) >= batch[1]:
            return state.version
        gone = self._typed(keys, self.key).distinct()
        rest = {f.name: F.lit(None).cast(f.dataType) for f in self.schema if f.name not in self.key}
        added = self._write(gone.withColumns(rest | {"_deleted": F.lit(True)}).select(*self.schema.names, "_deleted"), False, None)
        return self._commit(self._entry(added, batch), state, blind=True)

    def merge(self, rows: DataFrame, set_columns: dict[str, Column], order_by: str | None = None, insert: bool = True) -> int:
        """An upsert whose columns may depend on old.* and new.* (old is null where the key is new); Conflict if another writer changed the same buckets meanwhile. insert: whether new keys are added."""
        state = self.state()
        missing = {f.name: F.lit(None).cast(f.dataType) for f in self.schema if f.name not in rows.columns}
        rows = rows.withColumns(missing) if missing else rows
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema] + ([F.col(order_by).alias("_order")] if order_by else [])
        new = self._one(rows.select(*columns), "_order" if order_by else None).alias("new")
        old = self.read(state=state, buckets=self.buckets_of(rows)).alias("old")
        same = reduce(Column.__and__, (F.col(f"old.{k}").eqNullSafe(F.col(f"new.{k}")) for k in self.key))
        made = new.join(old, same, "left" if insert else "inner").select(*(set_columns.get(c, F.col(f"new.{c}")).cast(self.schema[c].dataType).alias(c) for c in self.schema.names))
        added = self._write(made.withColumn("_deleted", F.lit(False)), False, None)
        return self._commit(self._entry(added), state, blind=False)

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None, state: State | None = None, where: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The rows of the last or a given version; buckets: only of these, whose files alone are read. where: a filter by columns of the key, which every file passes before rows are merged."""
        kept = where or (lambda rows: rows)
        state = state or self.state(version)
        files = state.in_buckets(buckets)
        changed = {b for b, base, _ in files.values() if not base}
        path = lambda chosen: [f"{self.root}/{p}" for p in sorted(chosen)]
        calm = path(p for p, (b, _, _) in files.items() if b not in changed)
        stirred = path(p for p, (b, base, _) in files.items() if base and b in changed)
        deltas = {p: seq for p, (b, base, seq) in files.items() if not base}
        out = kept(self._files(calm))
        if deltas:
            order = {p.split("/")[1]: seq for p, seq in deltas.items()}
            place = F.element_at(F.create_map(*(F.lit(x) for pair in sorted(order.items()) for x in pair)), F.col("_commit"))
            more = kept(self._files(path(deltas), T.StructType([*self.schema.fields, T.StructField("_deleted", T.BooleanType()), T.StructField("_commit", T.StringType())])))
            keys = [F.col(k).alias(f"_{i}") for i, k in enumerate(self.key)]
            last = more.groupBy(*keys).agg(F.max_by(F.struct(*self.schema.names, "_deleted"), place).alias("v")).select("v.*")
            if stirred:
                a, b = kept(self._files(stirred)).alias("a"), last.select(*self.key).alias("b")
                out = out.unionByName(a.join(b, reduce(Column.__and__, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.key)), "left_anti"))
            out = out.unionByName(last.filter(~F.col("_deleted")).drop("_deleted"))
        return out

    def _files(self, paths: list[str], schema: T.StructType | None = None) -> DataFrame:
        schema = schema or self.schema
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows that have the values of keys in the columns of bucket_by; only their buckets are read."""
        wanted = self._typed(keys, self.bucket_by).distinct()
        a, b = self.read(buckets=self.buckets_of(wanted)).alias("a"), wanted.alias("b")
        return a.join(b, reduce(Column.__and__, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in self.bucket_by)), "left_semi")

    def compact(self, deltas: int = DELTAS) -> int:
        """Buckets with so many delta files get base files of their own; upserts meanwhile aren't hurt. The number of the version."""
        state = self.state()
        many: dict[int, int] = {}
        for b, base, _ in state.files.values():
            many[b] = many.get(b, 0) + (not base)
        chosen = [b for b, n in many.items() if n >= max(1, deltas)]
        if not chosen:
            return state.version
        added = self._write(self.read(state=state, buckets=chosen), True, state.version)
        entry = self._entry(added, removed=state.in_buckets(chosen)) | {"touched": []}
        return self._commit(entry, state, blind=True)

    def overwrite(self, rows: DataFrame, state: State | None = None, buckets: int | None = None, extra: dict | None = None, stay: bool = False) -> int:
        """Rows, whose keys are unique, become the whole table. state: the version that they come from; Conflict if another writer changed anything since. buckets, extra: new ones, after which writers of the old ones get Conflict. stay: nothing is shuffled; for large rows of many tasks, since each task makes files of its own."""
        state = state or self.state()
        entry = {"touched": list(range(self.buckets))}
        self.buckets, self.extra = buckets or self.buckets, self.extra if extra is None else extra
        if buckets or extra is not None:
            entry["about"] = state.about | {"buckets": self.buckets, "extra": self.extra}
        added = self._write(self._typed(rows, self.schema.names), True, state.version, stay)
        return self._commit(self._entry(added, removed=state.files) | entry, state, blind=False)

    def vacuum(self, keep: int = 2) -> int:
        """Delete the files that none of the last versions has, and folders of writes that were never committed; not while others write. How many folders went."""
        last = self.state().version
        held = {p.split("/")[1] for v in range(max(0, last - keep + 1), last + 1) for p in self.state(v).files}
        gone = [c for c in names(self.spark, f"{self.root}/data") if c not in held]
        for c in gone:
            fs, path = file_system(self.spark, f"{self.root}/data/{c}")
            fs.delete(path, True)
        return len(gone)
