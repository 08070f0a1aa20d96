"""The keyed table against a dictionary."""

import random
import threading
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomwright.operators import keyed
from loomwright.operators.keyed import Conflict, KeyedTable

SCHEMA = "k string, n long, v string"


def content(table, **where):
    return sorted(((r.k, r.n, r.v) for r in table.read(**where).collect()), key=str)


def rows_of(spark, some):
    return spark.createDataFrame(some, SCHEMA)


def test_changes_equal_a_dictionary(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(keyed, "CHECKPOINT", 3)
    table = KeyedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ["k", "n"], buckets=5, bucket_by=["k"])
    rng, want, history = random.Random(4), {}, {}
    keys = [(k, n) for k in ("a", "b", None, "é", "") for n in (1, 2, None)]
    for step in range(9):
        some = rng.sample(keys, 6)
        if step % 4 == 3:
            version = table.delete(spark.createDataFrame(some * 2, "k string, n long"))
            [want.pop(k, None) for k in some]
        elif step % 4 == 2:
            version = table.merge(rows_of(spark, [(*k, "x") for k in some]), {"v": F.concat(F.coalesce("old.v", F.lit("new")), F.col("new.v"))})
            want |= {k: want.get(k, "new") + "x" for k in some}
        else:
            version = table.upsert(rows_of(spark, [(*k, f"{step}") for k in some]))
            want |= {k: f"{step}" for k in some}
        assert content(table) == sorted(((*k, v) for k, v in want.items()), key=str)
        history[version] = content(table)
        if step in (4, 7):
            table.compact(deltas=1)
            assert all(base for _, base, _ in table.state().files.values()) and content(table) == history[version]
    assert all(content(table, version=v) == rows for v, rows in history.items())
    assert content(KeyedTable(spark, f"file://{tmp_path}/t")) == history[version]
    looked = table.lookup(spark.createDataFrame([("é",), ("a",), ("nowhere",)], "k string"))
    assert sorted(map(str, looked.collect())) == sorted(str(r) for r in table.read().collect() if r.k in ("é", "a"))
    table.compact(deltas=1)
    last = content(table)
    table.vacuum(1)
    assert content(table) == last
    table.recreate(buckets=2)
    assert content(KeyedTable(spark, table.root)) == []
    table.drop()
    with pytest.raises(FileNotFoundError):
        KeyedTable(spark, table.root)


def test_repeated_keys_and_empty_changes(spark, tmp_path):
    table = KeyedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], buckets=4)
    assert content(table) == []
    table.upsert(rows_of(spark, [("a", i % 7, str(i)) for i in range(50)] + [("a", 6, "6")] * 50).withColumn("extra", F.lit(1)), order_by="n")
    assert len(content(table)) == 1 and content(table)[0][1] == 6
    table.upsert(rows_of(spark, []))
    table.delete(spark.createDataFrame([], "k string"))
    table.upsert(spark.createDataFrame([("b",)], "k string"))
    assert content(table)[1] == ("b", None, None)
    with pytest.raises(Conflict):
        KeyedTable.create(spark, table.root, SCHEMA, ["k"])
    with pytest.raises(ValueError):
        KeyedTable.create(spark, f"file://{tmp_path}/u", "k string, _commit string", ["k"])


def size(root: str) -> int:
    return sum(p.stat().st_size for p in Path(root.removeprefix("file://")).rglob("*.parquet"))


def test_a_small_change_writes_little_and_a_lookup_reads_little(spark, tmp_path):
    table = KeyedTable.create(spark, f"file://{tmp_path}/t", "id long, v string", ["id"], buckets=8)
    table.upsert(spark.range(100_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("v")))
    table.compact(deltas=1)
    table.vacuum(1)
    before = size(table.root)
    table.upsert(spark.range(0, 100_000, 100).select("id", F.sha2(F.lit("x"), 256).alias("v")))
    assert size(table.root) - before < 0.03 * before
    one = table.lookup(spark.createDataFrame([(5,)], "id long"))
    assert one.count() == 1 and len({f.split("_bucket=")[1].split("/")[0] for f in one.inputFiles()}) == 1
    assert table.read().filter("v = sha2('x', 256)").count() == 1000 and table.read().count() == 100_000


def test_of_two_writers_that_depend_on_the_same_rows_one_gets_a_conflict(spark, tmp_path, monkeypatch):
    table = KeyedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], buckets=2)
    table.upsert(rows_of(spark, [("a", 1, "x"), ("b", 1, "x")]))
    real, both, results = keyed.put_once, threading.Barrier(2), []
    first = threading.local()

    def at_once(spark, target, text):
        if not getattr(first, "done", False):
            first.done = True
            both.wait()
        return real(spark, target, text)

    def run(change):
        try:
            results.append(change(KeyedTable(spark, table.root)))
        except Conflict as error:
            results.append(error)

    def race(*changes):
        results.clear()
        threads = [threading.Thread(target=run, args=(c,)) for c in changes]
        [t.start() for t in threads]
        [t.join() for t in threads]

    monkeypatch.setattr(keyed, "put_once", at_once)
    add = lambda t: t.merge(rows_of(spark, [("a", 1, None)]), {"n": F.col("old.n") + F.col("new.n")})
    race(add, add)
    assert sorted(isinstance(r, Conflict) for r in results) == [False, True]
    assert content(table)[0] == ("a", 2, None)
    # plain upserts depend on nothing: both arrive
    race(lambda t: t.upsert(rows_of(spark, [("c", 1, "c")])), lambda t: t.upsert(rows_of(spark, [("d", 1, "d")])))
    assert sorted(results) == [3, 4] and [r[0] for r in content(table)] == ["a", "b", "c", "d"]
    # a reader holds the version that it began with, and compaction loses no upsert
    seen = table.read()
    race(lambda t: t.compact(deltas=1), lambda t: t.upsert(rows_of(spark, [("e", 1, "e")])))
    assert seen.count() == 4 and [r[0] for r in content(table)] == ["a", "b", "c", "d", "e"]


def test_batches_of_streams_count_once(spark, tmp_path):
    table = KeyedTable.create(spark, f"file://{tmp_path}/t", SCHEMA, ["k"], buckets=2)
    for name in ("one", "two"):
        for batch in (0, 0, 1, 0):
            table.upsert(rows_of(spark, [(f"{name}{batch}", batch, "v")]), batch=(name, batch))
    assert [r[0] for r in content(table)] == ["one0", "one1", "two0", "two1"] and table.state().version == 4
