"""The paged service as a data source, and the stateful embedding stream."""

import json
import random
import time
from pathlib import Path

import pytest

from loomwright.operators.keyed import KeyedTable
from loomwright.sources import listing
from loomwright.streaming import embed, stateful


class Folder:
    """A service in a folder: pages and changes as files, calls as lines of a log."""

    def __init__(self, root):
        self.root = Path(root)

    def _call(self, what):
        with (self.root / "calls").open("a") as log:
            log.write(f"{time.time()} {what}\n")
        once, always = self.root / f"once-{what}", self.root / f"always-{what}"
        if always.exists():
            raise OSError(f"{what} is down")
        if once.exists():
            once.unlink()
            raise OSError("try again")

    def pages(self):
        self._call("pages")
        return len(list(self.root.glob("page-*.json")))

    def page(self, number):
        self._call(f"page-{number}")
        return json.loads((self.root / f"page-{number}.json").read_text())

    def key(self, item):
        return item["id"]

    def detail(self, key):
        self._call(f"detail-{key}")
        return {"more": key * 2}

    def latest(self):
        return int((self.root / "latest").read_text())

    def changes(self, after, upto):
        self._call("changes")
        return [(n, {"id": f"c{n}"}) for n in range(after + 1, upto + 1)]


def calls(root):
    return [line.split(" ") for line in (root / "calls").read_text().splitlines()] if (root / "calls").exists() else []


def test_all_pages_arrive_at_the_allowed_rate(spark, tmp_path):
    for n in range(1, 8):
        (tmp_path / f"page-{n}.json").write_text(json.dumps([{"id": f"i{n}-{j}", "é": "ü"} for j in range(n % 3)]))
    (tmp_path / "once-page-2").touch()
    (tmp_path / "always-page-5").touch()
    (tmp_path / "always-detail-i4-0").touch()
    listing.register(spark, "folder", Folder(tmp_path))
    found = spark.read.format("folder").option("tasks", 3).option("rate", 40).option("tries", 2).option("pause", 0.01).option("details", "true").load()
    assert found.rdd.getNumPartitions() == 3
    began = time.time()
    (tmp_path / "calls").unlink(missing_ok=True)
    rows = {(r.number, r.key): r for r in found.collect()}
    assert sorted(k for k in rows if k[1]) == [(n, f"i{n}-{j}") for n in range(1, 8) for j in range(n % 3) if n != 5]
    assert rows[5, None].error == "OSError: page-5 is down" and rows[5, None].item is None
    assert rows[4, "i4-0"].detail is None and "down" in rows[4, "i4-0"].error
    assert json.loads(rows[2, "i2-1"].item) == {"id": "i2-1", "é": "ü"} and json.loads(rows[2, "i2-1"].detail) == {"more": "i2-1i2-1"}
    at = sorted(float(t) for t, what in calls(tmp_path) if what != "pages")
    assert began < at[0] and len(at) >= 13 and all(sum(t <= u < t + 0.5 for u in at) <= 0.5 * 40 + 3 for t in at)


def test_spans_cover_all_numbers_once():
    for after, upto, tasks in ((0, 0, 3), (5, 6, 4), (0, 10, 3), (7, 100, 8)):
        made = listing.spans(after, upto, tasks)
        assert [n for s in made for n in range(s.after + 1, s.upto + 1)] == list(range(after + 1, upto + 1)) and len(made) <= tasks
    with pytest.raises(ValueError):
        listing.Limits.of({"tasks": "0"})


def test_a_stream_goes_on_without_gaps_or_repeats(spark, tmp_path):
    service = tmp_path / "service"
    service.mkdir()
    listing.register(spark, "changes", Folder(service))
    table = f"{tmp_path}/table"

    def run():
        q = spark.readStream.format("changes").option("tasks", 2).option("tries", 1).load().writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/cp").start(table)
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    for upto in (0, 3, 3, 10):
        (service / "latest").write_text(str(upto))
        if upto == 10:
            (service / "always-changes").touch()
            with pytest.raises(Exception):
                run()
            (service / "always-changes").unlink()
        run()
        got = [r.number for r in spark.read.schema(listing.SCHEMA).parquet(table).orderBy("number").collect()] if upto else []
        assert got == list(range(1, upto + 1))


def test_stateful_stream_equals_the_batch_through_failures(spark, tmp_path):
    rng = random.Random(2)
    plain, down = embed.hashing_encoder(8), tmp_path / "down"

    def encode(texts):
        if down.exists() and any("bad" in t for t in texts) or any("worse" in t for t in texts):
            raise OSError("no model")
        return plain(texts)

    vectors = KeyedTable.create(spark, f"file://{tmp_path}/vectors", "chunk_id string, point_id string, embedding array<float>", ["chunk_id"], buckets=2)
    failed = KeyedTable.create(spark, f"file://{tmp_path}/failed", "id string, hash string, version long", ["id"], buckets=2)
    newest, sent, schema = {}, [], "id string, version long, text string"

    def run(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/chunks")
        stream = spark.readStream.schema(schema).parquet(f"file://{tmp_path}/chunks")
        stateful.embed_changes(stream, vectors, f"file://{tmp_path}/run", encode, patience=0, tries=3, failed=failed).awaitTermination()
        sent.extend(rows)
        for i, version, text in rows:
            if i is not None and version is not None and (i not in newest or version > newest[i][0]):
                newest[i] = version, text

    down.touch()
    run([("a", 1, "one"), ("b", 1, "bad two"), ("c", 1, "three"), (None, 1, "x"), ("d", None, "x"), ("w", 1, "worse")])
    assert sorted(r.chunk_id for r in vectors.read().collect()) == ["a", "c"]
    down.unlink()
    run([("a", 3, "changed"), ("a", 2, "late"), ("c", 2, "three")] + sent[:1])  # b is sent again, c's text is the same
    for step in range(2):
        run([(f"k{rng.randrange(6)}", rng.randrange(20), rng.choice(["p", "q", "r s", None])) for _ in range(1)] + [("c", 5 + step, None if step == 0 else "back")])
    run([("a", 1, "late again")])
    want = {i: plain([t])[0] for i, (_, t) in newest.items() if t is not None and "worse" not in t}
    got = {r.chunk_id: r.embedding for r in vectors.read().collect()}
    assert set(got) == set(want) and all(abs(x - y) < 1e-6 for i in want for x, y in zip(want[i], got[i]))
    assert [r.id for r in failed.read().collect()] == ["w"]
