"""Postings in blocks: what a run of texts holds of an entry is one row, so rows are far fewer than occurrences.

A run's entries, their texts and places are sorted together by array operations; only rows of blocks are shuffled and written. Places of
trigrams, one for each character, are packed: they count through all texts of a run put together and are kept as distances, seven bits a byte.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.session import materialise

#: Texts are taken in runs of about so many bytes, one text at least; ids up to this many are broadcast.
RUN_BYTES, BROADCAST = 4_000_000, 500_000
#: Added to places, from which a distance is taken.
BEFORE = 1 << 30

#: What is found in an array of texts: the code of each entry, the number of its text, its place there (both ascending), and the names of codes.
Found = tuple[np.ndarray, np.ndarray, np.ndarray, Callable[[np.ndarray], pa.Array]]


def once(rows: DataFrame) -> DataFrame:
    """rows(id, text) without repeated ones; ValueError if an id has unlike texts. Only ids and hashes are shuffled, and the rows that repeat."""
    h = F.xxhash64("text")
    again = rows.groupBy("id").agg(F.count("*").alias("n"), F.min(h).alias("low"), F.max(h).alias("high")).filter("n > 1")
    again = materialise(again.selectExpr("id", "low <> high AS unlike"), "repeated", small=True)
    if not again.filter("unlike").isEmpty():
        raise ValueError("an id has unlike texts")
    n = again.count()
    if not n:
        return rows
    ids = F.broadcast(again.select("id")) if n <= BROADCAST else again.select("id")
    return rows.join(ids, "id", "left_anti").unionByName(rows.join(ids, "id", "left_semi").dropDuplicates(["id"]))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches cut by the bytes of the texts, which are the second column."""
    for batch in batches:
        texts = batch.column(1)
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + RUN_BYTES, side="right")))
            yield batch.slice(at, end - at)
            at = end


def blocks(rows: DataFrame, find: Callable[[pa.RecordBatch], Found], id_type: str, parts: int, places: bool = True, about: str = "") -> DataFrame:
    """entry, part, block, docs, ids, counts, places: a row for each entry of a run of rows(id, text, ...), and one without an entry for the run.

    docs are numbers of texts within the run and ids their ids, counts how often each holds the entry, places where, one text after
    the other. The run's own row has all ids and, as `about` names them, further columns of rows as arrays.
    """
    write = uuid.uuid4().hex
    more = [x.split() for x in about.split(", ")] if about else []
    schema = f"entry string, part int, block long, docs array<int>, ids array<{id_type}>, counts array<int>, places array<int>" + "".join(f", {n} array<{t}>" for n, t in more)
    names = [x.split()[0] for x in schema.split(", ")]

    def one(values: pa.Array) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, part in enumerate(_runs(batches)):
            # the same in each attempt of a task
            block = int.from_bytes(hashlib.blake2b(f"{write} {task} {number}".encode(), digest_size=8).digest(), "little", signed=True)
            code, doc, at, naming = find(part)
            order = np.argsort(code, kind="stable")
            code, doc, at, n = code[order], doc[order], at[order], len(code)
            first = np.ones(n, bool)
            first[1:] = code[1:] != code[:-1]
            starts = np.nonzero(first)[0]
            first[1:] |= doc[1:] != doc[:-1]
            held = np.nonzero(first)[0]
            k = len(starts)
            ends = pa.array(np.append(np.searchsorted(held, starts), len(held)), pa.int32())
            lists = lambda values: pa.ListArray.from_arrays(ends, values)
            docs = doc[held]
            counts = lists(pa.array(np.diff(np.append(held, n)), pa.int32())) if places else pa.nulls(k, pa.list_(pa.int32()))
            where = pa.ListArray.from_arrays(pa.array(np.append(starts, n), pa.int32()), pa.array(at, pa.int32())) if places else pa.nulls(k, pa.list_(pa.int32()))
            ids, numbers = (pa.nulls(k, pa.list_(part.column(0).type)), lists(pa.array(docs, pa.int32()))) if more else (lists(part.column(0).take(pa.array(docs))), pa.nulls(k, pa.list_(pa.int32())))
            own = lambda v, size: pa.array([v] * size)
            if k:
                rest = [pa.nulls(k, pa.list_(part.schema.field(name).type)) for name, _ in more]
                yield pa.RecordBatch.from_arrays([naming(code[starts]), own(block % parts, k).cast(pa.int32()), own(block, k).cast(pa.int64()), numbers, ids, counts, where, *rest], names=names)
            if more:
                none = pa.nulls(1, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), own(block % parts, 1).cast(pa.int32()), own(block, 1).cast(pa.int64()), none, one(part.column(0)), none, none, *(one(part.column(name)) for name, _ in more)], names=names)

    return rows.mapInArrow(run, schema)


def of_lists(lists: pa.ListArray) -> Found:
    """The members of lists of strings."""
    made = pc.dictionary_encode(lists.flatten())
    size = np.diff(lists.offsets.to_numpy())
    doc = np.repeat(np.arange(len(lists)), size)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size)
    return made.indices.to_numpy(), doc, at, lambda codes: made.dictionary.take(pa.array(codes)).cast(pa.string())


def of_trigrams(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The runs of three characters, where the places of each begin, all places (ascending for each, counted through all texts put together), and the sizes of the texts."""
    held = ["" if t is None else t for t in texts.to_pylist()]
    size = np.fromiter(map(len, held), np.int64, len(held))
    points = np.frombuffer("".join(held).encode("utf-32-le"), "<u4")
    ends = np.cumsum(size)
    begins = np.ones(len(points), bool)
    for back in (1, 2):
        begins[ends[ends >= back] - back] = False
    place = np.nonzero(begins)[0]
    known = np.zeros(0x110000, bool)
    known[points] = True
    known = np.nonzero(known)[0]
    n, bits = max(1, len(known)), len(points).bit_length()
    dense = np.zeros(0x110000, np.int32)
    dense[known] = np.arange(len(known))
    char = dense[points]
    code = (char[place].astype(np.int64) * n + char[place + 1]) * n + char[place + 2]
    every = None
    if n**3 >= 1 << (63 - bits):  # more kinds of characters than a number has room for beside the place
        every, code = np.unique(code, return_inverse=True)
    # one sort of plain numbers: by entry, then by place
    code = np.sort(code << bits | place)
    place = code & ((1 << bits) - 1)
    code >>= bits
    starts = np.nonzero(np.diff(code, prepend=-1))[0]
    code = code[starts] if every is None else every[code[starts]]
    text = known[np.stack([code // (n * n), code // n % n, code % n], 1)].astype("<u4").tobytes().decode("utf-32-le") if len(code) else ""
    return pa.array([text[i : i + 3] for i in range(0, len(text), 3)], pa.string()), starts, place, size


def pack(starts: np.ndarray, places: np.ndarray) -> pa.Array:
    """Bytes for each list of ascending places: the first one, then distances, seven bits a byte, the lowest first, the eighth set if more follow."""
    gaps = np.diff(places, prepend=0)
    gaps[starts] = places[starts]
    width = np.ones(len(gaps), np.int8)
    more = [gaps >= 1 << 7 * i for i in range(1, 5)]
    for m in more:
        width += m
    ends = np.cumsum(width, dtype=np.int64)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    begins = ends - width
    for i, m in enumerate([None, *more]):
        at, left = (begins, gaps) if m is None else (begins[m] + i, gaps[m])
        if len(at):
            out[at] = (left >> 7 * i) & 127 | np.where(left >> 7 * (i + 1), 128, 0)
    bounds = pa.array(np.append(begins[starts], len(out)), pa.int32())
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, bounds.buffers()[1], pa.py_buffer(out)])


def unpack(packed: bytes) -> np.ndarray:
    """The places of one list."""
    held = np.frombuffer(packed, np.uint8)
    first = np.ones(len(held), bool)
    first[1:] = held[:-1] < 128
    starts = np.nonzero(first)[0]
    shift = 7 * (np.arange(len(held)) - starts[np.cumsum(first) - 1])
    return np.cumsum(np.add.reduceat((held & 127).astype(np.int64) << shift, starts)) if len(held) else np.empty(0, np.int64)


def trigram_blocks(rows: DataFrame, id_type: str, parts: int) -> DataFrame:
    """entry, part, block, ids, sizes, places: a row with packed places for each trigram of a run of rows(id, text), and one without an entry, with ids and sizes of the run's texts. Ids are unique."""
    write = uuid.uuid4().hex
    schema = f"entry string, part int, block long, ids array<{id_type}>, sizes array<int>, places binary"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _runs(batches):
            # by an id and not by the task, which may take several partitions, each from its first run
            block = int.from_bytes(hashlib.blake2b(f"{write} {part.column(0)[0].as_py()!r}".encode(), digest_size=8).digest(), "little", signed=True)
            entries, starts, places, size = of_trigrams(part.column(1))
            ids, k = part.column(0), len(entries) + 1
            # the last row is the run's own
            own = lambda values: pa.ListArray.from_arrays(pa.array([*[None] * (k - 1), 0, len(values)], pa.int32()), values)
            same = lambda v, kind: pa.array(np.full(k, v), kind)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([entries, pa.nulls(1, pa.string())]), same(block % parts, pa.int32()), same(block, pa.int64()), own(ids), own(pa.array(size, pa.int32())), pa.concat_arrays([pack(starts, places), pa.nulls(1, pa.binary())])], names=names
            )

    return rows.mapInArrow(run, schema)


class TrigramBlock:
    """The wanted trigrams of one block, and its texts."""

    def __init__(self, table: pa.Table) -> None:
        entries, places = table["entry"].to_pylist(), table["places"]
        self.row = {e: i for i, e in enumerate(entries) if e is not None}
        own = entries.index(None)
        self.ids = table["ids"][own].values
        self.ends = np.cumsum(table["sizes"][own].values.to_numpy(), dtype=np.int64)
        self.begins = np.append(0, self.ends[:-1])
        self.of = lambda entry: unpack(places[self.row[entry]].as_py())

    def texts(self, places: np.ndarray) -> np.ndarray:
        """Numbers of the texts where these places are."""
        return np.searchsorted(self.ends, places, side="right")

    def counts(self, wanted: list[str]) -> np.ndarray:
        """How many of these distinct trigrams each text holds."""
        n = np.zeros(len(self.ends), np.int64)
        for entry in wanted:
            if entry in self.row:
                n[np.unique(self.texts(self.of(entry)))] += 1
        return n

    def following(self, run: list[tuple[str, int]]) -> np.ndarray:
        """Numbers of the texts where the trigrams stand at these distances from one place; none if one of them is missing."""
        found = None
        for entry, distance in run:
            if entry not in self.row:
                return np.empty(0, np.int64)
            places = self.of(entry)
            here = places - distance
            here = here[here >= self.begins[self.texts(places)]]  # the place they are counted from is in the same text
            found = here if found is None else np.intersect1d(found, here, assume_unique=True)
        return np.unique(self.texts(found))


class Block:
    """The wanted entries of one block: which texts hold them, and where."""

    def __init__(self, table: pa.Table, texts: str) -> None:
        self.row = {e: i for i, e in enumerate(table["entry"].to_pylist()) if e is not None}
        lists = lambda name: table[name].combine_chunks()
        self.texts, self.counts, self.places = lists(texts), lists("counts"), lists("places")

    def of(self, entry: str) -> np.ndarray:
        return self.texts[self.row[entry]].values.to_numpy(zero_copy_only=False)

    def n(self, entry: str) -> np.ndarray:
        return self.counts[self.row[entry]].values.to_numpy()

    def following(self, run: list[tuple[str, int]], numbers: dict[str, np.ndarray]) -> np.ndarray:
        """Numbers of the texts where the entries stand at these distances from one place; numbers: those of each entry's texts."""
        found = None
        for entry, distance in run:
            here = (np.repeat(numbers[entry], self.n(entry)).astype(np.int64) << 32) + (self.places[self.row[entry]].values.to_numpy().astype(np.int64) - distance + BEFORE)
            found = here if found is None else np.intersect1d(found, here, assume_unique=True)
        return np.unique(found >> 32 if found is not None else np.empty(0, np.int64))
