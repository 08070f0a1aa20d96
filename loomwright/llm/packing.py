"""Bounded-space online packing of tokenised documents into sequences of `window` tokens.

Each partition keeps a fixed number of open windows. A piece goes to the window that it fills best. If none has room
for it, the fullest window is filled up with the beginning of the piece and emitted, and the rest is placed again; so
every window that is emitted early is full. What is left in the open windows at a partition's end is bounded by their
number; the leftovers of MERGED partitions meet in one task, which cuts the emptiest windows to fill the fullest, so
that one sequence at most of each such group is not full.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.bpe import CHUNKS, encoder
from loomwright.llm.chunks import release, runs
from loomwright.session import materialise

WINDOW, OPEN, MERGED, END_ID = 2048, 64, 64, 1

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, open_window int, merge_group int"
_NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = dict(x.split() for x in SCHEMA.split(", "))
_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _NAMES]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[_TYPES[n]]) for n, c in zip(_NAMES, columns)], names=_NAMES)


class Packer:
    """pieces are (doc_id, start, ids, doc_tokens); emit() gets the pieces of each finished window."""

    def __init__(self, window: int = WINDOW, most_open: int = OPEN) -> None:
        self.window, self.most_open = window, most_open
        self.rooms: list[tuple[int, int]] = []  # (room left, window), ascending
        self.held: dict[int, list[tuple]] = {}
        self.next = 0
        self.done: list[list[tuple]] = []

    def add(self, doc_id: int | None, ids: bytes, doc_tokens: int) -> None:
        start, total = 0, len(ids) // 4
        while start < total:
            rest = total - start
            if rest >= self.window:
                take = self.window
                self.done.append([(doc_id, start, ids[4 * start : 4 * (start + take)], doc_tokens)])
            else:
                k = bisect_left(self.rooms, (rest, -1))
                if k < len(self.rooms):
                    room, w = self.rooms.pop(k)
                    take = rest
                elif len(self.rooms) < self.most_open:
                    room, w, take = self.window, self.next, rest
                    self.next += 1
                    self.held[w] = []
                else:
                    room, w = self.rooms.pop(0)
                    take = room
                self.held[w].append((doc_id, start, ids[4 * start : 4 * (start + take)], doc_tokens))
                if room == take:
                    self.done.append(self.held.pop(w))
                else:
                    insort(self.rooms, (room - take, w))
            start += take

    def leftovers(self) -> list[list[tuple]]:
        """The open windows, fullest first."""
        return [self.held[w] for _, w in self.rooms]


def merge_leftovers(windows: list[list[tuple]], window: int = WINDOW) -> list[list[tuple]]:
    """Sequences from part-filled windows: the emptiest are taken apart, their pieces cut to fill up the fullest."""
    size = lambda w: sum(len(p[2]) // 4 for p in w)
    order = sorted(windows, key=lambda w: -size(w))
    lo, hi = 0, len(order) - 1
    out = []
    while lo <= hi:
        now, room = list(order[lo]), window - size(order[lo])
        while room and hi > lo:
            doc_id, start, ids, total = order[hi][-1]
            n = len(ids) // 4
            if n <= room:
                now.append(order[hi].pop())
                room -= n
                if not order[hi]:
                    hi -= 1
            else:  # its tail, so that what stays keeps its start
                order[hi][-1] = (doc_id, start, ids[: 4 * (n - room)], total)
                now.append((doc_id, start + n - room, ids[4 * (n - room) :], total))
                room = 0
        out.append(now)
        lo += 1
    return out


def _rows(pieces: list[tuple], sequence: int, keep_ids: bool, open_window: int | None = None, group: int | None = None) -> list[tuple]:
    rows, offset = [], 0
    for doc_id, start, ids, total in pieces:
        n = len(ids) // 4
        rows.append((doc_id, start, n, zlib.crc32(ids), total, sequence, offset, ids if keep_ids else None, open_window, group))
        offset += n
    return rows


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, most_open: int = OPEN, keep_ids: bool = False, kept: int = CHUNKS) -> DataFrame:
    """One row for each piece of docs(doc_id, text): SCHEMA without the last two columns, without ids unless keep_ids.

    A document is the ids of its whole text and one END_ID; a null text is empty, so such a document is END_ID alone.
    Each id lies in exactly one piece. sequence_id is unique, offsets within a sequence have no gaps, and all sequences
    but one for each MERGED partitions are full. kept: chunks of text whose ids a worker remembers, about 250 bytes each;
    fewer take more time and less memory. Repeated rows are packed as often as they come; a null doc_id stays null.
    """

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tool = Packer(window, most_open), encoder(tokenizer, kept)
        part = TaskContext.get().partitionId()
        sequence, rows = part << 32, []
        end = END_ID.to_bytes(4, "little")
        for run in runs(batches):
            for doc_id, found in zip(run.column(0).to_pylist(), tool.encode(run.column(1))):
                packer.add(doc_id, found + end, len(found) // 4 + 1)
            for pieces in packer.done:
                rows += _rows(pieces, sequence, keep_ids)
                sequence += 1
            packer.done = []
            yield _batch(rows)
            rows = []
        for k, pieces in enumerate(packer.leftovers()):
            rows += _rows(pieces, 0, True, k, part // MERGED)
        # the parts' numbers tell apart windows of one group
        yield _batch([(*r[:8], part % MERGED * most_open + r[8], r[9]) for r in rows])
        release()

    def merged(table: pa.Table) -> pa.Table:
        held: dict[int, list[tuple]] = {}
        rows = sorted(zip(*(table[n].to_pylist() for n in ("open_window", "offset", "doc_id", "start", "ids", "doc_tokens"))), key=lambda r: r[:2])
        for w, _, *piece in rows:
            held.setdefault(w, []).append(tuple(piece))
        sequence = (1 << 61) + (table["merge_group"][0].as_py() << 32)
        out = [r for k, pieces in enumerate(merge_leftovers(list(held.values()), window)) for r in _rows(pieces, sequence + k, keep_ids)]
        return pa.Table.from_batches([_batch(out)])

    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    made = materialise(two.mapInArrow(partition, SCHEMA), "packed")
    rest = made.filter("open_window is not null").groupBy("merge_group").applyInArrow(merged, SCHEMA)
    return made.filter("open_window is null").union(rest).drop("open_window", "merge_group", *([] if keep_ids else ["ids"]))
