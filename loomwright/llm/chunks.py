"""Ids of texts put together from the ids of their chunks: each distinct chunk is encoded once while a worker keeps it.

Whole batches of texts are cut, numbered and put together by array operations, so that no step costs Python time for
each word; only the distinct chunks of a batch are looked up one by one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def release() -> None:
    """Give memory that is free but kept by the allocators back to the system: workers live on between tasks and share a container with the JVM."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


#: mallopt's numbers (malloc.h): the free memory at the heap's top from which it is given back, by how much more the heap grows, the size from which an array gets a mapping of its own.
TRIM_THRESHOLD, TOP_PAD, MMAP_THRESHOLD = -1, -2, -3


def keep_freed() -> bool:
    """Let the allocator keep freed memory until release(): else each large array of a loop is mapped anew, and the system clears its pages again at every step. Whether the allocator knows this."""
    option = getattr(ctypes.CDLL(None), "mallopt", None)
    return bool(option) and all([option(MMAP_THRESHOLD, 32 << 20), option(TRIM_THRESHOLD, 512 << 20), option(TOP_PAD, 32 << 20)])


def gather(start: np.ndarray, size: np.ndarray, flat: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches flat[start[k] : start[k] + size[k]] of all numbers k, one after the other, and where each ends."""
    n = size[numbers]
    ends = np.cumsum(n)
    at = np.repeat(start[numbers] - (ends - n), n)
    at += np.arange(len(at))
    return flat[at], ends


class Chunks:
    """Numbers and ids of chunks. encode: strings to all their ids, where those of each begin and how many each has.

    More than `most` chunks are never kept over: then those stay that were met again since the last time, and if these
    are more than half, none. What is dropped is encoded anew when it is met, so the results don't depend on `most`.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray, np.ndarray]], most: int) -> None:
        self.encode, self.most = encode, most
        self._keep([], np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32))

    def _keep(self, names: list[str], start: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        self.number = dict(zip(names, range(len(names))))
        self.start, self.size, self.flat, self.used = start, size, flat, np.zeros(len(names), bool)

    def _forget(self) -> None:
        stay = np.nonzero(self.used)[0]
        if 2 * len(stay) > self.most:
            stay = stay[:0]
            self.used[:] = False
        names = list(compress(self.number, self.used.tolist()))
        flat, _ = gather(self.start, self.size, self.flat, stay)
        size = self.size[stay]
        self._keep(names, np.cumsum(size) - size, size, flat)

    def numbers(self, distinct: list[str]) -> np.ndarray:
        """The number of each of these distinct chunks, for start, size and flat; valid until the next call."""
        if len(self.number) > self.most:
            self._forget()
        found = np.fromiter(map(self.number.get, distinct, repeat(-1)), np.int64, len(distinct))
        self.used[found[found >= 0]] = True
        new = np.nonzero(found < 0)[0]
        if len(new):
            names = [distinct[i] for i in new.tolist()]
            flat, start, size = self.encode(names)
            first = len(self.number)
            found[new] = np.arange(first, first + len(new))
            self.number.update(zip(names, range(first, first + len(new))))
            self.start = np.concatenate([self.start, len(self.flat) + start])
            self.size, self.flat = np.concatenate([self.size, size]), np.concatenate([self.flat, flat])
            self.used = np.concatenate([self.used, np.zeros(len(new), bool)])
        return found


def split(texts: pa.Array, odd: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Texts cut at every space: number by piece into the distinct pieces, these, and where each text's pieces begin (one more at the end).

    Texts that match `odd` and null ones count as empty, and so have one empty piece.
    """
    plain = pc.if_else(pc.fill_null(pc.match_substring_regex(texts, odd), True), "", texts)
    lists = pc.split_pattern(plain, " ")
    made = pc.dictionary_encode(lists.flatten())
    return made.indices.to_numpy(), made.dictionary, lists.offsets.to_numpy()


#: White space as regular expressions of Python and of the tokenizers know it.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: Texts are taken in runs of about so many bytes.
RUN_BYTES = 4_000_000


def runs(batches: Iterator[pa.RecordBatch], most: int = RUN_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of about `most` bytes of text, which is the second column; one row at least."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right")))
            yield batch.slice(at, end - at)
            at = end
