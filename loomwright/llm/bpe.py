"""Fast ids of a byte-level BPE tokenizer: each distinct stretch of text is encoded once and then looked up.

The pattern that splits a text before any merge never lets a piece run on over a space that follows a character that
isn't white space. So a text may be cut before each such space, and the chunks' ids, one after the other, are the ids
of the whole text. Texts with two white-space characters of which the second is a space, and those that hold a special
token, are rare and encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache
from itertools import compress

import numpy as np
import pyarrow as pa

from loomwright.llm.chunks import SPACE, Chunks, gather, split

#: Chunks that a worker keeps, about 250 bytes each.
CHUNKS = 700_000
#: An array type of 32 bits.
_U4 = "I" if array("I").itemsize == 4 else "L"
#: Chunks that are encoded as one text.
JOINED = 256


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit numbers."""
    made = array(_U4, ids)
    if sys.byteorder == "big":
        made.byteswap()
    return made.tobytes()


class ChunkEncoder:
    """literal: special tokens' strings in a text are ordinary text."""

    def __init__(self, path: str, chunks: int = CHUNKS, literal: bool = False) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        special = [] if literal else [re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([f"[{SPACE}] ", *special])
        size = self.tokenizer.get_vocab_size()
        # whether an id's piece begins with the byte of a space, which this kind of tokenizer spells as U+0120
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "")[:1] == "Ġ" for i in range(size)])
        self.chunks = Chunks(self.encode_new, chunks)

    def whole(self, text: str) -> bytes:
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _ids(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the strings, and how many each has."""
        made = [np.array(e.ids, dtype=np.uint32) for at in range(0, len(strings), 4096) for e in self.tokenizer.encode_batch_fast(strings[at : at + 4096], add_special_tokens=False)]
        return np.concatenate([np.empty(0, np.uint32), *made]), np.fromiter(map(len, made), np.int64, len(made))

    def encode_new(self, strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the strings, and where each string's begin and how many it has.

        Strings that begin with a space and end in none are encoded JOINED at a time and told apart by their spaces.
        """
        joinable = np.fromiter((x[:1] == " " and not x[-1].isspace() for x in strings), bool, len(strings))
        some = list(compress(strings, joinable.tolist()))
        flat, _ = self._ids(["".join(some[k : k + JOINED]) for k in range(0, len(some), JOINED)])
        starts = np.nonzero(self.begins[flat])[0]
        sizes = np.diff(starts, append=len(flat))
        if len(starts) != len(some):
            flat, sizes = self._ids(some)
        more, rest = self._ids(list(compress(strings, (~joinable).tolist())))
        size = np.empty(len(strings), np.int64)
        size[joinable], size[~joinable] = sizes, rest
        start = np.empty(len(strings), np.int64)
        start[joinable], start[~joinable] = np.cumsum(sizes) - sizes, len(flat) + np.cumsum(rest) - rest
        return np.concatenate([flat, more]), start, size

    def arrays(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text after the other, and where each text's ids end; null and empty texts have none."""
        numbers, distinct, offsets = split(texts, self.odd)
        first = numbers[offsets[:-1]]
        heads, at_head = np.unique(first, return_inverse=True)
        names = distinct.to_pylist()
        # a head that is met without its space and a chunk with it are different keys
        known = self.chunks.numbers([" " + x for x in names] + [names[i] for i in heads.tolist()])
        keys = known[numbers]
        keys[offsets[:-1]] = known[len(names) + at_head]
        flat, ends = gather(self.chunks.start, self.chunks.size, self.chunks.flat, keys)
        ends = np.concatenate([[0], ends])[offsets[1:]]
        whole = self._odd(texts, offsets, names, first)
        if whole:
            parts, sizes, last = [], np.diff(ends, prepend=0), 0
            for i, ids in whole:
                parts += [flat[last : ends[i]], ids]
                sizes[i], last = len(ids), ends[i]
            flat, ends = np.concatenate([*parts, flat[last:]]), np.cumsum(sizes)
        return flat, ends

    def _odd(self, texts: pa.Array, offsets: np.ndarray, names: list[str], first: np.ndarray) -> list[tuple[int, np.ndarray]]:
        """(place, ids) of the texts that split() took for empty but that are not."""
        empty = np.array([not x for x in names])[first] & (np.diff(offsets) == 1) if len(first) else np.empty(0, bool)
        return [(i, np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)) for i in np.nonzero(empty)[0].tolist() if (text := texts[i].as_py())]

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; an empty text has none."""
        flat, ends = self.arrays(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
        raw = flat.astype("<u4", copy=False).tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]


@lru_cache(maxsize=4)
def encoder(path: str, chunks: int = CHUNKS, literal: bool = False) -> ChunkEncoder:
    return ChunkEncoder(path, chunks, literal)
