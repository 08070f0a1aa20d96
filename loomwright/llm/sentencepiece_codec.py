"""SentencePiece models on the tokenizers library.

The model's protobuf is parsed here; normaliser, metaspace marker, pieces with their scores and byte fallback are rebuilt.
Texts are cut before each run of spaces where no piece of the vocabulary crosses such a place, so that a worker
encodes each distinct chunk once, in multithreaded batches, and decodes it again with the rebuilt decoder. The ids of every
whole raw text, normaliser included, are held against the SentencePiece library's; a row says whether they are the same.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.chunks import Chunks, gather, runs, split

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Chunks that a worker keeps, about 250 bytes each, and threads of the tokenizers library.
KEPT_CHUNKS, THREADS = 500_000, "2"
#: Texts that are taken chunk by chunk in Python: those with the marker itself, or with spaces in front or in a row.
ODD = f"{MARK}|^ |  "


def wire(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protobuf message: numbers, or bytes of what has a length or is fixed."""
    at = 0

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    remove_extra: bool = True
    escape: bool = True

    @property
    def unknown(self) -> int:
        return next((i for i, p in enumerate(self.pieces) if p[2] == UNKNOWN), 0)


def parse(data: bytes) -> Spec:
    """The parts of a ModelProto that encoding needs."""
    spec = Spec()
    for key, value in wire(data):
        if key == 1:
            piece = {k: v for k, v in wire(value)}
            spec.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, bytes(4)))[0], piece.get(3, NORMAL)))
        elif key == 2:
            trainer = dict(wire(value))
            spec.kind, spec.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif key == 3:
            rules = dict(wire(value))
            spec.charsmap, spec.dummy_prefix, spec.remove_extra, spec.escape = rules.get(2, b""), bool(rules.get(3, 1)), bool(rules.get(4, 1)), bool(rules.get(5, 1))
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Every way to make a piece of two others, the pieces with the highest scores first."""
    rank = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
    usable = [(p, s) for p, s, t in spec.pieces if t in (NORMAL, USER)]
    found = [(-s, rank[p[:i]], rank[p[i:]], p[:i], p[i:]) for p, s in usable for i in range(1, len(p)) if p[:i] in rank and p[i:] in rank]
    return [(a, b) for *_, a, b in sorted(found)]


class Codec:
    def __init__(self, model: bytes) -> None:
        os.environ.setdefault("RAYON_NUM_THREADS", THREADS)
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        import sentencepiece
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        self.spec = spec = parse(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        unknown = spec.pieces[spec.unknown][0]
        if spec.kind == BPE:
            vocab = {p: i for i, (p, _, _) in enumerate(spec.pieces)}
            self.tool = Tokenizer(models.BPE(vocab, merges(spec), unk_token=unknown, fuse_unk=True, byte_fallback=spec.byte_fallback))
        else:
            self.tool = Tokenizer(models.Unigram([(p, s) for p, s, _ in spec.pieces], spec.unknown, spec.byte_fallback))
        steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
        if spec.remove_extra:
            steps += [normalizers.Replace(Regex(r"\A +| +\z"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        self.normaliser = normalizers.Sequence(steps) if steps else None
        self.tool.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.cuttable = spec.escape and not any(re.search(f"[^{MARK}]{MARK}", p) for p, _, t in spec.pieces if t in (NORMAL, USER))
        self.plain = self.cuttable and not steps and spec.dummy_prefix
        self.chunks, self.wrong = Chunks(self.encode_new, KEPT_CHUNKS), set()

    def normalised(self, text: str) -> str:
        """The text as pieces spell it, with the metaspace marker."""
        text = self.normaliser.normalize_str(text) if self.normaliser else text
        if not text:
            return ""
        text = (" " if self.spec.dummy_prefix else "") + text
        return text.replace(" ", MARK) if self.spec.escape else text

    def encode_new(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of the chunks of normalised text, and where those of each begin and how many it has; chunks that don't come back from the decoder are kept in `wrong`."""
        made = []
        for at in range(0, len(chunks), 4096):
            ids = [e.ids for e in self.tool.encode_batch_fast(chunks[at : at + 4096], add_special_tokens=False)]
            for chunk, text in zip(chunks[at : at + 4096], self.tool.decode_batch(ids, skip_special_tokens=False)):
                if text != chunk.replace(MARK, " "):
                    self.wrong.add(chunk)
            made += [np.array(x, dtype=np.uint32) for x in ids]
        size = np.fromiter(map(len, made), np.int64, len(made))
        return np.concatenate([np.empty(0, np.uint32), *made]), np.cumsum(size) - size, size

    def _forget(self) -> None:
        """Wrong chunks are few, but for a model that doesn't fit: then all is encoded anew from time to time."""
        if len(self.wrong) > KEPT_CHUNKS:
            self.chunks, self.wrong = Chunks(self.encode_new, KEPT_CHUNKS), set()

    def _cut(self, text: str) -> list[str]:
        """The chunks of a normalised text."""
        if not self.cuttable:
            return [text] if text else []
        starts = [0, *(m.end() for m in re.finditer(f"[^{MARK}](?={MARK})", text)), len(text)]
        return [text[a:b] for a, b in zip(starts, starts[1:]) if a < b]

    def _one(self, text: str) -> tuple[np.ndarray, bool]:
        cut = self._cut(self.normalised(text))
        distinct = list(dict.fromkeys(cut))
        at = dict(zip(distinct, self.chunks.numbers(distinct).tolist()))
        ids = gather(self.chunks.start, self.chunks.size, self.chunks.flat, np.fromiter(map(at.__getitem__, cut), np.int64, len(cut)))[0]
        return ids, self.wrong.isdisjoint(distinct)

    def rebuilt(self, texts: pa.Array) -> list[tuple[np.ndarray, bool]]:
        """Ids of each text by the rebuilt model, and whether its decoder makes the normalised text of them.

        A text's chunks are decoded one by one: each begins with a piece that is no byte, so nothing is decoded across two.
        """
        self._forget()
        if not self.plain:
            return [self._one(x or "") for x in texts.to_pylist()]
        numbers, distinct, offsets = split(texts, ODD)
        names = [MARK + x for x in distinct.to_pylist()]
        known = self.chunks.numbers(names)
        flat, ends = gather(self.chunks.start, self.chunks.size, self.chunks.flat, known[numbers])
        wrong = np.fromiter(map(self.wrong.__contains__, names), bool, len(names)) if self.wrong else np.zeros(len(names), bool)
        at_wrong = np.concatenate([[0], np.cumsum(wrong[numbers])])[offsets]
        bounds = np.concatenate([[0], ends])[offsets].tolist()
        # what split() took for empty is null, empty or odd
        single = np.diff(offsets) == 1
        empty = pc.equal(pc.binary_length(distinct), 0).to_numpy(zero_copy_only=False)[numbers[offsets[:-1]]] if len(single) else single
        rows = zip(bounds, bounds[1:], (single & empty).tolist(), (np.diff(at_wrong) == 0).tolist())
        return [(self._one(x) if (x := texts[i].as_py()) else (flat[:0], True)) if nothing else (flat[a:b], right) for i, (a, b, nothing, right) in enumerate(rows)]

    def encode(self, texts: pa.Array) -> tuple[list[bytes], list[bool], list[bool]]:
        """Little-endian unsigned 32-bit ids of each text, whether the library gives the same ids for the raw text, and whether they decode to the normalised text."""
        ids, same, back = [], [], []
        for (mine, right), theirs in zip(self.rebuilt(texts), self.library.encode([x or "" for x in texts.to_pylist()], num_threads=1)):
            same.append(np.array_equal(mine, np.array(theirs, dtype=np.uint32)))
            ids.append(mine.astype("<u4", copy=False).tobytes())
            back.append(right)
        return ids, same, back

    def decode(self, ids: bytes) -> str:
        """The text of ids, by the rebuilt decoder; the prefix that the normaliser adds is taken off."""
        text = self.tool.decode(np.frombuffer(ids, dtype="<u4").tolist(), skip_special_tokens=False)
        return text[1:] if self.spec.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=2)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def encode(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), parity, round_trip for each row of docs(doc_id, text).

    A null text is an empty one and has no ids. ids: the rebuilt model's. parity: the library gives the same for the whole raw
    text. round_trip: the rebuilt decoder makes the normalised text of the ids. Repeated rows and ids stay, a null doc_id
    stays null, an empty table gives an empty one, other columns are ignored.
    """

    def run(batches):
        codec = _codec(model)
        for part in runs(batches):
            ids, same, back = codec.encode(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array(same, pa.bool_()), pa.array(back, pa.bool_())], names=["doc_id", "ids", "parity", "round_trip"])

    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return two.mapInArrow(run, "doc_id long, ids binary, parity boolean, round_trip boolean")


def decode(rows: DataFrame, model: bytes) -> DataFrame:
    """doc_id, text of each row of rows(doc_id, ids); null ids give a null text."""

    def run(batches):
        for batch in batches:
            texts = [None if x is None else _codec(model).decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def digest(docs: DataFrame, model: bytes) -> DataFrame:
    """doc_id, n_ids, ids_crc32, parity, round_trip."""
    return encode(docs, model).select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), "parity", "round_trip")


