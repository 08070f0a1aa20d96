"""Packing: an exact round trip, fullness, and ids equal to the tokenizer's own."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomwright.llm import bpe, chunks, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(rows, docs, window):
    """docs: list of (doc_id, ids)."""
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    for doc_id, ids in docs:
        at = 0
        for r in sorted(pieces.pop(doc_id), key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["length"] > 0
            part = np.array(ids[at : at + r["length"]], dtype="<u4").tobytes()
            assert r["ids_crc32"] == zlib.crc32(part)
            at += r["length"]
        assert at == len(ids)
    assert not pieces
    short = 0
    for s in seqs.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= window
        short += at < window
    return short


def ids_of(text):
    return [*bpe.encoder(PATH).tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


def test_round_trip(spark):
    rng = random.Random(5)
    texts = [None, "", "é", "a\n\nb", " lead", "two  spaces\tand tab", "<|endoftext|> inside", "word " * 9000] + [" ".join(rng.choice(["alpha", "Beta.", "γάμμα", "1,234", "x\ny"]) for _ in range(rng.randrange(400))) for _ in range(120)]
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, start int").repartition(3, "doc_id")
    rows = [r.asDict() for r in packing.pack(df, PATH, window=64, most_open=4).collect()]
    assert check(rows, [(i, ids_of(t)) for i, t in enumerate(texts)], 64) <= 1


def test_few_and_no_rows(spark):
    schema = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], schema), PATH).count() == 0
    rows = packing.pack(spark.createDataFrame([(1, None), (1, None), (None, "a b")], schema), PATH, keep_ids=True).collect()
    assert sorted((str(r.doc_id), r.length) for r in rows) == [("1", 1), ("1", 1), ("None", len(ids_of("a b")))]
    assert all(zlib.crc32(r.ids) == r.ids_crc32 for r in rows)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 150), max_size=60), st.integers(2, 40), st.integers(1, 5))
def test_packer_keeps_every_id(sizes, window, most_open):
    packer = packing.Packer(window, most_open)
    for i, n in enumerate(sizes):
        packer.add(i, np.arange(n, dtype="<u4").tobytes(), n)
    assert len(packer.leftovers()) <= most_open
    assert all(sum(len(p[2]) for p in w) == 4 * window for w in packer.done)
    windows = packer.done + packing.merge_leftovers(packer.leftovers(), window)
    rows = [dict(zip(packing._NAMES, r)) for k, w in enumerate(windows) for r in packing._rows(w, k, False)]
    assert check(rows, [(i, list(range(n))) for i, n in enumerate(sizes)], window) <= 1


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abÉ .,!*\n\t  '1²\x1cー語")), max_size=40))
def test_chunk_ids_are_those_of_the_whole_text(text):
    tool = bpe.encoder(PATH)
    assert tool.encode([text])[0] == tool.whole(text)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab .\n")), max_size=20), st.just("x <|endoftext|> y")), max_size=12))
def test_ids_do_not_depend_on_what_is_kept_or_met_before(texts):
    small, large = bpe.ChunkEncoder.__new__(bpe.ChunkEncoder), bpe.encoder(PATH)
    small.__dict__ |= large.__dict__
    small.chunks = chunks.Chunks(small.encode_new, 3)
    for part in (texts, texts[::2], texts):
        assert small.encode(part) == large.encode(part) == [large.whole(x) if x else b"" for x in part]


def test_chunks_keep_what_is_met_again():
    met = []

    def encode(strings):
        met.extend(strings)
        return np.array([ord(x) for x in strings], np.uint32), np.arange(len(strings)), np.ones(len(strings), np.int64)

    kept = chunks.Chunks(encode, 3)
    kept.numbers(["a", "b", "c", "d"])
    kept.used[:] = [True, False, False, False]
    found = kept.numbers(["a", "z"])
    assert met == ["a", "b", "c", "d", "z"] and list(kept.number) == ["a", "z"]
    assert chunks.gather(kept.start, kept.size, kept.flat, found)[0].tolist() == [ord("a"), ord("z")]


@pytest.mark.parametrize("sf", ["0.001"])
def test_padding_is_small(spark, sf):
    rows = [r.asDict() for r in packing.pack(spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet"), PATH).collect()]
    docs = spark.read.parquet(f"/root/testdata/sf{sf}/documents.parquet").collect()
    assert check(rows, [(r.doc_id, ids_of(r.text)) for r in docs], 2048) <= 1
