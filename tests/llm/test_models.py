"""Classifiers and SentencePiece models: held-out accuracy, brute force and edge cases."""

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest

from loomwright.llm import gam, langid, sentencepiece_codec

SF = "/root/testdata/sf0.01"
MODEL = open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read()
ODD = [(90_001, None), (90_002, ""), (90_003, "123 456 !!"), (None, "hello there you"), (90_004, "x" * 50_000), (90_005, "\n\n"), (90_001, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def odd(spark, extra="lang string, score string, held_out int"):
    n = len(extra.split(","))
    return spark.createDataFrame([(i, t, *([None] * n)) for i, t in ODD], f"doc_id long, text string, {extra}")


def test_language_id(spark, docs):
    found = langid.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in found.doc_id]).all()
    held = found[found.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.98
    assert found.score.between(0, 1).all() and set(found.lang_pred) <= {"en", "fr", "de", "es", "und"}


def test_language_id_of_odd_rows(spark, docs):
    mixed = docs.select("doc_id", "text", "lang").limit(200).unionByName(odd(spark).select("doc_id", "text", "lang"))
    found = langid.identify(mixed).collect()
    assert len(found) == 207
    assert {r.doc_id: r.lang_pred for r in found if r.doc_id in (90_001, 90_002, 90_003, 90_005)} == dict.fromkeys((90_001, 90_002, 90_003, 90_005), "und")
    assert [r.held_out for r in found if r.doc_id is None] == [False]
    alone = langid.identify(odd(spark)).collect()
    assert all(r.lang_pred == "und" and r.score == 0 for r in alone)
    kept = langid.keep_identified(mixed)
    assert kept.columns == mixed.columns and 90_003 not in [r.doc_id for r in kept.collect()]
    assert langid.identify(odd(spark).limit(0)).count() == 0


def test_bundles_are_sums_of_bound_letters():
    first, second, third = langid._letter_vectors()
    v = langid.bundle("ab ")
    a, b = 1, 2
    want = first[0].astype(int) * second[a] * third[b] + first[a].astype(int) * second[b] * third[0]
    assert (v == want).all() and langid.bundle("1 2") is None


def test_quality(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    found = gam.classify(docs, labels).toPandas().merge(labels.toPandas(), on="doc_id")
    held = found[found.held_out]
    assert (held.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in held.doc_id]).all()
    assert (held.predicted == held.quality).mean() > 0.95
    assert ((found.score >= 0.5).astype(int) == found.predicted).all()


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, None), (2, None, 0), (None, 0, 1)], "doc_id long, quality int, toxic int")
    found = gam.classify(odd(spark), labels).collect()
    assert len(found) == len(ODD) and all(r.score == 0.5 and r.predicted == 1 for r in found)
    assert gam.classify(odd(spark).limit(0), labels).count() == 0
    assert gam.keep_good(odd(spark), labels).count() == len(ODD)


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.uniform(-1, 1, (4000, len(gam.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = gam.fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs and ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95
    one = gam.fit(x[:5], np.ones(5))
    assert (one.score(x) > 0.5).all()


def test_sentencepiece_is_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_proto=MODEL)
    texts = [t for _, t in ODD] + [" x ", "▁a ▁▁b", "日本語\n\n x", "a\tb   c    d", "𝔘 \x00 é", "word " * 3000]
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id: r for r in sentencepiece_codec.encode(df, MODEL).collect()}
    for i, t in enumerate(texts):
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == library.encode(t or "") and rows[i].parity, repr(t)
    back = {r.doc_id: r.text for r in sentencepiece_codec.decode(sentencepiece_codec.encode(df, MODEL), MODEL).collect()}
    assert all(back[i] == library.decode(library.encode(t or "")) for i, t in enumerate(texts))
    assert all(rows[i].round_trip for i, t in enumerate(texts) if "▁" not in (t or ""))


def test_pieces_with_scores_become_a_unigram_model():
    def number(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def message(*fields):
        return b"".join(number(k << 3 | 2) + number(len(v)) + v if isinstance(v, bytes) else number(k << 3 | 5) + np.float32(v).tobytes() if isinstance(v, float) else number(k << 3) + number(v) for k, v in fields)

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3), ("▁", -2.0, 1), ("a", -2.0, 1), ("b", -2.0, 1), ("▁a", -1.5, 1), ("ab", -1.0, 1), ("▁ab", -1.2, 1)]
    model = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces) + message((2, message((3, 1)))) + message((3, message((1, b"identity"), (3, 1), (4, 1), (5, 1))))
    codec = sentencepiece_codec.Codec(model)
    assert codec.spec.kind == sentencepiece_codec.UNIGRAM
    # without a character map a line break is no space: it stays in front, and only spaces are stripped
    texts = ["ab a", "a  b ab", "", "aab", " b", "\na", " \n a ", "\t\ta  \u00a0", None]
    ids, same, back = codec.encode(pa.array(texts, pa.string()))
    for text, found, mine, equal in zip(texts, ids, codec.rebuilt(pa.array(texts, pa.string())), same):
        assert equal and np.frombuffer(found, "<u4").tolist() == codec.library.encode(text or "") == mine[0].tolist(), text
    assert codec.encode(pa.array([], pa.string())) == ([], [], [])


def test_parity_sees_a_wrong_normaliser():
    from tokenizers import normalizers

    codec = sentencepiece_codec.Codec(MODEL)
    codec.normaliser, codec.plain = normalizers.Lowercase(), False
    ids, same, _ = codec.encode(pa.array(["a b", "A b"]))
    assert same == [True, False] and np.frombuffer(ids[1], "<u4").tolist() == codec.library.encode("a b")


def test_a_broken_merge_table_changes_ids_and_parity(monkeypatch):
    whole = sentencepiece_codec.merges
    texts = pa.array(["the house of the king", "I", "", None, "naïve 日本"])
    right, same, back = sentencepiece_codec.Codec(MODEL).encode(texts)
    assert same == [True] * 5 == back
    monkeypatch.setattr(sentencepiece_codec, "merges", lambda spec: whole(spec)[: len(whole(spec)) // 50])
    codec = sentencepiece_codec.Codec(MODEL)
    ids, same, back = codec.encode(texts)
    assert ids[0] != right[0] and same[0] is False and same[2:4] == [True, True] and back == [True] * 5
    assert codec.decode(ids[0]) == "the house of the king"


def test_a_broken_decoder_is_seen():
    from tokenizers import decoders

    codec = sentencepiece_codec.Codec(MODEL)
    codec.tool.decoder = decoders.Sequence([decoders.Replace("t", "d"), decoders.Replace(sentencepiece_codec.MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
    _, same, back = codec.encode(pa.array(["a b", "the b", "  the  b", "", None]))
    assert same == [True] * 5 and back == [True, False, False, True, True]


def test_sentencepiece_digest_of_odd_tables(spark):
    schema = "doc_id long, text string, ids string"
    assert sentencepiece_codec.digest(spark.createDataFrame([], schema), MODEL).count() == 0
    texts = ["two words", "two words", "other", None, ""]
    rows = sentencepiece_codec.digest(spark.createDataFrame([(None if i == 2 else 7, x, "x") for i, x in enumerate(texts)], schema), MODEL).collect()
    codec = sentencepiece_codec.Codec(MODEL)
    want = [(None if i == 2 else 7, len(e := codec.library.encode(x or "")), zlib.crc32(np.array(e, "<u4").tobytes()), True, True) for i, x in enumerate(texts)]
    assert sorted(map(str, (tuple(r) for r in rows))) == sorted(map(str, want))
