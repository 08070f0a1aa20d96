"""The pipeline: each stage against plain loops on its own input, and the whole."""

import numpy as np
import pytest

import corpus_pipeline
from loomwright.llm import bpe, gam, langid
from tests.llm.test_brute_force import plain_bundle, plain_score
from tests.llm.test_copies import brute_groups
from tests.llm.test_packing import PATH, check

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with near copies, empty texts, repeated rows and rows without an id."""
    made = spark.read.parquet(f"{SF}/documents.parquet")
    rows = made.collect()
    long = next(r for r in rows if len((r.text or "").split()) > 150 and r.lang is not None)
    words = long.text.split()
    odd = [(80_001, " ".join([*words[:70], "edited", *words[71:]])), (80_002, long.text), (80_003, None), (80_004, ""), (80_005, "123 !!"), (None, long.text), (None, "the and that of"), (rows[0].doc_id, rows[0].text)]
    return made.union(spark.createDataFrame([(i, t, None, "odd", len(t or "")) for i, t in odd], made.schema))


def rows_of(df):
    return sorted((str(r.doc_id), r.text or "", str(r.lang)) for r in df.collect())


def test_quality_keeps_what_plain_loops_keep(spark, docs):
    model = gam.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = [r for r in docs.collect() if plain_score(model, gam.features(None if r.text is None else r.text.encode())) >= 0.5]
    kept = STAGE["quality"](spark, docs, SF)
    assert rows_of(kept) == sorted((str(r.doc_id), r.text or "", str(r.lang)) for r in want) and kept.columns == docs.columns
    assert 0 < len(want) < docs.count()


def test_language_keeps_what_plain_loops_keep(spark, docs):
    prototypes = langid.learn(langid.learned_split(docs))
    unit = {k: v / np.linalg.norm(v) for k, v in prototypes.items()}

    def stays(text):
        v = plain_bundle(text).astype(float)
        return v.any() and max(v @ u for u in unit.values()) / np.linalg.norm(v) >= langid.MIN_COSINE

    kept = STAGE["language"](spark, docs, SF)
    assert rows_of(kept) == sorted((str(r.doc_id), r.text or "", str(r.lang)) for r in docs.collect() if stays(r.text)) and kept.columns == docs.columns


def test_near_duplicates_keep_one_of_each_group(spark, docs):
    rows = docs.collect()
    groups = brute_groups([r.text for r in rows])
    want = []
    for g in set(groups):
        members = [r for r, k in zip(rows, groups) if k == g]
        named = [r for r in members if r.doc_id is not None]
        want.append(min(named, key=lambda r: r.doc_id) if named else members[0])
    kept = STAGE["near_duplicates"](spark, docs, SF)
    assert rows_of(kept) == sorted((str(r.doc_id), r.text or "", str(r.lang)) for r in want) and kept.columns == docs.columns
    assert len(want) < len(rows)


def test_packing_holds_every_id_of_every_document(spark, docs):
    named = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    tool = bpe.encoder(PATH).tokenizer
    found = [r.asDict() for r in STAGE["packing"](spark, named, SF).collect()]
    assert check(found, [(r.doc_id, [*tool.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in named.collect()], 2048) <= 1


def test_run_is_all_stages_and_an_empty_table_passes(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before, now = now, stage(spark, now, SF)
        if name != "packing":
            assert 0 < now.count() <= before.count()
    # how pieces fall into windows depends on how rows are dealt
    pieces = lambda df: sorted((r.doc_id, r.doc_tokens) for r in df.select("doc_id", "doc_tokens").distinct().collect())
    assert pieces(now) == pieces(corpus_pipeline.run(spark, SF))
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, SF)
        assert empty.count() == 0
