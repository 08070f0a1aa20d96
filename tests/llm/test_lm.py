"""The language model: slopes, probabilities, windows, and whole scores by brute force."""

import itertools
import platform
import subprocess
import sys
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest

from loomwright.llm import attention, lm

SF = "/root/testdata/sf0.01"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [(90_001, None), (90_002, ""), (90_003, "123 456 !!"), (None, "hello there you"), (90_004, "x" * 50_000), (90_005, "\n\n"), (90_001, None), (90_006, "a b <|endoftext|> É e  z")]


def layout(n=60, beginning=25, unmet=6):
    counts = np.random.default_rng(0).integers(1, 50, n).astype(float)
    counts[np.random.default_rng(1).permutation(n)[:unmet]] = 0
    return attention.layout(counts, np.arange(n) < beginning)


def weights(of, seed=5):
    """Weights with some of everything."""
    rng = np.random.default_rng(seed)
    return {k: v + rng.normal(size=v.shape).astype(np.float32) * 0.3 for k, v in attention.start(of).items()}


def naive(w, of, context):
    """log10 chances of all ids, and of a beginning, after a context of at most WINDOW ranks, in doubles and without batches."""
    w, d = {k: v.astype(np.float64) for k, v in w.items()}, attention.WIDTH
    x = np.array([w["e"][r] + w["p"][i] for i, r in enumerate(context)])
    q, k, v = np.split(x @ w["a"], 3, axis=1)
    a = np.exp(q[-1] @ k.T / np.sqrt(d))
    z = np.concatenate([x[-1], a @ v / a.sum()])
    h = np.maximum(z @ w["h"] + w["hb"], 0) + z
    cls = np.exp(h @ w["c"] + w["cb"])
    cls /= cls.sum()
    out = np.empty(len(of.weight))
    for c, (lo, hi) in enumerate(zip(of.first, of.first[1:])):
        m = np.exp(w["m"][lo:hi] @ h + w["mb"][lo:hi])
        out[lo:hi] = np.log10(cls[c] * m / m.sum())
    return (out - of.share)[of.rank], np.log10(cls[: of.beginning].sum())


def window_of(t):
    """Where the window begins that scores place t, by the rule."""
    return 0 if t < attention.WINDOW else ((t - attention.WINDOW) // attention.STRIDE + 1) * attention.STRIDE


def test_layout_keeps_kinds_apart_and_shares_out_unmet_ids():
    of = layout()
    begins = np.arange(60) < 25
    cls = np.searchsorted(of.first, of.rank, side="right") - 1
    assert ((cls < of.beginning) == begins).all()
    shared = np.bincount(of.rank)
    assert np.allclose(10**of.share, shared) and (shared > 1).sum() <= 2 and len(of.weight) == of.first[-1]
    start = attention.start(of)
    chance = 10 ** naive(start | {"m": start["m"] * 0, "c": start["c"] * 0}, of, [0])[0]
    assert np.allclose(chance, (of.weight / of.weight.sum() / shared)[of.rank])
    assert len(attention.layout(np.zeros(50_000), np.arange(50_000) < 9).weight) == 2
    assert len(attention.layout(np.ones(50_258), np.arange(50_258) % 2 == 0).weight) == 50_258


def test_slopes_are_those_of_differences():
    rng, of = np.random.default_rng(1), layout()
    w = {k: v.astype(np.float64) for k, v in weights(of).items()}
    n = len(of.weight)
    rows = np.concatenate([rng.integers(0, n, (3, attention.WINDOW)), rng.integers(0, n, (3, attention.WINDOW))], axis=1)
    rows[2, -4:] = -1
    _, g = attention.gradients(w, rows, of.first)
    for name in w:
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w[name].shape)
            if name == "e":
                at = (rows[0, rng.integers(0, 9)], at[1])
            where, slopes = g[name]
            row = at[0] if where is None else np.nonzero(where == at[0])[0][0] if at[0] in where else None
            mine = 0 if row is None else slopes[(row, *at[1:])]
            loss = []
            for step in (1e-5, -2e-5):
                w[name][at] += step
                loss.append(attention.gradients(w, rows, of.first)[0])
            w[name][at] += 1e-5
            up, down = loss
            assert abs((up - down) / 2e-5 - mine) < 1e-4 * max(1, abs(mine)), (name, at)


def test_scores_equal_brute_force_and_windows_score_each_token_once():
    of, rng = layout(), np.random.default_rng(3)
    w = weights(of)
    end = int(of.rank[3])
    texts = [rng.integers(0, 60, n) for n in (1, 2, 15, 16, 17, 28, 29, 90, 1)]
    found = attention.score_texts(attention.Scorer(w, of), of.rank[np.concatenate(texts)], np.cumsum([len(t) for t in texts]), end, size=5)
    at = 0
    for text in texts:
        padded = [end, *of.rank[text].tolist()]
        for t in range(len(text)):
            chances, begin = naive(w, of, padded[window_of(t) : t + 1])
            assert np.allclose([chances[text[t]], begin], found[:, at + t], atol=2e-4), (len(text), t)
        at += len(text)


def test_training_windows_hold_every_token_of_every_text_once():
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, 60, n) for n in (1, 15, 16, 17, 100, 2)]
    rows = attention.training_windows(np.concatenate(texts), np.cumsum([len(t) for t in texts]), 0)
    targets = rows[:, attention.WINDOW :]
    assert targets[targets >= 0].tolist() == np.concatenate(texts).tolist()
    assert len(rows) == sum(-(-len(t) // attention.WINDOW) for t in texts) and rows[0, 0] == 0
    assert rows[-2].tolist()[:3] == [texts[4][95], *texts[4][96:98]] and (attention.training_windows(np.empty(0, np.int64), np.empty(0, np.int64), 0)).shape == (0, 2 * attention.WINDOW)


def test_training_learns_what_follows_what():
    of = attention.layout(np.ones(12), np.arange(12) < 6)
    text = np.tile(of.rank[np.arange(12)], 4000)
    trainer = attention.Trainer(attention.start(of), of, 0.02)
    trainer.add(attention.training_windows(text, np.array([len(text)]), 0))
    trainer.flush()
    found = attention.score_texts(attention.Scorer(trainer.w, of), text[:500], np.array([500]), 0)
    assert found[0, 20:].mean() > -0.1


FAULTS = """
import resource, sys
import numpy as np
from loomwright.llm import attention, lm
if sys.argv[1] == "kept":
    lm.keep_freed()
rng = np.random.default_rng(0)
of = attention.layout(rng.integers(1, 50, 3000).astype(float), np.arange(3000) < 1500)
rows = rng.integers(0, 3000, (256, 2 * attention.WINDOW)).astype(np.int32)
trainer = attention.Trainer(attention.start(of), of, 0.01)
for n in (10, 30):
    before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    for _ in range(n):
        trainer.step(rows)
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before) / 30)
"""


@pytest.mark.skipif(platform.libc_ver()[0] != "glibc", reason="its allocator is meant")
def test_steps_of_training_map_no_memory_anew():
    """A step's arrays lie where those of the step before lay: their pages aren't given back and cleared again each time."""
    faults = {how: float(subprocess.run([sys.executable, "-c", FAULTS, how], capture_output=True, text=True, check=True).stdout) for how in ("kept", "default")}
    assert faults["kept"] < 50 and faults["kept"] < faults["default"] / 10, faults


@pytest.mark.parametrize("shift", [-200.0, -30.0, 0.0, 40.0, 70.0, 200.0])
def test_sums_of_exponentials_are_those_of_bounded_logits(shift):
    x = np.random.default_rng(2).normal(size=(50, 40)).astype(np.float32) * 8 + np.float32(shift)
    bounded = np.clip(x.astype(np.float64), -attention.BOUND, attention.BOUND)
    held = x.copy()
    total = attention._logsum(held)
    assert np.allclose(total, np.log(np.exp(bounded).sum(1)), atol=1e-5)
    assert np.allclose(held / np.exp(total)[:, None], np.exp(bounded) / np.exp(bounded).sum(1, keepdims=True), atol=1e-5)


@pytest.mark.parametrize("how", ["slopes", "scores"])
def test_exponentials_of_all_classes_are_summed_at_once(monkeypatch, how):
    """And not looked at class by class, which costs more than the sums themselves where a class has few targets."""
    rng, of, entered, kept = np.random.default_rng(6), layout(3000, 1500), [], np.errstate
    w = weights(of)
    rows = rng.integers(0, len(of.weight), (64, 2 * attention.WINDOW)).astype(np.int32)
    scorer = attention.Scorer(w, of)
    assert len(of.first) > 20
    monkeypatch.setattr(np, "errstate", lambda **options: entered.append(options) or kept(**options))
    if how == "slopes":
        attention.gradients(w, rows, of.first)
    else:
        scorer.log10(rows[:, : attention.WINDOW], rows[:, attention.WINDOW :])
    assert len(entered) == 1


def test_sums_over_several_arrays_are_bounded_like_one():
    rng = np.random.default_rng(7)
    parts = [rng.normal(size=(n, m)).astype(np.float32) + shift for n, m, shift in ((5, 9, 0), (1, 4, 200), (7, 12, -200))]
    groups = [attention._groups(x.shape[1] - 3, 3, 2, dtype=x.dtype) for x in parts]
    bounded = [np.exp(np.clip(x.astype(np.float64), -attention.BOUND, attention.BOUND)) for x in parts]
    whole = np.concatenate([np.stack([x[:, :-3].sum(1), x[:, -3:].sum(1), x[:, -3:-1].sum(1)], axis=1) for x in bounded])
    assert np.allclose(attention._sums(parts, groups) / whole, 1, rtol=1e-4)


@pytest.mark.parametrize("most", [0, 64])
def test_steps_are_those_of_adam_whether_rows_lie_together_or_not(monkeypatch, most):
    """Held against the usual form in doubles; rows without a slope in a step keep their state."""
    stretches = attention._stretches
    monkeypatch.setattr(attention, "_stretches", lambda at: stretches(at, most))
    rng, of = np.random.default_rng(8), layout(400, 150)
    w = {k: v.astype(np.float64) for k, v in weights(of).items()}
    trainer, m1, m2 = attention.Trainer(w, of, 0.02), {k: v * 0 for k, v in w.items()}, {k: v * 0 for k, v in w.items()}
    (b1, b2), partly = trainer.beta, 0
    for step in range(1, 6):
        rows = rng.integers(0, len(of.weight), (3, 2 * attention.WINDOW))
        rows[:, attention.WINDOW :] //= 5 + step
        for k, (at, x) in attention.gradients(w, rows, of.first)[1].items():
            at = np.arange(len(w[k])) if at is None else at
            partly += len(at) < len(w[k])
            m1[k][at] = b1 * m1[k][at] + (1 - b1) * x
            m2[k][at] = b2 * m2[k][at] + (1 - b2) * x**2
            w[k][at] -= 0.02 * m1[k][at] / (1 - b1**step) / (np.sqrt(m2[k][at] / (1 - b2**step)) + 1e-8)
        trainer.step(rows)
    assert partly and all(np.allclose(trainer.w[k], w[k], atol=1e-5) for k in w)


def test_stretches_hold_every_row_once():
    for at in ([], [4], [0, 1, 2, 7, 8, 11], [3, 5, 7]):
        for most in (1, 3, 64):
            found = attention._stretches(np.array(at, dtype=np.int64), most)
            table = np.arange(12)
            assert [x for own, _ in found for x in table[own].tolist()] == at == [x for _, part in found for x in at[part]]
            assert len(found) <= most


def test_strings_are_those_of_a_list():
    texts = pa.array(["a", "", "É", "x y", "\x00", "𝄞"])
    assert lm.strings(texts) == texts.to_pylist() and lm.strings(texts[:0]) == [] and lm.strings(texts[2:4]) == ["É", "x y"]


def test_chances_of_all_words_sum_to_one():
    """Words of at most 3 ids over 2 ids that begin a word and 2 that carry one on, and the end; what is missing is the chance of longer words."""
    of = attention.layout(np.array([5.0, 2, 3, 1, 4]), np.array([True, True, False, False, True]))
    begins, end = np.array([True, True, False, False, True]), 4
    scorer = attention.Scorer(weights(of), of)
    for before in ((), (0, 2, 3), (1, 0, 2, 2, 2)):
        total = longer = 0.0
        for n in (1, 2, 3):
            for word in itertools.product((0, 1), *[(2, 3)] * (n - 1)):
                ids = np.array([*before, *word, end])
                found = attention.score_texts(scorer, of.rank[ids], np.array([len(ids)]), int(of.rank[end]))
                chance = 10 ** lm.token_chances(found, begins[ids], ids == end)[-2]
                total += chance
                if n == 3:
                    over = 10 ** found[1, -1]
                    longer += chance / over * (1 - over)
        ids = np.array([*before, end])
        found = attention.score_texts(scorer, of.rank[ids], np.array([len(ids)]), int(of.rank[end]))
        total += 10 ** lm.token_chances(found, begins[ids], ids == end)[-1]
        assert abs(total + longer - 1) < 1e-4, before


def test_words_are_those_of_ascii_white_space():
    texts = [" A b\tC\x0b\x0cd\r\n", None, "", "É x  y", "\x1cz"]
    numbers, distinct, offsets = lm.words(pa.array(texts, pa.string()))
    found = [distinct[i].as_py() for i in numbers]
    for t, a, b in zip(texts, offsets, offsets[1:]):
        assert [x.encode() for x in found[a:b]] == (t or "").encode().lower().split()


@pytest.fixture(scope="module")
def scored(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(300)
    some = docs.unionByName(spark.createDataFrame(ODD, "doc_id long, text string")).selectExpr("*", "'x' as uid", "1.5 as score", "'y' as word", "3 as n", "true as held_out")
    kept = []
    found = lm.score(some, PATH, seen=lambda heads, model: kept.append(model)).toPandas()
    return some.toPandas(), found, kept[0]


def test_base_by_brute_force(scored):
    rows, found, _ = scored
    assert list(found.columns) == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"] and len(found) == len(rows)
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for t in rows.text]
    held = [not pd.isna(i) and zlib.crc32(str(int(i)).encode()) % 5 == 1 for i in rows.doc_id]
    c = Counter(w for ws, h, i in zip(tokens, held, rows.doc_id) if not h and not pd.isna(i) for w in ws)
    n, v = sum(c.values()), len(c)
    base = sorted(sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws) for ws in tokens)
    assert np.allclose(sorted(found.base_score), base) and (found.train_tokens == n).all()
    assert sorted(found.n_known) == sorted(sum(c[w] > 0 for w in ws) for ws in tokens)
    assert sorted(found.n_tokens) == sorted(map(len, tokens)) and found.held_out.sum() == sum(held)


def test_whole_score_by_brute_force(scored):
    rows, found, model = scored
    tool, end = lm.word_encoder(PATH).tokenizer, lm.end_id(PATH)
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for t in rows.text]
    learned = [not pd.isna(i) and zlib.crc32(str(int(i)).encode()) % 5 != 1 for i in rows.doc_id]
    c = Counter(w for ws, h in zip(tokens, learned) if h for w in ws)
    top = sum(c.values())
    assert len(c) <= lm.HOT
    short = [k for k, t in enumerate(tokens) if len(t) < 120][:25] + [k for k in range(300, len(rows)) if rows.doc_id[k] != 90_004]
    for k in short:
        ids, total = [int(model.layout.rank[end])], 0.0
        for w in tokens[k]:
            own = [end] if w == b"\n" else tool.encode(" " + w.decode(), add_special_tokens=False).ids
            chance = 0.0
            for i, one in enumerate(own):
                t = len(ids) - 1
                each, begin = naive(model.weights, model.layout, ids[window_of(t) : t + 1])
                chance += each[one] - (begin if i == 0 else 0)
                ids.append(int(model.layout.rank[one]))
            if w != b"\n":
                t = len(ids) - 1
                chance += naive(model.weights, model.layout, ids[window_of(t) : t + 1])[1]
            total += np.log10(lm.SHARE * c[w] / top + (1 - lm.SHARE) * 10**chance)
        same = found[found.doc_id.isna()] if pd.isna(rows.doc_id[k]) else found[found.doc_id == rows.doc_id[k]]
        assert np.allclose(same.score, total, rtol=1e-4, atol=2e-3), (k, same.score.tolist(), total)


def test_model_beats_the_base_on_held_out_texts(spark):
    found = lm.score(spark.read.parquet(f"{SF}/documents.parquet"), PATH).toPandas()
    held = found[found.held_out]
    assert held.score.sum() > held.base_score.sum() and (found.score < 0).all() and np.isfinite(found.score).all()


def test_without_training_and_without_rows(spark):
    found = lm.score(spark.createDataFrame([(None, "c d")], "doc_id long, text string"), PATH).first()
    assert (found.n_tokens, found.n_known, found.train_tokens, found.base_score) == (3, 0, 0, 3 * np.log10(1)) and found.score < 0
    assert lm.score(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_tail_words_are_joined_with_their_counts(spark, monkeypatch):
    """With two hot words, the base is that of all words, and only hot words have a share."""
    monkeypatch.setattr(lm, "HOT", 2)
    texts = ["a a a b b c", "b c d", "a e", "zz a a", None]
    docs = spark.createDataFrame(list(enumerate(texts, 100)), "doc_id long, text string")
    assert lm.hot_words(lm.word_counts(docs)) == {"\n": 5, "a": 6, "b": 3}
    found = lm.score(docs, PATH).toPandas().sort_values("doc_id")
    held = [zlib.crc32(str(i).encode()) % 5 == 1 for i in range(100, 105)]
    c = Counter(w for t, h in zip(texts, held) if not h for w in [*(t or "").split(), "\n"])
    n, v = sum(c.values()), len(c)
    assert np.allclose(found.base_score, [sum(np.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in [*(t or "").split(), "\n"]) for t in texts])
    assert found.n_known.tolist() == [sum(c[w] > 0 for w in [*(t or "").split(), "\n"]) for t in texts]
