"""Scores of whole texts by a language model that the corpus itself trains.

Tokens are lower-case words and one end. Counts of all training tokens give the base, a smoothed unigram score. The model
is the self-attention model of attention.py over subword ids, mixed word by word with the frequencies of the HOT most
frequent words: P(word) = SHARE * frequency + (1 - SHARE) * P_attention(word). P_attention(word) is the chance of its first id
among ids that begin a word, of its further ids, and that the word then ends; so the chances of all words and the end sum to
1 at most, and a text's score is the log10 of a probability over texts.

Texts are tokenised once; ids are kept in the shared folder. Training is data-parallel: every training text is cut into
consecutive windows, each id is a target once, tasks train copies of the weights on what they read, without any shuffle of
texts, and Spark averages the weights between rounds. Counts of the HOT words are broadcast (at most HOT words of MAX_WORD
bytes); what a document holds of other words is counted within the document and joined with their counts by a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm import attention
from loomwright.llm.bpe import ChunkEncoder, encoder
from loomwright.llm.chunks import gather, keep_freed, release, runs
from loomwright.session import materialise

#: The share of the frequencies in a word's chance.
SHARE = 0.2
HOT, MAX_WORD = 200_000, 128
#: Rounds of training, each on texts of its own; ids that a task of a round trains on at least, if there are so many; the first rate.
ROUNDS, TASK_IDS, RATE = 4, 1_600_000, 0.03
#: Weights in a row that is averaged, and the groups that average first.
BLOCK, SALTS = 8192, 64
#: Chunks that a worker keeps, and ids that are scored at once.
KEPT, SCORED_IDS = 300_000, 250_000
#: The end among words.
END = "\n"


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from learning; a null id is neither learned from nor held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 1, F.lit(False))


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """All words: number by word into the distinct words, these, and where each text's words begin (one more at the end)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    each = lists.flatten()
    some = pc.greater(pc.binary_length(each), 0)
    before = np.concatenate([[0], np.cumsum(some.to_numpy(zero_copy_only=False))])
    made = pc.dictionary_encode(each.filter(some))
    return made.indices.to_numpy(), made.dictionary, before[lists.offsets.to_numpy()]


def strings(texts: pa.Array) -> list[str]:
    """As to_pylist() of strings without nulls, in a seventh of its time."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for run in runs(batch.select([0, 0]) for batch in batches):
        numbers, distinct, _ = words(run.column(1))
        n = np.bincount(numbers, minlength=len(distinct))
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([distinct, pa.array([END])]), pa.array([*n.tolist(), run.num_rows], pa.int64())], names=["word", "n"])


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens of texts(text), the end included."""
    return texts.select(F.col("text").cast("string").alias("text")).mapInArrow(_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_encoder(tokenizer: str) -> ChunkEncoder:
    return encoder(tokenizer, KEPT, literal=True)


def end_id(tokenizer: str) -> int:
    """The end's id: one more than the tokenizer's last."""
    return word_encoder(tokenizer).tokenizer.get_vocab_size()


def id_type(tokenizer: str) -> np.dtype:
    return np.dtype("<u2" if end_id(tokenizer) < 1 << 16 else "<u4")


_TOKENS = "uid long, doc_id long, n_tokens long, n_known long, base double, ids binary, shares binary, word string, n long"
_NAMES = [x.split()[0] for x in _TOKENS.split(", ")]


def _slices(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The stretches of data that end there, as binary values."""
    raw, size = data.tobytes(), data.itemsize
    return pa.array([raw[size * a : size * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())], pa.binary())


def tokenised(docs: DataFrame, tokenizer: str, hot: dict[str, int], n_train: int, distinct_train: int) -> DataFrame:
    """_TOKENS: one row for each row of docs(doc_id, text), with its ids, the frequency of each token among the hot ones (32-bit floats), and base and n_known over its hot tokens.

    And one row for each of its words that isn't hot, (uid, word, n: how often).
    """
    held = docs.sparkSession.sparkContext.broadcast(hot)
    total = max(1, sum(hot.values()))
    size = math.log10(n_train + 0.5 * (distinct_train + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        get, tool, kind = held.value.get, word_encoder(tokenizer), id_type(tokenizer)
        end, end_n = end_id(tokenizer), held.value.get(END, -1)
        uid = TaskContext.get().partitionId() << 33
        for part in runs(batches):
            numbers, distinct, offsets = words(part.column(1))
            names, k = strings(distinct), part.num_rows
            counts = np.fromiter(map(get, names, repeat(-1)), np.int64, len(names))
            known = tool.chunks.numbers(strings(pc.binary_join_element_wise("", distinct, " ")))
            flat, ends = gather(tool.chunks.start, tool.chunks.size, tool.chunks.flat, known[numbers])
            id_ends = np.concatenate([[0], ends])[offsets[1:]]
            ids = np.insert(flat.astype(kind), id_ends, end)
            n = np.insert(counts[numbers], offsets[1:], end_n)
            heads = offsets[:-1] + np.arange(k)
            tokens = np.diff(offsets) + 1
            base = np.where(n >= 0, np.log10(np.maximum(n, 0) + 0.5) - size, 0)
            shares = (np.maximum(n, 0) / total).astype("<f4")
            sums = [np.add.reduceat(x, heads) for x in ((n > 0).astype(np.int64), base)]
            uids = np.arange(uid, uid + k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(uids), part.column(0), pa.array(tokens.astype(np.int64)), *map(pa.array, sums), _slices(ids, id_ends + np.arange(1, k + 1)), _slices(shares, heads + tokens), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64())], names=_NAMES
            )
            rest = counts[numbers] < 0
            pair, many = np.unique(np.repeat(np.arange(k), np.diff(offsets))[rest] * np.int64(max(1, len(names))) + numbers[rest], return_counts=True)
            none = [pa.nulls(len(pair), t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(uids[pair // max(1, len(names))]), *none, distinct.take(pa.array(pair % max(1, len(names)))), pa.array(many.astype(np.int64))], names=_NAMES)
            uid += k
        release()

    two = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return two.mapInArrow(run, _TOKENS)


def _texts(batches: Iterator[pa.RecordBatch], place: int, kind: np.dtype, most: int = SCORED_IDS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Runs of rows of about `most` ids, one at least, with the ids of all texts in a row and where each ends; the ids are the column at `place`."""
    for batch in batches:
        for part in runs([batch.select([place, place])], most * kind.itemsize):
            offset = part.column(1).offset - batch.column(place).offset
            raw = part.column(1).to_pylist()
            yield batch.slice(offset, part.num_rows), np.frombuffer(b"".join(raw), kind), np.cumsum([len(x) // kind.itemsize for x in raw])


def id_counts(tokens: DataFrame, size: int, kind: np.dtype) -> np.ndarray:
    """How often each id below size stands in tokens(ids); only so many numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(size, dtype=np.int64)
        for _, ids, _ in _texts(batches, 0, kind):
            found += np.bincount(ids, minlength=size)
        some = np.nonzero(found)[0]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(found[some], pa.int64())], names=["id", "n"])

    out = np.zeros(size)
    for i, n in tokens.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas().itertuples(index=False):
        out[i] = n
    return out


@dataclass
class Model:
    weights: attention.Weights
    layout: attention.Layout
    end: int
    kind: np.dtype
    share: float


def _mean(table: pa.Table) -> pa.Table:
    """One row for all rows (block, task, n, value): the mean of their values weighted by n."""
    order = np.argsort(table["task"].to_numpy(), kind="stable")
    n = table["n"].to_numpy().astype(np.float64)
    values = table["value"].to_pylist()
    total = sum(np.frombuffer(values[i], "<f8") * n[i] for i in order.tolist()) / n.sum()
    return pa.table({"block": table["block"][:1], "task": pa.array([int(table["task"].to_numpy().min())], pa.int32()), "n": pa.array([int(n.sum())], pa.int64()), "value": pa.array([total.astype("<f8").tobytes()], pa.binary())})


def fit(tokens: DataFrame, size: int, begins: np.ndarray, kind: np.dtype) -> Model:
    """A model of tokens(uid, ids): each id of each text is a target once."""
    counts = id_counts(tokens, size, kind)
    of = attention.layout(counts, begins)
    weights = attention.start(of)
    names, end, spark = list(weights), size - 1, tokens.sparkSession
    few = max(1, int(counts.sum()) // (ROUNDS * TASK_IDS))
    dealt = tokens.withColumn("round", F.pmod(F.xxhash64("uid"), F.lit(ROUNDS)))
    schema = "block int, task int, n long, value binary"
    for r in range(ROUNDS):
        held = spark.sparkContext.broadcast(weights)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keep_freed()
            trainer = attention.Trainer(held.value, of, RATE / (1 + r), seed=17 + r)
            for _, ids, ends in _texts(batches, 0, kind):
                trainer.add(attention.training_windows(of.rank[ids], ends, int(of.rank[end])))
            trainer.flush()
            if trainer.seen:
                flat = np.concatenate([trainer.w[n].ravel() for n in names]).astype("<f8")
                blocks = [flat[at : at + BLOCK].tobytes() for at in range(0, len(flat), BLOCK)]
                k, task = len(blocks), TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array([task] * k, pa.int32()), pa.array([trainer.seen] * k, pa.int64()), pa.array(blocks, pa.binary())], names=["block", "task", "n", "value"])
            release()

        made = dealt.filter(F.col("round") == r).select("ids").coalesce(few).mapInArrow(run, schema)
        first = made.groupBy("block", F.pmod("task", F.lit(SALTS)).alias("salt")).applyInArrow(_mean, schema)
        found = first.groupBy("block").applyInArrow(_mean, schema).orderBy("block").toArrow()
        held.unpersist()
        if found.num_rows:
            flat, at = np.frombuffer(b"".join(found["value"].to_pylist()), "<f8").astype(np.float32), 0
            new = {}
            for n in names:
                new[n] = flat[at : at + weights[n].size].reshape(weights[n].shape)
                at += weights[n].size
            weights = new
    return Model(weights, of, end, kind, SHARE if counts.any() else 0.0)


def token_chances(found: np.ndarray, begins: np.ndarray, is_end: np.ndarray) -> np.ndarray:
    """log10 of P_attention of each word and each end, from the two rows of attention.score_texts(); begins, is_end: of each id."""
    starts = np.nonzero(begins)[0]
    own, begin = found.astype(np.float64)
    total = np.add.reduceat(own - begin * begins, starts)
    # a word has ended where the next token begins
    return total + np.where(is_end[starts], 0, begin[np.minimum(np.append(starts[1:], len(own)), len(own) - 1)])


def scored(tokens: DataFrame, model: Model, begins: np.ndarray) -> DataFrame:
    """uid, doc_id, n_tokens, n_known, base, score of each row of tokens(_TOKENS without the last two columns)."""
    held = tokens.sparkSession.sparkContext.broadcast(model)
    kept = ["uid", "doc_id", "n_tokens", "n_known", "base"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed()
        m = held.value
        scorer = attention.Scorer(m.weights, m.layout)
        for part, ids, ends in _texts(batches, 5, m.kind):
            found = attention.score_texts(scorer, m.layout.rank[ids], ends, int(m.layout.rank[m.end]))
            chance = token_chances(found, begins[ids], ids == m.end)
            shares = np.frombuffer(b"".join(part.column(6).to_pylist()), "<f4").astype(np.float64)
            mixed = np.log10(np.maximum(m.share * shares + (1 - m.share) * 10**chance, 1e-300)) if m.share else chance
            n = part.column(2).to_numpy()
            score = np.add.reduceat(mixed, np.cumsum(n) - n)
            yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(score)], names=[*kept, "score"])
        release()

    return tokens.select(*kept, "ids", "shares").mapInArrow(run, "uid long, doc_id long, n_tokens long, n_known long, base double, score double")


def hot_words(counts: DataFrame) -> dict[str, int]:
    """The HOT most frequent words of counts(word, n) of at most MAX_WORD bytes, and the end."""
    top = counts.filter((F.octet_length("word") <= MAX_WORD) | (F.col("word") == F.lit(END))).orderBy(F.col("word") != F.lit(END), F.desc("n"), "word").limit(HOT + 1).toArrow()
    return dict(zip(top["word"].to_pylist(), top["n"].to_pylist()))


def score(docs: DataFrame, tokenizer: str, seen: Callable[[DataFrame, Model], None] | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text).

    A null text is empty: its only token is the end. Documents that held_out() names, and those without an id, aren't
    learned from. Without training documents N and V are 0 and the score is the untrained model's. Repeated rows stay, other columns
    are ignored whatever their names, an empty table gives an empty one. A text is taken as arrays, some 60 bytes for each of its
    words at a time, so a worker's memory bounds the longest text. seen: called with the tokens and the model, for tests.
    """
    texts = docs.filter(F.col("doc_id").isNotNull() & ~held_out())
    counts = materialise(word_counts(texts), "word-counts")
    n_train, v = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens = materialise(tokenised(docs, tokenizer, hot_words(counts), n_train, v), "tokens")
    heads = tokens.filter("word is null").drop("word", "n")
    size = end_id(tokenizer) + 1
    begins = np.append(word_encoder(tokenizer).begins, True)
    model = fit(heads.filter(F.col("doc_id").isNotNull() & ~held_out()).select("uid", "ids"), size, begins, id_type(tokenizer))
    if seen:
        seen(heads, model)
    n = F.coalesce(counts["n"], F.lit(0))
    rest = tokens.filter("word is not null").select("uid", "word", F.col("n").alias("many")).join(counts, "word", "left")
    log_size = math.log10(n_train + 0.5 * (v + 1))
    tail = rest.groupBy("uid").agg(F.sum(F.when(n > 0, F.col("many"))).alias("known"), F.sum(F.col("many") * (F.log10(n + 0.5) - log_size)).alias("base_rest"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return scored(heads, model, begins).join(tail, "uid", "left").select(
        "doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_known") + zero("known")).alias("n_known"), F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + zero("base_rest")).alias("base_score"), "score",
    )
