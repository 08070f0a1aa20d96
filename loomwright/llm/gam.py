"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature is cut into bins; cyclic boosting goes round the features and adds a shrunken shallow tree over one
feature's bins to that feature's lookup table at a time, so all features share what they explain. Then the pairs of
features with the largest gain of a two-by-two cut get tables of their own in the same way. A score is the sum of one
entry of each table, found for whole batches at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.llm.chunks import release

#: The model is fitted on at most so many labelled rows, those with the smallest hash of doc_id.
MAX_TRAINING_ROWS = 16_000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
ROUNDS, PAIR_ROUNDS, RATE, LEAST = 120, 60, 0.1, 1.0

SYMBOLS = b"!?.,;:|#$%&*+-=<>/\\\"'()[]{}@_~^`"
_KINDS = (b"!", b"?", b".", b",;:", b"|", b"#", b"$", b"%", b"&", b"*", b"<>{}[]", b"=@_/\\")
FEATURES = (
    "log_bytes", "log_words", "word_bytes", "longest_word", "distinct_words", "lines", "distinct_lines", "line_bytes", "upper", "digits", "spaces", "non_ascii", "letters", "symbols",
    *(f"share_{k.decode()}" for k in _KINDS),
)


def features(text: bytes | None) -> list[float]:
    """The numbers of FEATURES of a whole text; a null text is an empty one."""
    text = text or b""
    n = max(1, len(text))
    count = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    words, lines = text.split(), text.split(b"\n")
    n_words = max(1, len(words))
    upper, lower, digits = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    high = int(count[128:].sum())
    return [
        float(np.log1p(len(text))), float(np.log1p(len(words))), sum(map(len, words)) / n_words, float(np.log1p(max(map(len, words), default=0))), len(set(words)) / n_words,
        len(lines) / n_words, len(set(lines)) / len(lines), float(np.log1p(len(text) / len(lines))), upper / max(1, upper + lower), digits / n,
        int(count[32]) / n, high / n, (upper + lower + high) / n, int(count[list(SYMBOLS)].sum()) / n, *(int(count[list(k)].sum()) / n for k in _KINDS),
    ]


def matrix(texts: pa.Array) -> np.ndarray:
    parts = (texts.slice(at, 512).cast(pa.binary()).to_pylist() for at in range(0, len(texts), 512))
    return np.array([features(x) for part in parts for x in part], dtype=np.float64).reshape(len(texts), len(FEATURES))


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values by bin of the best tree of at most three leaves over ordered bins, by the gain of Newton steps."""

    def cut(lo: int, hi: int) -> tuple[float, int]:
        a, b = np.cumsum(g[lo:hi])[:-1], np.cumsum(h[lo:hi])[:-1]
        if not len(a):
            return 0.0, lo
        ga, ha = g[lo:hi].sum(), h[lo:hi].sum()
        gain = a**2 / (b + LEAST) + (ga - a) ** 2 / (ha - b + LEAST) - ga**2 / (ha + LEAST)
        k = int(gain.argmax())
        return float(gain[k]), lo + k + 1

    ends = [0, len(g)]
    for _ in range(2):
        gain, at = max(cut(a, b) for a, b in zip(ends, ends[1:]))
        if gain <= 1e-9:
            break
        ends = sorted({*ends, at})
    out = np.empty(len(g))
    for a, b in zip(ends, ends[1:]):
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + LEAST)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The gain and the values of the best cut of a table into two by two."""
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    tg, th = cg[-1, -1], ch[-1, -1]
    parts = lambda c, t: (c[:-1, :-1], c[:-1, -1:] - c[:-1, :-1], c[-1:, :-1] - c[:-1, :-1], t - c[:-1, -1:] - c[-1:, :-1] + c[:-1, :-1])
    steps = list(zip(parts(cg, tg), parts(ch, th)))
    gain = sum(a**2 / (b + LEAST) for a, b in steps) - tg**2 / (th + LEAST)
    if not gain.size:
        return 0.0, np.zeros_like(g)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    out = np.empty_like(g)
    for (a, b), (rows, cols) in zip(steps, ((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        out[rows, cols] = a[i, j] / (b[i, j] + LEAST)
    return float(gain[i, j]), out


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.arange(1, bins) / bins, method="higher"))


@dataclass
class Model:
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], side="right")]
        for (i, j), table in zip(self.pairs, self.pair_tables):
            total += table[np.searchsorted(self.pair_edges[i], x[:, i], side="right"), np.searchsorted(self.pair_edges[j], x[:, j], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """A model of the chance of y = 1. Without rows it always says 0.5; with one class only, near that class."""
    if not len(y):
        return Model()
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = Model(base=float(np.log(rate / (1 - rate))), edges=[_edges(c, BINS) for c in x.T], pair_edges=[_edges(c, PAIR_BINS) for c in x.T])
    total = np.full(len(y), model.base)
    bins = [np.searchsorted(e, c, side="right") for e, c in zip(model.edges, x.T)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -40, 40)))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for b, table in zip(bins, model.tables):
            g, h = slopes()
            step = RATE * _tree(np.bincount(b, g, len(table)), np.bincount(b, h, len(table)))
            table += step
            total += step[b]
    coarse = [np.searchsorted(e, c, side="right") for e, c in zip(model.pair_edges, x.T)]
    width = [len(e) + 1 for e in model.pair_edges]
    grid = lambda i, j, v: np.bincount(coarse[i] * width[j] + coarse[j], v, width[i] * width[j]).reshape(width[i], width[j])
    g, h = slopes()
    gains = [(_quadrants(grid(i, j, g), grid(i, j, h))[0], i, j) for i in range(x.shape[1]) for j in range(i + 1, x.shape[1]) if width[i] > 1 and width[j] > 1]
    model.pairs = [(i, j) for _, i, j in sorted(gains, key=lambda v: (-v[0], v[1:]))[:PAIRS]]
    model.pair_tables = [np.zeros((width[i], width[j])) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for (i, j), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = RATE * _quadrants(grid(i, j, g), grid(i, j, h))[1]
            table += step
            total += step[coarse[i], coarse[j]]
    return model


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = matrix(batch.column(1))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document's label is kept from learning."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Model:
    """Fit on labels(doc_id, quality) whose quality is 0 or 1 and whose id isn't held out, at most max_rows ids.

    An id counts once: of several labels that of most rows (none if they tie), of several texts the first in order.
    """
    said = labels.select("doc_id", F.col("quality").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = said.groupBy("doc_id").agg(F.avg("y").alias("y")).filter("y <> 0.5").select("doc_id", F.round("y").cast("int").alias("y"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")  # max_rows at most
    rows = rows.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("y", "text")
    found = rows.mapInArrow(_labelled, "y int, x array<double>").toPandas()
    return fit(np.array(found["x"].tolist(), dtype=np.float64).reshape(len(found), len(FEATURES)), found["y"].to_numpy(dtype=np.float64))


def scorer(model: Model, text: Column) -> Column:
    """The chance that a text is of good quality, 0 to 1."""

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        scores = pa.array(model.score(matrix(texts)), pa.float64())
        release()
        return scores

    return score(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs(doc_id, text). Null and empty texts have a score; repeated rows stay; other columns are ignored."""
    model = train(docs, labels)
    scored = docs.select("doc_id", held_out().alias("held_out"), scorer(model, F.col("text")).alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with its columns, that classify() predicts to be good."""
    model = train(docs, labels)
    made = docs.select(F.struct("*").alias("row"), scorer(model, F.col("text")).alias("score"))
    return made.filter(F.col("score") >= 0.5).select("row.*")
