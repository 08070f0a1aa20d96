"""Scores of generated code, training metrics and retrieval arithmetic."""

from __future__ import annotations

import ast

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.text import code_block, filled_lines

#: Weights of the combined and of the validation reward.
WEIGHTS = {"executable": 0.40, "syntax": 0.25, "no_placeholder": 0.20, "format": 0.10, "length": 0.05}
VALIDATION_WEIGHTS = {"executable": 0.40, "syntax": 0.25, "format": 0.15}
#: What stands where code should be.
PLACEHOLDERS = (r"(?U)\bpass\b", r"#\s*TODO", r"#\s*FIXME", r"raise\s+NotImplementedError", r"[.][.][.]")


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """1 - C(n-c, k) / C(n, k) as a product; 1 if fewer than k samples fail."""
    failed = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda p, i: p * (F.lit(1.0) - F.lit(float(k)) / i))
    return F.when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(F.lit(1.0) - failed)


def reward_format(c: Column) -> Column:
    """1 for a closed python block, 0.5 for any fence, else 0."""
    return F.when(c.rlike("(?s)```python.*```"), 1.0).when(c.contains("```"), 0.5).otherwise(0.0)


def reward_no_placeholder(c: Column) -> Column:
    code = code_block(c)
    bad = F.lit(False)
    for p in PLACEHOLDERS:
        bad = bad | code.rlike(p)
    return F.when(bad, 0.0).otherwise(1.0)


def reward_length(c: Column) -> Column:
    n = filled_lines(code_block(c))
    return F.when(n < 3, 0.2).when(n <= 50, 1.0).when(n <= 100, 0.7).otherwise(0.3)


@F.arrow_udf(T.DoubleType())
def _syntax(code: pa.Array) -> pa.Array:
    def score(x: str | None) -> float:
        if not x:
            return 0.0
        try:
            ast.parse(x)
        except (SyntaxError, ValueError, RecursionError, MemoryError):
            return 0.3
        return 1.0

    return pa.array([score(x) for x in code.to_pylist()], pa.float64())


def reward_syntax(c: Column) -> Column:
    """1 if the code parses, 0.3 if not, 0 without code; needs Python's own parser."""
    return _syntax(code_block(c))


def combined(parts: dict[str, Column], weights: dict[str, float] = WEIGHTS) -> Column:
    """Weighted sum, four digits; parts that are missing count 0."""
    total = F.lit(0.0)
    for name, w in weights.items():
        if name in parts:
            total = total + parts[name] * w
    return F.round(total, 4)


def share(part: Column, whole: Column, digits: int = 1) -> Column:
    """Percent, 0 of nothing."""
    return F.coalesce(F.round(F.lit(100.0) * part / F.nullif(whole, F.lit(0)), digits), F.lit(0.0))


def advantage(reward: Column, window, eps: float = 1e-4) -> Column:
    """A reward against its group: (r - mean) / (sample deviation + eps)."""
    return (reward - F.avg(reward).over(window)) / (F.coalesce(F.stddev_samp(reward).over(window), F.lit(0.0)) + eps)


def token_accuracy(hits: Column, counted: Column) -> Column:
    return F.coalesce(F.sum(hits.cast("double")) / F.nullif(F.sum(counted.cast("double")), F.lit(0.0)), F.lit(0.0))


#: The state of the early-stopping rule.
STATE = "struct<best:double,best_step:long,wait:int,stopped_step:long>"


def progress_mark(place: Column, every: int) -> Column:
    """Whether a 1-based place is one at which progress is told."""
    return F.pmod(place, F.lit(every)) == 0


def early_stop(history: Column, patience: int = 3, min_delta: float = 0.005, state: Column | None = None) -> Column:
    """struct<best, best_step, wait, stopped_step> of array<struct<step, value>>: a value is an improvement only if it exceeds the best by more than min_delta; patience steps without stop, and nothing after counts. state: where to go on, as an earlier call gave it."""
    init = F.from_json(F.lit('{"wait":0}'), STATE)
    init = init if state is None else F.coalesce(state, init)

    def step(s: Column, x: Column) -> Column:
        better = s["best"].isNull() | (x["value"] > s["best"] + min_delta)
        wait = F.when(better, 0).otherwise(s["wait"] + 1)
        new = F.struct(F.when(better, x["value"]).otherwise(s["best"]).alias("best"), F.when(better, x["step"]).otherwise(s["best_step"]).cast("long").alias("best_step"), wait.cast("int").alias("wait"), F.when(wait >= patience, x["step"]).cast("long").alias("stopped_step"))
        return F.when(s["stopped_step"].isNotNull(), s).otherwise(new)

    return F.aggregate(F.array_sort(history), init, step)
