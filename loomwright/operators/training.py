"""Training sets, reward tables and evaluation of generated code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions import scores


def bucket(key: Column, seed: int, buckets: int = 1000) -> Column:
    """A number below buckets from a hash of key and seed: the same on every run and in every engine."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", F.lit(str(seed)), key.cast("string"))), 1, 8), 16, 10).cast("long") % buckets


def split(rows: DataFrame, key: str, test_share: float = 0.1, seed: int = 42) -> DataFrame:
    """rows with part: `train` or `test`, disjoint by key."""
    return rows.withColumn("part", F.when(bucket(F.col(key), seed) < round(test_share * 1000), "test").otherwise("train"))


def shuffled_head(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of a seeded shuffle."""
    return rows.orderBy(F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def reward_columns(completion: str = "completion", syntax: bool = True) -> dict[str, Column]:
    """Reward columns of a completion; executing code is apart in plans.execution and off by default."""
    c = F.col(completion)
    made = {"format": scores.reward_format(c), "no_placeholder": scores.reward_no_placeholder(c), "length": scores.reward_length(c)}
    return made | ({"syntax": scores.reward_syntax(c)} if syntax else {})


def with_rewards(rows: DataFrame, completion: str = "completion", syntax: bool = True) -> DataFrame:
    """rows with r_<part> columns and the combined reward; an r_executable column of rows is used if there."""
    parts = reward_columns(completion, syntax)
    made = rows.withColumns({f"r_{k}": v for k, v in parts.items()})
    have = {k: F.col(f"r_{k}") for k in scores.WEIGHTS if f"r_{k}" in made.columns}
    return made.withColumn("reward", scores.combined(have)).withColumn("validation_reward", scores.combined(have, scores.VALIDATION_WEIGHTS))


def group_advantage(rows: DataFrame, group: str, reward: str = "reward") -> DataFrame:
    return rows.withColumn("advantage", scores.advantage(F.col(reward), Window.partitionBy(group)))


def mean_pass_at_k(samples: DataFrame, k: int, problem: str = "problem", passed: str = "passed") -> DataFrame:
    """problem, n, c, pass_at_k; average it for the benchmark's figure."""
    made = samples.groupBy(problem).agg(F.count("*").alias("n"), F.count_if(F.col(passed)).alias("c"))
    return made.filter(F.col("n") >= k).withColumn("pass_at_k", scores.pass_at_k(F.col("n"), F.col("c"), k))


def reward_summary(rows: DataFrame) -> DataFrame:
    """avg_reward, min_reward, max_reward, four digits."""
    return rows.agg(*(F.round(f(F.col("reward")), 4).alias(f"{n}_reward") for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))))


def rates(rows: DataFrame) -> DataFrame:
    """Shares of completions that run, parse and have a fence, and the mean validation reward."""
    one = lambda c, v: F.round(F.avg((F.col(c) >= v).cast("double")), 4)
    have = [(n, c) for n, c in (("pass_rate", "r_executable"), ("syntax_rate", "r_syntax"), ("format_rate", "r_format")) if c in rows.columns]
    return rows.agg(*(one(c, 1.0 if c != "r_format" else 0.5).alias(n) for n, c in have), F.round(F.avg("validation_reward"), 4).alias("mean_reward"))


def metric_groups(metrics: DataFrame) -> DataFrame:
    """metrics(step, metrics map) with one map for each prefix: rewards/, completions/ and the rest."""
    of = lambda p: F.map_filter("metrics", lambda k, v: k.startswith(p))
    rest = F.map_filter("metrics", lambda k, v: ~k.startswith("rewards/") & ~k.startswith("completions/"))
    return metrics.select("step", of("rewards/").alias("rewards"), of("completions/").alias("completions"), rest.alias("other"))


def early_stop(metrics: DataFrame, step: str, value: str, patience: int = 3, min_delta: float = 0.005, group: list[str] | None = None) -> DataFrame:
    """The state of the early-stopping rule over each group's values; one array of (step, value) of a training run is folded."""
    history = F.collect_list(F.struct(F.col(step).cast("long").alias("step"), F.col(value).cast("double").alias("value")))
    folded = metrics.groupBy(*(group or [])).agg(history.alias("h")).withColumn("s", scores.early_stop(F.col("h"), patience, min_delta))
    return folded.select(*(group or []), "s.best", "s.best_step", "s.wait", "s.stopped_step")
