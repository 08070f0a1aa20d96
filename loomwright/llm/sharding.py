"""Sharding by balanced label propagation, with DataFrame operations only.

Documents with equal texts are linked. Every document starts in the shard that its hash names. In each round each
group of linked documents looks for the shard that most of its members are in, and the others ask to move there (a group larger than a shard acts as several teams, each of which fits);
capacity quotas for each pair of shards say how many may. Then documents without links, and only where they don't
suffice others, move from shards that are too large to those that are too small, until the numbers of rows are at most
one apart. Groups so stay whole as far as the capacity of a shard allows, and few edges are cut.

The driver sees only shards x shards counts. Ranks within a shard come from counts by hash bucket and row numbers
within a bucket, so that no task gets a whole shard; the members of one group are spread over BUCKETS // GROUPS buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.session import materialise

SHARDS, ROUNDS = 24, 5
BUCKETS, GROUPS = 4096, 256


def ranked(rows: DataFrame, keys: list[str], bucket: Column, ties: list[str], name: str) -> DataFrame:
    """rows with name: a rank from 0 without gaps within keys, in the order of bucket and then of ties."""
    rows = rows.withColumn("bucket", bucket)
    sizes = rows.groupBy(*keys, "bucket").agg(F.count("*").alias("n_bucket"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("offset", F.coalesce(F.sum("n_bucket").over(before), F.lit(0))).drop("n_bucket")
    within = F.row_number().over(Window.partitionBy(*keys, "bucket").orderBy(*ties))
    return rows.withColumn("within", within).join(offsets, [*keys, "bucket"]).withColumn(name, (F.col("offset") + F.col("within") - 1).cast("long")).drop("bucket", "within", "offset")


def _salt(n: int, seed: int = 0) -> Column:
    return F.pmod(F.xxhash64("doc_id", "text_crc32", "size", F.lit(seed)), F.lit(n)).cast("int")


def _quotas(asked: dict[tuple[int, int], int], linked: list[int], cap: int) -> dict[tuple[int, int], int]:
    """Moves allowed from shard to shard: swaps always, beyond them as many as the linked rows of a shard leave room for."""
    allowed = {k: min(n, asked.get(k[::-1], 0)) for k, n in asked.items()}
    for t in range(len(linked)):
        rest = {k: n - allowed[k] for k, n in asked.items() if k[1] == t and n > allowed[k]}
        room = min(max(0, cap - linked[t]), sum(rest.values()))
        for k in sorted(rest, key=lambda k: (-rest[k], k)):
            take = min(rest[k], room)
            allowed[k] += take
            room -= take
    return {k: n for k, n in allowed.items() if n}


def _by_pair(values: dict[tuple[int, int], int]) -> Column:
    """The value of (shard, target), 0 without."""
    pairs = F.create_map(*(F.lit(x) for (s, t), n in values.items() for x in (s * 100_000 + t, n)))
    return F.coalesce(F.try_element_at(pairs, F.col("shard") * 100_000 + F.col("target")), F.lit(0)) if values else F.lit(0)


def propagate(rows: DataFrame, shards: int, cap: int, rounds: int) -> DataFrame:
    """rows(doc_id, size, text_crc32, g, team, linked, shard) after at most so many rounds; a round in which nothing moves is the last."""
    for _ in range(rounds):
        votes = rows.filter("linked").groupBy("g", "team", "shard").agg(F.count("*").alias("n"))
        best = votes.groupBy("g", "team").agg(F.max_by("shard", F.struct("n", F.xxhash64("g", "team", "shard"))).alias("target"))
        wish = materialise(rows.join(best, ["g", "team"], "left").withColumn("moves", F.coalesce(F.col("target") != F.col("shard"), F.lit(False))), "wishes")
        seen = wish.filter("linked").groupBy("shard", "target").agg(F.count("*").alias("n")).collect()
        linked = [sum(r.n for r in seen if r.shard == s) for s in range(shards)]
        quota = _quotas({(r.shard, r.target): r.n for r in seen if r.shard != r.target}, linked, cap)
        if not quota:
            return wish.drop("target", "moves")
        bucket = F.pmod(F.xxhash64("g", "team"), F.lit(GROUPS)).cast("int") * (BUCKETS // GROUPS) + _salt(BUCKETS // GROUPS)
        order = ranked(wish.filter("moves"), ["shard", "target"], bucket, ["g", "team", "doc_id"], "place")
        moved = order.withColumn("shard", F.when(F.col("place") < _by_pair(quota), F.col("target")).otherwise(F.col("shard"))).drop("place")
        rows = materialise(wish.filter("not moves").unionByName(moved).drop("target", "moves"), "moved")
    return rows


def even_out(rows: DataFrame, shards: int) -> DataFrame:
    """The numbers of rows at most one apart: what a shard has too many goes, documents without links first."""
    counts = {r.shard: r.n for r in rows.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    large_first = sorted(range(shards), key=lambda s: (-counts.get(s, 0), s))
    goal = {s: total // shards + (k < total % shards) for k, s in enumerate(large_first)}
    order = ranked(rows, ["shard"], F.col("linked").cast("int") * BUCKETS + _salt(BUCKETS, 1), ["g", "doc_id"], "place")
    over = {s: counts.get(s, 0) - goal[s] for s in range(shards) if counts.get(s, 0) > goal[s]}
    under = {s: goal[s] - counts.get(s, 0) for s in range(shards) if counts.get(s, 0) < goal[s]}
    if not over:
        return rows
    start, at = {}, 0
    for s in sorted(over):
        start[s] = at
        at += over[s]
    case, at = F.lit(None).cast("int"), 0
    pool = F.col("place") + F.element_at(F.create_map(*(F.lit(x) for s in range(shards) for x in (s, start.get(s, 0)))), F.col("shard"))
    for s in sorted(under):
        case = F.when((pool >= at) & (pool < at + under[s]), F.lit(s)).otherwise(case)
        at += under[s]
    extra = F.element_at(F.create_map(*(F.lit(x) for s in range(shards) for x in (s, over.get(s, 0)))), F.col("shard"))
    return order.withColumn("shard", F.when(F.col("place") < extra, case).otherwise(F.col("shard"))).drop("place")


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law (`rows`), shard, slot, grown_shard (null) for each row of docs(doc_id, text).

    Numbers of rows differ by at most one; slots of a shard run from 0 without gaps. Equal texts are a group, null texts
    one of their own; a group larger than a shard is split as little as quotas allow. Repeated rows are rows of
    their own, ids may be null, other columns are ignored; an empty table gives an empty result.
    """
    text = F.col("text").cast("string")
    base = materialise(
        docs.select(
            F.col("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
            F.coalesce(F.unhex(F.md5(text)), F.lit(b"")).alias("g"),
        ),
        "sizes",
    )
    cap = -(-base.count() // shards)
    groups = base.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1").select("g", F.when(F.col("n") > cap, F.ceil(F.col("n") / (0.9 * cap))).otherwise(1).cast("int").alias("teams"))
    first = F.pmod(F.xxhash64("doc_id", "size", F.lit(7)), F.lit(shards)).cast("int")
    team = F.coalesce(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.col("teams")), F.lit(0)).cast("int")
    rows = base.join(groups, "g", "left").withColumns({"linked": F.col("teams").isNotNull(), "team": team, "shard": first}).drop("teams")
    rows = propagate(rows, shards, cap, rounds)
    even = materialise(even_out(rows, shards), "even")
    made = ranked(even, ["shard"], _salt(BUCKETS, 2), ["doc_id", "g"], "slot")
    return made.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
