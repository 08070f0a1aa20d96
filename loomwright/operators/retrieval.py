"""Ranked retrieval: vector and keyword top-k, rank fusion, hybrid search, reranking, expansion, verdicts.

Hit lists are DataFrames with chunk_id and a 1-based rank; every order has an explicit tie-break.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions.scores import reciprocal_rank
from loomwright.functions.text import folded, tokens
from loomwright.functions.vectors import cosine

#: Fixed values of expansion: decay of neighbours, summary children and pulled attachments, and limits.
NEIGHBOUR, CHILD, PULLED = 0.8, 0.9, 0.7
SHORT_ATTACHMENT, CHILDREN, PULL = 5, 10, 3


def payload_filter(rows: DataFrame, **equal: object) -> DataFrame:
    """Rows that equal every given value that isn't None; applied before any ranking."""
    for name, value in equal.items():
        if value is not None:
            rows = rows.filter(F.col(name) == F.lit(value))
    return rows


def top(rows: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first k rows and their rank; ranking happens on k rows only."""
    first = rows.orderBy(*order).limit(k)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def vector_topk(vectors: DataFrame, query: list[float], k: int = 20, id_col: str = "chunk_id", vector_col: str = "embedding", digits: int | None = None) -> DataFrame:
    """id, score, rank of the k vectors with the largest cosine, ties by id; zero and null vectors take no part."""
    q = F.array(*(F.lit(float(x)) for x in query))
    score = cosine(F.col(vector_col), q)
    scored = vectors.select(id_col, (F.round(score, digits) if digits is not None else score).alias("score"))
    # nulls come last; a filter before the ranking would compute each score twice
    return top(scored, k, F.desc_nulls_last("score"), F.asc(id_col)).filter("score is not null")


def text_topk(chunks: DataFrame, query: str, k: int = 20, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """id, score, rank of texts that hold all words of the query, by how often they hold them (a stand-in for a database's own rank), ties by id."""
    spark = chunks.sparkSession
    words = [r[0] for r in spark.range(1).select(F.explode(tokens(F.lit(query)))).collect()]
    rows = chunks.select(id_col, F.lower(text_col).alias("low"))
    for w in words or [None]:  # cheap, and for most texts enough
        rows = rows.filter(F.contains("low", F.lit(w)))
    every = F.filter(F.split("low", r"[^\p{L}\p{N}]+"), lambda x: x.isin(*words)) if words else F.array().cast("array<string>")
    # as a bound variable the words of a text are found once
    score = F.get(F.transform(F.array(every), lambda x: F.when(F.size(F.array_distinct(x)) == len(words), F.size(x).cast("double"))), F.lit(0))
    return top(rows.select(id_col, score.alias("score")), k, F.desc_nulls_last("score"), F.asc(id_col)).filter("score is not null")


def rrf(lists: list[DataFrame], k: int = 60, id_col: str = "chunk_id") -> DataFrame:
    """id, score = sum of 1 / (k + rank), and the rank of each list as rank_1, rank_2, ...; null where a list lacks the id."""
    all_ = None
    for i, hits in enumerate(lists):
        part = hits.select(id_col, F.lit(i).alias("list"), "rank")
        all_ = part if all_ is None else all_.unionByName(part)
    ranks = [F.min(F.when(F.col("list") == i, F.col("rank"))).alias(f"rank_{i + 1}") for i in range(len(lists))]
    return all_.groupBy(id_col).agg(F.sum(reciprocal_rank(F.col("rank"), k)).alias("score"), *ranks)


def hybrid(vector_hits: DataFrame, text_hits: DataFrame, chunks: DataFrame, k: int = 5, rrf_k: int = 60, id_col: str = "chunk_id") -> DataFrame:
    """The k best of both lists by fused rank (ties: the vector list's order first), joined with the chunks last; ids that chunks lack drop out."""
    fused = rrf([vector_hits, text_hits], rrf_k, id_col).withColumnsRenamed({"rank_1": "vector_rank", "rank_2": "text_rank"})
    ranked = top(fused, k, F.desc("score"), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("text_rank"))
    return chunks.join(F.broadcast(ranked), id_col)  # k rows


def single_mode(hits: DataFrame, chunks: DataFrame, k: int, mode: str, rrf_k: int = 60, id_col: str = "chunk_id") -> DataFrame:
    """vector: hits with their cosine; text: hits with 1 / (rrf_k + rank). The scores of the two aren't comparable."""
    ranked = hits.filter(F.col("rank") <= k)
    ranked = ranked.withColumn("score", reciprocal_rank(F.col("rank"), rrf_k)) if mode == "text" else ranked
    return chunks.join(F.broadcast(ranked), id_col)  # k rows


def overlap_scorer(query: str, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the query's words that a text holds."""
    words = tokens(F.lit(query))
    return F.coalesce(F.size(F.array_intersect(tokens(text), words)) / F.nullif(F.size(words), F.lit(0)), F.lit(0.0))


def rerank(hits: DataFrame, query: str, k: int = 5, scorer: Callable[[str, Column], Column] = overlap_scorer, id_col: str = "chunk_id") -> DataFrame:
    """The k hits with the best scorer(query, text); pre_rerank_score keeps the score they came with."""
    scored = hits.withColumn("pre_rerank_score", F.col("score")).withColumn("rerank_score", scorer(query, F.col("text"))).withColumn("score", F.col("rerank_score")).drop("rank")
    return top(scored, k, F.desc("rerank_score"), F.desc("pre_rerank_score"), F.asc(id_col))


def mentions(query: str, words: tuple[str, ...]) -> bool:
    return any(w in query.lower() for w in words)


#: Words of a query that ask for forms.
INTENT = ("mẫu", "đơn", "biểu mẫu")


def within(rows: DataFrame, points: DataFrame, on: list[str], index: str, at: str, width: int) -> DataFrame:
    """Rows and points that are equal in `on` and whose index is at most `width` from `at`; the columns of both, `on` once.

    Indexes fall into bins of the length of a range, and a point goes to the two bins at most that its range touches, so the
    bin is one more key of the join: a group with many rows and points is spread, and never meets as a whole.
    """
    size = 2 * width + 1
    low, high = F.col(at) - width, F.col(at) + width
    sent = points.withColumn("_bin", F.explode(F.sequence(F.floor(low / size), F.floor(high / size)))).withColumnsRenamed({c: f"_{c}" for c in on})
    dealt = rows.withColumn("_own", F.floor(F.col(index) / size))
    keys = (F.col("_own") == F.col("_bin")) & F.col(index).between(low, high)
    for c in on:
        keys = keys & (F.col(c) == F.col(f"_{c}"))
    return dealt.join(sent, keys).drop("_bin", "_own", *(f"_{c}" for c in on))


def neighbours(hits: DataFrame, chunks: DataFrame, width: int = 1, skip: tuple[str, ...] = ("summary",)) -> DataFrame:
    """For hits(doc_id, chunk_index, hit_rank, ...) the chunks of the same document at most `width` away, without types in skip."""
    h = hits.select(F.col("doc_id"), F.col("chunk_index").alias("at"), "hit_rank", F.col("score").alias("hit_score"))
    return within(chunks.filter(~F.col("chunk_type").isin(*skip)), h, ["doc_id"], "chunk_index", "at", width)


def expand(hits: DataFrame, chunks: DataFrame, query: str = "", width: int = 1) -> DataFrame:
    """Parent-child expansion of hits(chunk_id, score, rank) over chunks(chunk_id, doc_id, chunk_index, chunk_type, attachment_name, attachment_index, attachment_chunk_index, text).

    Body hits bring neighbours and, if the query asks for forms, the first attachment chunks of their document; attachment
    hits bring the whole attachment if it is short, else neighbours in it; summaries bring their attachment, or the first
    chunks of their document. The first to bring a chunk decides its score and place. Ordered by doc_id, chunk_index.
    """
    h = chunks.join(hits.select("chunk_id", "score", F.col("rank").alias("hit_rank")), "chunk_id")
    seed = h.select(
        F.col("doc_id"), F.col("chunk_index").alias("h_index"), F.col("chunk_type").alias("h_type"), F.col("attachment_name").alias("h_name"), F.col("attachment_chunk_index").alias("h_att"),
        "hit_rank", F.col("score").alias("h_score"),
    )
    c = chunks.select("chunk_id", "doc_id", "chunk_index", "chunk_type", "attachment_name", "attachment_index", "attachment_chunk_index")
    of_seeds = c.join(seed.select("doc_id").distinct(), "doc_id", "left_semi")
    attached = of_seeds.filter(F.col("chunk_type") == "attachment")
    seeds = lambda kind: seed.filter(F.col("h_type") == kind)
    out = ["chunk_id", "doc_id", "chunk_index", "hit_rank", "phase", "new_score"]

    def part(rows: DataFrame, phase: int, factor: float) -> DataFrame:
        return rows.withColumns({"phase": F.lit(phase), "new_score": F.col("h_score") * factor}).select(out)

    def first(rows: DataFrame, n: int, *order: str) -> DataFrame:
        """The first n rows of each document."""
        return rows.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).filter(F.col("n") <= n).drop("n")

    own = h.select("chunk_id", "doc_id", "chunk_index", "hit_rank", F.lit(0).alias("phase"), F.col("score").alias("new_score"))
    body = within(of_seeds.filter(F.col("chunk_type") != "summary"), seeds("body"), ["doc_id"], "chunk_index", "h_index", width)
    size = attached.groupBy("doc_id", "attachment_name").agg(F.count("*").alias("n"))
    of_att = seeds("attachment").withColumnRenamed("h_name", "attachment_name").join(size, ["doc_id", "attachment_name"])
    short = attached.join(of_att.filter(F.col("n") <= SHORT_ATTACHMENT), ["doc_id", "attachment_name"])
    long = within(attached, of_att.filter(F.col("n") > SHORT_ATTACHMENT), ["doc_id", "attachment_name"], "attachment_chunk_index", "h_att", width)
    whole = attached.join(seeds("summary").withColumnRenamed("h_name", "attachment_name"), ["doc_id", "attachment_name"])
    child = first(of_seeds.filter(F.col("chunk_type").isin("body", "attachment")), CHILDREN, "chunk_index", "chunk_id").join(seeds("summary").filter("h_name is null"), "doc_id")
    all_ = own
    for rows, factor in ((body, NEIGHBOUR), (short, NEIGHBOUR), (long, NEIGHBOUR), (whole, CHILD), (child, CHILD)):
        all_ = all_.union(part(rows, 1, factor))
    if mentions(query, INTENT):
        pulled = first(attached, PULL, "attachment_index", "attachment_chunk_index", "chunk_index", "chunk_id").join(seeds("body"), "doc_id")
        all_ = all_.union(part(pulled, 2, PULLED))
    order = Window.partitionBy("chunk_id").orderBy("hit_rank", "phase", "chunk_index")
    best = all_.withColumn("n", F.row_number().over(order)).filter("n = 1").select("chunk_id", F.col("new_score").alias("score"), "hit_rank", "phase")
    return chunks.join(best, "chunk_id").orderBy("doc_id", F.coalesce("chunk_index", F.lit(9999)))


HAYSTACK = ("text", "chunk_id", "attachment_name", "section_header", "source_url", "doc_id", "chunk_type")


def verdicts(cases: DataFrame, seed: DataFrame, expanded: DataFrame) -> DataFrame:
    """case_id, verdict for cases(case_id, expected_terms), seed and expanded hits (case_id, rank and what they have of HAYSTACK).

    Rank 1 of expanded: PASS; rank 3 or better there or in seed: PARTIAL; else FAIL; no terms: MANUAL.
    """
    def best(hits: DataFrame, name: str) -> DataFrame:
        hay = F.concat_ws(" \n ", *(folded(F.col(c).cast("string")) for c in HAYSTACK if c in hits.columns))
        match = F.exists("expected_terms", lambda t: (folded(t) != "") & F.contains(F.col("hay"), folded(t)))
        return hits.withColumn("hay", hay).join(cases.select("case_id", "expected_terms"), "case_id").filter(match).groupBy("case_id").agg(F.min("rank").alias(name))

    both = cases.join(best(seed, "seed_rank"), "case_id", "left").join(best(expanded, "expanded_rank"), "case_id", "left")
    verdict = F.when(F.size("expected_terms") == 0, "MANUAL").when(F.col("expanded_rank") == 1, "PASS").when((F.col("expanded_rank") <= 3) | (F.col("seed_rank") <= 3), "PARTIAL").otherwise("FAIL")
    return both.select("case_id", verdict.alias("verdict"), "seed_rank", "expanded_rank")


def verdict_counts(found: DataFrame) -> DataFrame:
    """n of each of the four verdicts, zero where there is none."""
    one = found.agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("PASS", "PARTIAL", "FAIL", "MANUAL")))
    return one.select(F.inline(F.array(*(F.struct(F.lit(v).alias("verdict"), F.col(v).alias("n")) for v in ("PASS", "PARTIAL", "FAIL", "MANUAL")))))


def failed(found: DataFrame) -> bool:
    """Whether a verdict is FAIL, as the exit code of a quality check."""
    return not found.filter("verdict = 'FAIL'").isEmpty()


def sources(hits: DataFrame) -> DataFrame:
    """The first hit of each document; hits without a document all stay. hits: rank, doc_id, ..."""
    first = F.row_number().over(Window.partitionBy("doc_id").orderBy("rank"))
    return hits.withColumn("n", first).filter((F.col("n") == 1) | (F.coalesce("doc_id", F.lit("")) == "")).drop("n")
