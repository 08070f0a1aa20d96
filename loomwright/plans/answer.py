"""Question answering over chunks: one strategy function for all modes, and a chain around an injected model."""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators import retrieval
from loomwright.plans import prompt

MODES = ("hybrid", "vector", "text", "rerank", "expand", "rerank-expand")


def retrieve(chunks: DataFrame, vectors: DataFrame, query: str, vector: list[float], mode: str = "hybrid", k: int = 5, candidates: int = 20, **filters: object) -> DataFrame:
    """Chunks with score and rank. chunks(chunk_id, text, ...), vectors(chunk_id, embedding, ...); filters hold before ranking. An unknown mode is hybrid, with a warning."""
    if mode not in MODES:
        warnings.warn(f"unknown mode {mode!r}, hybrid is used", stacklevel=2)
        mode = "hybrid"
    chunks = retrieval.payload_filter(chunks, **filters)
    allowed = vectors.join(chunks.select("chunk_id"), "chunk_id", "left_semi") if any(v is not None for v in filters.values()) else vectors
    by_vector = retrieval.vector_topk(allowed, vector, candidates)
    if mode == "vector":
        return retrieval.single_mode(by_vector, chunks, k, mode)
    by_text = retrieval.text_topk(chunks, query, candidates)
    if mode == "text":
        return retrieval.single_mode(by_text, chunks, k, mode)
    if "rerank" in mode:
        hits = retrieval.rerank(retrieval.hybrid(by_vector, by_text, chunks, candidates), query, k)
    else:
        hits = retrieval.hybrid(by_vector, by_text, chunks, k)
    return retrieval.expand(hits, chunks, query) if "expand" in mode else hits


@dataclass
class Chain:
    """encode(query) -> vector; generate(prompt, system) -> text; stream(prompt, system) -> parts."""

    chunks: DataFrame
    vectors: DataFrame
    encode: Callable[[str], list[float]]
    generate: Callable[[str, str], str]
    stream: Callable[[str, str], Iterator[str]] | None = None
    mode: str = "rerank-expand"
    system: str = ""
    k: int = 5
    candidates: int = 50

    def prepare(self, question: str) -> tuple[DataFrame, str]:
        found = retrieve(self.chunks, self.vectors, question, self.encode(question), self.mode, self.k, self.candidates)
        order = "chunk_index" if "expand" in self.mode else "rank"
        docs = found.withColumn("pos", F.struct("doc_id", F.col(order))) if "expand" in self.mode else found.withColumn("pos", F.col(order))
        have = [F.col(c) if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("title", "source_url")]
        entries = prompt.context(docs.select("pos", "text", "chunk_type", *have), question)
        return found, prompt.prompt(entries, question).first()["prompt"]

    def answer(self, question: str) -> dict:
        found, text = self.prepare(question)
        ranked = found if "rank" in found.columns else found.withColumn("rank", F.col("hit_rank"))
        return {"answer": self.generate(text, self.system), "prompt": text, "sources": [r.asDict() for r in retrieval.sources(ranked.select("chunk_id", "doc_id", "score", "rank")).collect()]}

    def stream_answer(self, question: str) -> Iterator[str]:
        yield from self.stream(self.prepare(question)[1], self.system)
