"""A written keyword index: postings by word, which queries read instead of texts, and which changes keep up.

One keyed table holds postings in blocks: of each word of a run of texts one row (see postings.py), and one with the ids, generations
and lengths of these texts; in buckets by the word and a part of the blocks, so that the postings of a frequent word lie in
several. A change of a text writes new blocks and a mark with the new generation; postings of another generation no longer count,
and optimize() drops them. Both are one commit, so a query sees a text as it was or as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions.text import tokens
from loomwright.operators import postings
from loomwright.operators.keyed import KeyedTable
from loomwright.operators.retrieval import top

#: Parts of a word's blocks; what begins the word of a mark and of a block's own row, and no word of a text.
PARTS, MARK = 8, "\0"
SPLIT = r"[^\p{L}\p{N}]+"


class TextIndex:
    """Create with create(), or open with TextIndex(spark, root). Ids are of any type that can be a key."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.table = spark, KeyedTable(spark, root)

    @staticmethod
    def create(spark: SparkSession, root: str, id_type: str = "string", buckets: int = 64) -> TextIndex:
        schema = f"word string, part int, block long, id {id_type}, generation long, docs array<int>, counts array<int>, places array<int>, ids array<{id_type}>, generations array<long>, lengths array<int>"
        KeyedTable.create(spark, root, schema, ["word", "part", "block", "id"], buckets, ["word", "part"])
        return TextIndex(spark, root)

    def _part(self) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int").alias("part")

    def _postings(self, texts: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
        """(postings, generations) of texts. Repeated rows count once; ValueError if an id has unlike texts. Rows without an id take no part."""
        rows = postings.once(texts.select(F.col(id_col).cast(self.id_type).alias("id"), F.coalesce(text_col, F.lit("")).alias("text")).filter("id is not null"))
        words = F.filter(F.split(F.lower("text"), SPLIT), lambda x: x != "")
        made = rows.select("id", "text", F.xxhash64("text").alias("generation"), words.alias("words"))
        made = made.select("id", "text", F.col("generation").alias("generations"), F.size("words").alias("lengths"), "words")
        find = lambda batch: postings.of_lists(batch.column(4))
        found = postings.blocks(made, find, self.id_type, PARTS, True, "generations long, lengths int")
        mark = F.concat(F.lit(MARK), F.col("part").cast("string"))
        none = {"id": F.lit(None).cast(self.id_type), "generation": F.lit(None).cast("long")}
        return found.withColumns({"word": F.coalesce("entry", mark)} | none).drop("entry"), rows.select("id", F.xxhash64("text").alias("generation"))

    @property
    def id_type(self) -> str:
        return self.table.schema["id"].dataType.simpleString()

    def build(self, texts: DataFrame, id_col: str = "id", text_col: str = "text") -> int:
        """All of texts, in an index that is empty."""
        if self.table.state().files:
            raise ValueError("the index isn't empty")
        return self.table.overwrite(self._postings(texts, id_col, text_col)[0])

    def _marks(self, generations: DataFrame) -> DataFrame:
        return generations.select(F.concat(F.lit(MARK), self._part().cast("string")).alias("word"), self._part(), "id", "generation")

    def upsert(self, texts: DataFrame, id_col: str = "id", text_col: str = "text") -> int:
        """New and changed texts; only their postings are written. A null text is empty."""
        blocks, generations = self._postings(texts, id_col, text_col)
        return self.table.upsert(blocks.unionByName(self._marks(generations), allowMissingColumns=True), unique=True)

    def delete(self, ids: DataFrame, id_col: str = "id") -> int:
        """These ids are found no longer; only a mark for each is written."""
        gone = ids.select(F.col(id_col).alias("id"), F.lit(None).cast("long").alias("generation")).filter("id is not null").distinct()
        return self.table.upsert(self._marks(gone))

    def _rows(self, words: list[str]) -> DataFrame:
        """The blocks of words, what their texts are, and all marks; reads the buckets of these words and of the marks."""
        wanted = [(w, p) for w in words for p in range(PARTS)] + [(f"{MARK}{p}", p) for p in range(PARTS)]
        buckets = self.table.buckets_of(self.spark.createDataFrame(wanted, "word string, part int"))
        return self.table.read(buckets=buckets, where=lambda rows: rows.filter(F.col("word").isin(*{w for w, _ in wanted})))

    @staticmethod
    def _live(found: DataFrame, rows: DataFrame) -> DataFrame:
        """Those of found(id, generation, ...) that no mark among rows says to be of another generation."""
        marks = rows.filter("block is null").select("id", F.lit(True).alias("marked"), F.col("generation").alias("now"))
        return found.join(marks, "id", "left").filter(F.col("marked").isNull() | F.coalesce(F.col("generation") == F.col("now"), F.lit(False))).drop("marked", "now")

    def search(self, query: str, k: int = 20, normalise: str = "none", phrase: bool = False) -> DataFrame:
        """id, score, rank of the k texts that hold all words of the query, ties by id.

        The score is how often they hold them; normalise: `log` divides it by 1 + ln(length), `length` by the length in
        words. phrase: the words must follow each other in the query's order somewhere. A query without words finds nothing.
        """
        one = self.spark.range(1).select(tokens(F.lit(query)).alias("words"), F.filter(F.split(F.lower(F.lit(query)), SPLIT), lambda x: x != "").alias("every")).first()
        words, every = one.words, one.every
        rows = self._rows(words)
        id_type = self.id_type

        def match(table: pa.Table) -> pa.Table:
            own = table.filter(pc.is_valid(table["ids"]))
            held = table.filter(pc.is_valid(table["docs"])).rename_columns({"word": "entry"})
            some, frequency = np.empty(0, np.int64), np.empty(0, np.int64)
            if words and held.num_rows == len(words):
                block = postings.Block(held, "docs")
                some = block.of(words[0])
                for w in words[1:]:
                    some = np.intersect1d(some, block.of(w), assume_unique=True)
                frequency = sum(block.n(w)[np.searchsorted(block.of(w), some)].astype(np.int64) for w in words)
                if phrase:
                    stays = np.isin(some, block.following(list(zip(every, range(len(every)))), {w: block.of(w) for w in words}))
                    some, frequency = some[stays], frequency[stays]
            at = pa.array(some)
            of = lambda name: own[name].combine_chunks()[0].values.take(at)
            return pa.table({"id": of("ids"), "generation": of("generations"), "length": of("lengths"), "frequency": pa.array(frequency, pa.int64())})

        found = rows.filter("block is not null").drop("part", "id", "generation").groupBy("block").applyInArrow(match, f"id {id_type}, generation long, length int, frequency long")
        length = F.col("length").cast("double")
        by = {"none": F.lit(1.0), "log": 1.0 + F.log(length), "length": length}[normalise]
        # a text that was written twice as it is counts once
        found = self._live(found, rows).groupBy("id").agg(F.max(F.col("frequency").cast("double") / by).alias("score"))
        return top(found, k, F.desc("score"), F.asc("id"))

    def optimize(self) -> int:
        """Postings that no longer count and all marks go, as one rewrite of the table."""
        state = self.table.state()
        rows = self.table.read(state=state)
        blocks = rows.filter("block is not null")
        each = blocks.filter("ids is not null").select("block", F.posexplode(F.arrays_zip("ids", "generations")).alias("doc", "x")).select("block", "doc", F.col("x.ids").alias("id"), F.col("x.generations").alias("generation")).filter("id is not null")
        stay = self._live(each, rows).groupBy("id").agg(F.min(F.struct("block", "doc")).alias("x"))
        alive = stay.groupBy("x.block").agg(F.collect_list("x.doc").alias("alive"))
        kept = blocks.join(alive, "block").select("alive", *self.table.schema.names)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in self.table.schema)
        return self.table.overwrite(kept.mapInArrow(_kept, schema).filter("ids is not null or size(docs) > 0"), state)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of blocks with the texts of the first column only; ids of the others are null, so that the numbers of texts stay."""
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            alive = np.array(row.pop("alive"))
            if row["ids"] is not None:
                there = np.isin(np.arange(len(row["ids"])), alive).tolist()
                row["ids"] = [x if a else None for x, a in zip(row["ids"], there)]
            else:
                there, counts = np.isin(row["docs"], alive), np.array(row["counts"])
                row |= {"docs": np.array(row["docs"])[there].tolist(), "counts": counts[there].tolist(), "places": np.array(row["places"])[np.repeat(there, counts)].tolist()}
            rows.append(row)
        yield pa.RecordBatch.from_pylist(rows, pa.schema(list(batch.schema)[1:]))
