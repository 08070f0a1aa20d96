"""Written indexes that prune: entries of each text name the candidates of a query, and the texts themselves decide.

One keyed table holds the texts, and the postings of entries in blocks: what a run of texts holds of an entry, ids and places, is one
row (see postings.py), in buckets by the entry and a part of the blocks, so that a frequent entry lies in several. A change writes the
new texts and blocks of their entries in one commit; entries of the old text stay, so what the table holds is always a superset: they can name a candidate too many, never one too few, and
every candidate is checked against its text as it is now. optimize() drops them.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from decimal import Decimal
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.operators import postings
from loomwright.operators.keyed import KeyedTable
from loomwright.operators.retrieval import top
from loomwright.session import materialise

#: Parts of an entry's blocks, and of the texts; what an entry of a text begins with, and what stands in its place for the text and for what a block has of its own.
PARTS, TEXT_PARTS, ENTRY, TEXT, BLOCK = 8, 256, "e", "t", "b"


class CandidateIndex:
    """Create with create(), or open with its class(spark, root). Ids are of any type that can be a key; rows without an id take no part."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.table = spark, KeyedTable(spark, root)

    @classmethod
    def create(cls, spark: SparkSession, root: str, id_type: str = "string", buckets: int = 64) -> CandidateIndex:
        schema = f"entry string, part int, block long, id {id_type}, {cls.POSTINGS.format(id_type)}, text string"
        KeyedTable.create(spark, root, schema, ["entry", "part", "block", "id"], buckets, ["entry", "part"], codec=cls.CODEC)
        return cls(spark, root)

    #: The columns of postings; how files are compressed (None: as the session says); whether texts and postings are written by the tasks that read them, without a shuffle.
    POSTINGS, CODEC, STAY = "ids array<{}>", None, False

    def prepared(self, text: Column) -> Column:
        """What entries are made of."""
        return text

    @staticmethod
    def find(batch: pa.RecordBatch) -> postings.Found:
        """The entries of a batch(id, text); distinct ones of each text, if places aren't kept."""
        raise NotImplementedError

    @property
    def id_type(self) -> str:
        return self.table.schema["id"].dataType.simpleString()

    def _part(self, parts: int) -> Column:
        return F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part")

    def _posted(self, texts: DataFrame) -> DataFrame:
        """The rows of postings of texts(id, text)."""
        posted = postings.blocks(texts, self.find, self.id_type, PARTS, False)
        return posted.select(F.concat(F.lit(ENTRY), "entry").alias("entry"), "part", "block", "ids")

    def _rows(self, texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
        """Rows of the table; repeated rows count once, and ValueError if an id has unlike texts."""
        one = postings.once(texts.select(F.col(id_col).cast(self.id_type).alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null"))
        return self._posted(one.select("id", self.prepared(F.col("text")).alias("text"))).unionByName(one.select(F.lit(TEXT).alias("entry"), self._part(TEXT_PARTS), "id", "text"), allowMissingColumns=True)

    def build(self, texts: DataFrame, id_col: str = "id", text_col: str = "text") -> int:
        """All of texts, in an index that is empty."""
        if self.table.state().files:
            raise ValueError("the index isn't empty")
        return self.table.overwrite(self._rows(texts, id_col, text_col), stay=self.STAY)

    def upsert(self, texts: DataFrame, id_col: str = "id", text_col: str = "text") -> int:
        """New and changed texts; only they and their entries are written."""
        return self.table.upsert(self._rows(texts, id_col, text_col), unique=True, stay=self.STAY)

    def delete(self, ids: DataFrame, id_col: str = "id") -> int:
        """These ids are found no longer; only their texts go now."""
        gone = ids.select(F.col(id_col).alias("id")).filter("id is not null").select(F.lit(TEXT).alias("entry"), self._part(TEXT_PARTS), F.lit(None).cast("long").alias("block"), "id")
        return self.table.delete(gone)

    def texts(self) -> DataFrame:
        """id and text of all."""
        return self.table.read(where=lambda rows: rows.filter(F.col("entry") == TEXT)).select("id", "text")

    def holders(self, wanted: list[str]) -> DataFrame:
        """entry, block and ids of all that hold one of these distinct entries, or did before a change; reads the buckets of these entries."""
        buckets = self.table.buckets_of(self.spark.createDataFrame([(ENTRY + w, p) for w in wanted for p in range(PARTS)], "entry string, part int"))
        rows = self.table.read(buckets=buckets, where=lambda rows: rows.filter(F.col("entry").isin(*(ENTRY + w for w in wanted))))
        return rows.select(F.substr("entry", F.lit(len(ENTRY) + 1)).alias("entry"), "block", "ids")

    def candidates(self, wanted: list[str], need: int | None = None) -> DataFrame:
        """Ids that hold at least so many of these distinct entries; all of them, if need is None. An id's entries lie in one block."""
        least = len(wanted) if need is None else need

        def some(block: pa.Table) -> pa.Table:
            found = pc.value_counts(block["ids"].combine_chunks().flatten() if block.num_rows >= least else block["ids"].combine_chunks().flatten().slice(0, 0))
            return pa.table({"id": found.field("values").filter(pc.greater_equal(found.field("counts"), least))})

        return self.holders(wanted).select("block", "ids").groupBy("block").applyInArrow(some, f"id {self.id_type}").distinct()

    def checked(self, ids: DataFrame | None, holds: Column) -> DataFrame:
        """id and text of the candidates for which holds is true of the column text; of all texts, if ids is None. Reads the parts of the texts where candidates lie."""
        if ids is None:
            return self.texts().filter(holds)
        ids = materialise(ids, "candidates", small=True)
        named = F.broadcast(ids) if ids.count() <= postings.BROADCAST else ids
        buckets = self.table.buckets_of(ids.select(F.lit(TEXT).alias("entry"), self._part(TEXT_PARTS)).distinct())
        return self.table.read(buckets=buckets, where=lambda rows: rows.filter(F.col("entry") == TEXT).join(named, "id", "left_semi")).filter(holds).select("id", "text")

    def optimize(self) -> int:
        """Entries that no text holds any more go, as one rewrite of the table; Conflict if another writer changed it meanwhile."""
        state = self.table.state()
        texts = self.table.read(state=state).filter(F.col("entry") == TEXT)
        return self.table.overwrite(self._rows(texts, "id", "text"), state, stay=self.STAY)


def fold(text: Column) -> Column:
    """Lower case, letter by letter: the final sigma, whose lower case depends on its neighbours, is a sigma."""
    return F.replace(F.lower(text), F.lit("ς"), F.lit("σ"))


def trigrams(text: Column) -> Column:
    """The runs of three characters of a folded text, in order; none in shorter ones."""
    made = lambda c: F.transform(F.slice(c, 1, F.greatest(F.size(c) - 2, F.lit(0))), lambda x, i: F.concat(x, F.get(c, i + 1), F.get(c, i + 2)))
    # the characters are a lambda's variable, so that they are split once and not for each place
    return F.transform(F.array(F.split(fold(text), "")), made)[0]


def literals(pattern: str, escape: str = "\\") -> list[str]:
    """The runs of plain characters in a LIKE pattern; ValueError if it ends with the escape or escapes anything but a wildcard or itself."""
    runs, rest = [""], iter(pattern)
    for c in rest:
        if c == escape:
            c = next(rest, "")
            if c not in ("%", "_", escape):
                raise ValueError("bad escape in a pattern")
            runs[-1] += c
        elif c in "%_":
            runs.append("")
        else:
            runs[-1] += c
    return [r for r in runs if r]


class TrigramIndex(CandidateIndex):
    """Substrings, LIKE patterns and similar texts by runs of three characters and their places.

    Null texts match nothing. Patterns without three plain characters in a row have no entries: all texts are checked.
    Places are most of the index. Packed and compressed they take 1.4 bytes a character where there are some 10,000 trigrams, which is
    near their entropy, and they are written where they are made, for a shuffle would hold them once more.
    """

    POSTINGS, CODEC, STAY = "ids array<{}>, sizes array<int>, places binary", "zstd", True
    #: Parts of an entry's blocks, and of the blocks' own rows.
    PARTS = 4
    #: Entries that a run looks up at most; those of a longer one are taken evenly over it, which checks more candidates but misses none.
    LOOKUPS = 16

    def prepared(self, text: Column) -> Column:
        return fold(text)

    def _posted(self, texts: DataFrame) -> DataFrame:
        posted = postings.trigram_blocks(texts, self.id_type, self.PARTS)
        return posted.withColumn("entry", F.coalesce(F.concat(F.lit(ENTRY), "entry"), F.lit(BLOCK)))

    def holders(self, wanted: list[str]) -> DataFrame:
        """entry, block, ids, sizes and places of all blocks that hold one of these distinct entries, and without an entry, of each block's texts; reads the buckets of these."""
        names = [BLOCK, *(ENTRY + w for w in wanted)]
        buckets = self.table.buckets_of(self.spark.createDataFrame([(n, p) for n in names for p in range(self.PARTS)], "entry string, part int"))
        rows = self.table.read(buckets=buckets, where=lambda rows: rows.filter(F.col("entry").isin(*names)))
        return rows.select(F.when(F.col("entry") != BLOCK, F.substr("entry", F.lit(len(ENTRY) + 1))).alias("entry"), "block", "ids", "sizes", "places")

    def _ids(self, wanted: list[str], texts: Callable[[postings.TrigramBlock], np.ndarray]) -> DataFrame:
        """Ids of the texts that a function names by their numbers in each block."""

        def named(table: pa.Table) -> pa.Table:
            block = postings.TrigramBlock(table)
            return pa.table({"id": block.ids.take(pa.array(texts(block), pa.int64()))})

        return self.holders(wanted).groupBy("block").applyInArrow(named, f"id {self.id_type}").distinct()

    def candidates(self, wanted: list[str], need: int | None = None) -> DataFrame:
        least = len(wanted) if need is None else need
        return self._ids(wanted, lambda block: np.nonzero(block.counts(wanted) >= least)[0] if len(block.row) >= least else np.empty(0, np.int64))

    def of(self, *texts: str) -> list[list[str]]:
        """The entries of each text, in order; computed by Spark, like those of the table."""
        rows = self.spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", trigrams(F.col("t")).alias("g")).collect()
        return [r.g for r in sorted(rows, key=lambda r: r.i)]

    def _cover(self, run: list[str]) -> list[int]:
        """Places of a run's entries that together cover it, as far as LOOKUPS allows."""
        places = sorted({*range(0, len(run), 3), len(run) - 1}) if run else []
        step = len(places) / self.LOOKUPS
        return places if step <= 1 else [places[int(i * step)] for i in range(self.LOOKUPS)]

    def holding(self, *runs: str) -> DataFrame | None:
        """Ids whose folded texts hold each of these strings, by the places of its entries; None if no string has entries."""
        found = [[(g[i], i) for i in self._cover(g)] for g in (self.of(*runs) if runs else [])]
        found = list(filter(None, found))
        names = list(dict.fromkeys(g for run in found for g, _ in run))
        if not names:
            return None

        def follow(block: postings.TrigramBlock) -> np.ndarray:
            held = [block.following(run) for run in found]
            both = held[0]
            for x in held[1:]:
                both = np.intersect1d(both, x, assume_unique=True)
            return both

        return self._ids(names, follow)

    def contains(self, part: str, ignore_case: bool = False) -> DataFrame:
        """id and text of the texts that contain a string."""
        holds = F.contains(fold(F.col("text")), fold(F.lit(part))) if ignore_case else F.contains("text", F.lit(part))
        return self.checked(self.holding(part), holds)

    def like(self, pattern: str, ignore_case: bool = False) -> DataFrame:
        """id and text of the texts that match a pattern of LIKE (% any run, _ one character, \\ escapes these)."""
        text, wanted = (fold(F.col("text")), fold(F.lit(pattern))) if ignore_case else (F.col("text"), F.lit(pattern))
        return self.checked(self.holding(*literals(pattern)), F.like(text, wanted))

    def similar(self, text: str, threshold: float = 0.3, k: int = 20) -> DataFrame:
        """id, score, rank of the k texts of at least that similarity, ties by id: trigrams that both hold over those that one holds.

        A text of similarity t to one with n trigrams holds at least t * n of them, which counts before any text is read. A text without trigrams is like none.
        """
        if not 0 < threshold <= 1:
            raise ValueError("a threshold above 0 and up to 1")
        wanted = list(dict.fromkeys(self.of(text)[0]))
        if not wanted:
            return top(self.texts().limit(0).select("id", F.lit(0.0).alias("score")), k, F.desc("score"), F.asc("id"))
        mine = F.array(*map(F.lit, wanted))
        need = max(1, math.ceil(threshold * len(wanted) - 1e-9))
        both = self.checked(self.candidates(wanted, need), F.col("text").isNotNull()).select("id", F.array_distinct(trigrams(F.col("text"))).alias("g"))
        both = both.select("id", F.size("g").alias("n"), F.size(F.array_intersect("g", mine)).cast("double").alias("c"))
        found = both.select("id", (F.col("c") / (F.col("n") + len(wanted) - F.col("c"))).alias("score")).filter(F.col("score") >= threshold)
        return top(found, k, F.desc("score"), F.asc("id"))


def paths(value: object) -> list[str]:
    """Where each scalar, object and array of a JSON value lies: keys in order, [] for any place of an array, then what is there.

    Whatever contains a value holds all of its paths. Scalars of an array at the top lie at the top as well, for it contains them.
    """
    found: dict[str, None] = {}
    left: list[tuple[str, object]] = [("", value)] + [("", x) for x in (value if isinstance(value, list) else []) if not isinstance(x, (dict, list))]
    while left:
        at, x = left.pop()
        if isinstance(x, dict):
            found[f"{at} {{}}"] = None
            left += [(f"{at}.{json.dumps(k)}", y) for k, y in x.items()]
        elif isinstance(x, list):
            found[f"{at} []"] = None
            left += [(f"{at}[]", y) for y in x]
        else:
            # equal numbers are one entry; doubles, so that those that differ by a rounding are candidates of each other
            number = isinstance(x, (int, float, Decimal)) and not isinstance(x, bool)
            found[f"{at} {float(x) + 0.0!r}" if number else f"{at} {json.dumps(x)}"] = None
    return list(found)


@lru_cache(32_768)
def text_paths(text: str | None) -> list[str]:
    """paths() of a JSON text; none of what can't be read."""
    try:
        return paths(json.loads(text, parse_int=float, parse_float=float)) if text else []
    except (ValueError, RecursionError):
        return []


def _is(v: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, path, kind)


def _quoted(key: str) -> str:
    if "'" in key and '"' in key:
        raise ValueError("a key with both kinds of quotes can't be a path")
    return f'["{key}"]' if "'" in key else f"['{key}']"


def variant_contains(v: Column, wanted: object, top_level: bool = True) -> Column:
    """Whether a VARIANT contains a JSON value (dict, list, str, int, float, Decimal, bool, None); never null.

    An object contains one whose keys it has, each with a value that contains the other's; an array contains one each of
    whose members one of its own members contains, whatever their order and number; other values contain their equals,
    1 and 1.0 being equal and a number never equal to a string. At the top, an array contains a plain value that is one of its
    members. JSON null is a value: a key that is absent doesn't contain it. SQL null contains nothing.
    """
    all_of = lambda cs: F.coalesce(F.forall(F.array(*cs), lambda c: c), F.lit(False)) if len(cs) > 1 else cs[0]
    if isinstance(wanted, dict):
        return all_of([_is(v, "OBJECT")] + [variant_contains(_get(v, f"${_quoted(k)}", "variant"), x, False) for k, x in wanted.items()])
    members = _get(v, "$", "array<variant>")
    has = lambda x: F.coalesce(F.exists(members, lambda m: variant_contains(m, x, False)), F.lit(False))
    if isinstance(wanted, list):
        return all_of([_is(v, "ARRAY")] + [has(x) for x in wanted])
    if wanted is None:
        same = F.is_variant_null(v)
    elif isinstance(wanted, bool):
        same = _is(v, "BOOLEAN") & (_get(v, "$", "boolean") == wanted)
    elif isinstance(wanted, str):
        same = _is(v, "STRING") & (_get(v, "$", "string") == wanted)
    else:
        number = _is(v, "BIGINT") | _is(v, "DECIMAL") | _is(v, "DOUBLE")
        same = number & (_get(v, "$", "double") == float(wanted))
        exact = Decimal(str(wanted))
        if exact == exact.to_integral_value() and abs(exact) < 10**20:  # doubles round integers beyond 2^53
            same = same & F.coalesce(_get(v, "$", "decimal(38,0)") == F.lit(exact.quantize(Decimal(1))).cast("decimal(38,0)"), F.lit(False))
    same = F.coalesce(same, F.lit(False))
    return same | has(wanted) if top_level else same


class JsonIndex(CandidateIndex):
    """JSON texts by what they contain. Texts that aren't JSON, or have a key twice in one object, contain nothing."""

    @staticmethod
    def find(batch: pa.RecordBatch) -> postings.Found:
        texts = pc.dictionary_encode(pc.fill_null(batch.column(1), ""))  # equal texts are read once
        made = pa.array([text_paths(t) for t in texts.dictionary.to_pylist()], pa.list_(pa.string()))
        return postings.of_lists(made.take(texts.indices))

    def contains(self, wanted: object, also: Callable[[Column], Column] | None = None) -> DataFrame:
        """id and text of those that contain a JSON value (dict, list, str, number, bool, None); also: a further condition on the VARIANT."""
        v = F.try_parse_json("text")
        holds = variant_contains(v, wanted)
        return self.checked(self.candidates(paths(wanted)), holds & F.coalesce(also(v), F.lit(False)) if also else holds)
