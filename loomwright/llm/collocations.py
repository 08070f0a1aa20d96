"""Collocations: phrases whose words come together more often than apart, mined by pivots.

Every phrase is counted where its rarest word, its pivot, is: for each occurrence of a frequent word the words around it that
aren't rarer are routed to that word, as a weighted fragment. Rarer words and words too rare to be in any phrase end a
fragment, and equal fragments of a slice of text are one row. All occurrences of a phrase are in the fragments of its pivot, so
each pivot's phrases are counted where its fragments meet, and only those that it owns: ties go to the leftmost word.

The order of words needs no table of all of them. The most frequent words, TABLE at most, are sent to all workers; the others
come after them in the order of the counts of hashed buckets, and a bucket without a frequent word is known to hold none.
Words whose fragments could fill a task are dealt in parts by their fragments' hash, and the counts of parts are added.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.session import materialise

#: Words of the longest phrase, occurrences of a phrase, phrases of a language, and how often (in hundredths) a longer phrase takes a phrase's place.
LONGEST, LEAST, TOP, INSIDE = 4, 30, 2000, 80
#: Words that all workers know, buckets of all other words, and the rows that find their counts without a shuffle.
TABLE, BUCKETS = 1 << 18, 1 << 20
#: Bytes of text that are cut at a time, occurrences of a word that one part gets, fragments that are counted at a time.
SLICE, PART, FRAGMENTS = 8 << 20, 1 << 18, 300_000
#: Parts in which the first phrases of a language are found before they meet.
SPREAD = 64

REACH = LONGEST - 1
#: No rank: the word is in no phrase, or no word at all.
NONE = np.iinfo(np.int32).max
#: A-Z become lower case, ends of pieces line breaks, and tabs spaces.
_PLAIN = bytes(c + 32 if 65 <= c <= 90 else 10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))


def _text(binary: pa.Array) -> pa.Array:
    return binary.cast(options=pc.CastOptions(target_type=pa.string(), allow_invalid_utf8=True))


def _slices(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) of batches of (lang, text), of `most` bytes; a longer text is a slice of its own."""
    for batch in batches:
        langs, all_texts = batch["lang"].dictionary_encode(), batch["text"].cast(pa.binary()).to_pylist()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            held, size = [], 0
            for text in compress(all_texts, (langs.indices.to_numpy() == code).tolist()):
                if held and size + len(text) > most:
                    yield lang, held
                    held, size = [], 0
                held.append(text)
                size += len(text)
            if held:
                yield lang, held


def words(texts: list[bytes]) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words of all pieces, -1 between pieces, and the distinct words that the codes number."""
    pieces = [found for found in (piece.split() for piece in b"\n".join(texts).translate(_PLAIN).split(b"\n")) if found]
    many = np.fromiter(map(len, pieces), np.int64, len(pieces))
    coded = pa.array(list(chain.from_iterable(pieces)), pa.binary()).dictionary_encode()
    out = np.full(int(many.sum()) + len(pieces), -1, np.int32)
    out[np.arange(many.sum()) + np.repeat(np.arange(len(pieces)), many)] = coded.indices.to_numpy()
    return out, coded.dictionary


def _batch(names: list[str], *columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([_text(c) if pa.types.is_binary(c.type) else c for c in columns], names=names)


def _counter(most: int):
    """(lang, word, n) of each slice; the row without a word has the number of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _slices(batches, most):
            codes, known = words(texts)
            n = np.bincount(codes[codes >= 0], minlength=len(known))
            yield _batch(["lang", "word", "n"], pa.array([lang] * (len(n) + 1), pa.string()), pa.concat_arrays([known, pa.nulls(1, pa.binary())]), pa.array(np.append(n, n.sum())))

    return run


class Ranks:
    """The order of words, the most frequent first, and in how many parts each one's fragments are dealt."""

    def __init__(self, table: pa.Table, buckets: dict[int, int]) -> None:
        self.of: dict[str, tuple[pa.Array, np.ndarray]] = {}
        for lang in pc.unique(table["lang"]).to_pylist():
            rank = np.nonzero(pc.equal(table["lang"], lang).to_numpy())[0].astype(np.int32)
            self.of[lang] = table["word"].take(pa.array(rank)).combine_chunks().cast(pa.binary()), rank
        self.bucket, self.buckets = None, BUCKETS
        counts = table["f"].to_numpy()
        if buckets:
            order = sorted(buckets, key=lambda b: (-buckets[b], b))
            self.bucket = np.full(BUCKETS, NONE, np.int32)
            self.bucket[order] = len(counts) + np.arange(len(order))
            counts = np.append(counts, [buckets[b] for b in order])
        self.parts = np.maximum(1, -(-counts // PART))

    def __call__(self, lang: str, known: pa.Array) -> np.ndarray:
        """The rank of each word, NONE for those in no phrase."""
        listed, rank = self.of.get(lang, (pa.array([], pa.binary()), np.zeros(0, np.int32)))
        at = pc.fill_null(pc.index_in(known, value_set=listed), -1).to_numpy()
        out = np.append(rank, NONE)[at]
        if self.bucket is not None:
            mark = lang.encode() + b"\0"
            other = np.nonzero(at < 0)[0]
            hashed = np.fromiter((zlib.crc32(mark + w) for w in known.take(pa.array(other)).to_pylist()), np.int64, len(other))
            out[other] = self.bucket[hashed % self.buckets]
        return out


def _distinct(rows: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the distinct rows of a matrix the place of one, and for each row the number of its distinct one. hashed: a hash of each row."""
    _, first, which = np.unique(hashed, return_index=True, return_inverse=True)
    if not (rows[first[which]] == rows).all():  # unlike rows with one hash
        _, first, which = np.unique(rows, axis=0, return_index=True, return_inverse=True)
    return first, which.ravel()


def _mixed(columns: np.ndarray) -> np.ndarray:
    """A hash of each row of a matrix of unsigned 64-bit numbers."""
    out = np.zeros(len(columns), np.uint64)
    for column in columns.T:
        out = (out ^ column) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def _joined(known: pa.Array, codes: np.ndarray) -> pa.Array:
    """The words of each row of codes with spaces between them; -1 is no word."""
    some = (codes >= 0).any(1)  # the join has no row where all are null
    columns = [known.take(pa.array(c, mask=c < 0)) for c in codes[some].T]
    joined = pc.binary_join_element_wise(*columns, pa.scalar(b" ", known.type), null_handling="skip")
    return pc.fill_null(joined.take(pa.array(np.cumsum(some) - 1, mask=~some)), pa.scalar(b"", known.type))


def fragments(codes: np.ndarray, known: pa.Array, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct fragments, as codes of up to REACH words before the pivot, the pivot, and up to REACH after it; how often each is there; and a hash of its words."""
    held = np.concatenate([np.full(REACH, -1, np.int32), codes, np.full(REACH, -1, np.int32)])
    ranks = np.append(rank, NONE)[held].astype(np.int32)  # code -1 takes the last
    here = ranks[REACH : len(ranks) - REACH]
    out = np.full((len(codes), 2 * REACH + 1), -1, np.int32)
    out[:, REACH] = codes
    for step in (-1, 1):
        going = here < NONE
        for far in range(1, REACH + 1):
            there = slice(REACH + step * far, len(ranks) - REACH + step * far)
            # an equal word to the left owns the phrases of both
            going = going & (ranks[there] < here if step < 0 else ranks[there] <= here)
            out[going, REACH + step * far] = held[there][going]
    out = out[(out[:, REACH - 1] >= 0) | (out[:, REACH + 1] >= 0)]
    of_word = np.append(pd.util.hash_array(np.array(known.to_pylist(), dtype=object), categorize=False), np.uint64(1))
    hashed = _mixed(of_word[out])
    first, which = _distinct(out, hashed)
    return out[first], np.bincount(which, minlength=len(first)), hashed[first]


_ROUTED = "lang string, pivot string, part int, left array<string>, right array<string>, n array<long>"


def _router(ranks: Broadcast, most: int):
    """Rows of (lang, text) become fragments, those of one pivot in one row for each slice; part is -1 where a pivot isn't dealt in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, texts in _slices(batches, most):
            codes, known = words(texts)
            rank = ranks.value(lang, known)
            found, n, hashed = fragments(codes, known, rank)
            if not len(found):
                continue
            parts = ranks.value.parts[rank[found[:, REACH]]]
            part = np.where(parts > 1, (hashed % parts.astype(np.uint64)).astype(np.int64), -1)
            order = np.lexsort((part, found[:, REACH]))
            found, n, part = found[order], n[order], part[order]
            begin = np.nonzero(np.append(True, (found[1:, REACH] != found[:-1, REACH]) | (part[1:] != part[:-1])))[0]
            left, right = (_text(_joined(known, side)) for side in (found[:, :REACH], found[:, REACH + 1 :]))
            stops = np.append(begin, len(found)).astype(np.int32)
            for at in range(0, len(begin), 20_000):
                some = stops[at : at + 20_001]
                listed = [pa.ListArray.from_arrays(pa.array(some - some[0]), c.slice(some[0], some[-1] - some[0])) for c in (left, right, pa.array(n))]
                b = begin[at : at + 20_000]
                yield _batch(["lang", "pivot", "part", "left", "right", "n"], pa.array([lang] * len(b), pa.string()), known.take(pa.array(found[b, REACH])), pa.array(part[b], pa.int32()), *listed)

    return run


def _split(lines: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """How many words each line has, and all words."""
    found = pc.split_pattern(lines, " ")
    flat = found.flatten()
    many = np.where(pc.binary_length(lines).to_numpy() > 0, pc.list_value_length(found).to_numpy(), 0)
    return many, flat.filter(pc.greater(pc.binary_length(flat), 0))


def owned_phrases(rows: pa.Table, least: int) -> pa.RecordBatch:
    """lang, phrase, a of the phrases that the pivots of rows own; those of pivots that aren't in parts at least `least` times."""
    size = pc.list_value_length(rows["left"]).to_numpy()
    row = np.repeat(np.arange(rows.num_rows), size)
    (before, left), (after, right) = (_split(pc.list_flatten(rows[c]).combine_chunks()) for c in ("left", "right"))
    n = pc.list_flatten(rows["n"]).to_numpy()
    coded = pa.concat_arrays([left, right, rows["pivot"].combine_chunks()]).dictionary_encode()
    codes = coded.indices.to_numpy()
    m = np.full((len(row), 2 * REACH + 1), -1, np.int32)
    m[:, REACH] = codes[len(left) + len(right) :][row]
    place = lambda many: np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    m[np.repeat(np.arange(len(row)), before), REACH - np.repeat(before, before) + place(before)] = codes[: len(left)]
    m[np.repeat(np.arange(len(row)), after), REACH + 1 + place(after)] = codes[len(left) : len(left) + len(right)]
    langs = rows["lang"].combine_chunks().dictionary_encode().indices.to_numpy()[row]
    whole = (rows["part"].to_numpy() < 0)[row]
    out = [(np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64))]
    for s in range(REACH + 1):
        for e in range(REACH + 1 - s):
            if s + e:
                some = np.nonzero((before >= s) & (after >= e))[0]
                phrase = np.column_stack([langs[some], m[some, REACH - s : REACH + e + 1]])
                first, which = _distinct(phrase, _mixed(phrase.astype(np.uint64)))
                a = np.zeros(len(first), np.int64)
                np.add.at(a, which, n[some])
                kept = (a >= least) | ~whole[some[first]]
                out.append((row[some[first[kept]]], _joined(coded.dictionary, phrase[first[kept], 1:]), a[kept]))
    at = pa.array(np.concatenate([o[0] for o in out]))
    return pa.RecordBatch.from_arrays([rows["lang"].take(at).combine_chunks(), pa.concat_arrays([o[1] for o in out]), pa.array(np.concatenate([o[2] for o in out]))], names=["lang", "phrase", "a"])


def _miner(least: int):
    """Sorted rows of a partition: the pivots that are whole are counted together, many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            size += len(pc.list_flatten(batch["n"]))
            if size >= FRAGMENTS:
                rows = pa.concat_tables(held)
                last = rows.slice(rows.num_rows - 1)
                same = pc.and_(pc.equal(rows["pivot"], last["pivot"][0]), pc.and_(pc.equal(rows["lang"], last["lang"][0]), pc.equal(rows["part"], last["part"][0])))
                rest = rows.filter(same)  # the next batch may go on with it
                done = rows.slice(0, rows.num_rows - rest.num_rows)
                if done.num_rows:
                    yield owned_phrases(done, least)
                held, size = [rest], len(pc.list_flatten(rest["n"]))
        if held:
            yield owned_phrases(pa.concat_tables(held), least)

    return run


def _ranks(frequent: DataFrame) -> Ranks:
    """The order of frequent(lang, word, f)."""
    order = [F.desc("f"), F.asc("lang"), F.asc("word")]
    table = frequent.orderBy(*order).limit(TABLE).toArrow()
    buckets: dict[int, int] = {}
    if table.num_rows == TABLE:
        f, lang, word = (table[c][TABLE - 1].as_py() for c in ("f", "lang", "word"))
        after = (F.col("f") < f) | ((F.col("f") == f) & ((F.col("lang") > lang) | ((F.col("lang") == lang) & (F.col("word") > word))))
        bucket = F.pmod(F.crc32(F.concat(F.encode("lang", "UTF-8"), F.lit(bytearray(1)), F.encode("word", "UTF-8"))), F.lit(BUCKETS))
        buckets = {r[0]: r[1] for r in frequent.filter(after).groupBy(bucket.cast("int").alias("b")).agg(F.sum("f")).collect()}  # BUCKETS rows at most
    return Ranks(table, buckets)


def phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, phrases, totals) of docs(lang, text): lang, phrase, a of the words and of the phrases of 2 to LONGEST words that are there `least` times; lang, n of all languages."""
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = texts.mapInArrow(_counter(SLICE), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("f"))
    kept = materialise(counts.filter((F.col("f") >= least) | F.col("word").isNull()), "words")
    frequent = kept.filter("word is not null")
    ranks = docs.sparkSession.sparkContext.broadcast(_ranks(frequent))  # TABLE words and BUCKETS counts at most
    routed = texts.mapInArrow(_router(ranks, SLICE), _ROUTED).repartition("lang", "pivot", "part").sortWithinPartitions("lang", "pivot", "part")
    mined = routed.mapInArrow(_miner(least), "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))
    return frequent.select("lang", F.col("word").alias("phrase"), F.col("f").alias("a")), materialise(mined.filter(F.col("a") >= least), "phrases"), kept.filter("word is null").select("lang", F.col("f").alias("n"))


def _big(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, inside: int = INSIDE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language of docs(lang, text).

    Texts are lower-cased (A-Z), cut at `[.,;:!?\\x0A-\\x0D]`, and words are runs without spaces and tabs. a: how often a phrase
    of 2 to LONGEST words is there, overlaps included, `least` at least; l and r: the same of its two parts at the cut with the
    lowest score floor(2000000 * a / (l + r)), the leftmost on ties; n: all words of the language. A phrase goes if a longer one
    around it is there `inside` hundredths as often. Highest score first, then a, then the phrase in byte order.

    Null texts are empty, the null language is `und`, and so the same as a language of that name. Repeated documents count each
    time. Languages without a phrase have no row; an empty table gives an empty one. Other columns are ignored.
    """
    single, found, totals = phrases(docs, least)
    known = single.unionByName(found)
    # counts that many rows look up are among the highest, which are sent to all workers; any other key has a small share
    head = F.broadcast(materialise(known.orderBy(F.desc("a"), "lang", "phrase").limit(TABLE), "head", small=True).withColumnsRenamed({"phrase": "part", "a": "f"}))
    split = found.withColumn("w", F.split("phrase", " "))
    cut = lambda begin, many: F.array_join(F.slice("w", begin, many), " ")
    sides = lambda k: [F.struct(F.lit(2 * k).alias("slot"), cut(1, k).alias("part")), F.struct(F.lit(2 * k + 1).alias("slot"), cut(k + 1, LONGEST).alias("part"))]
    asked = F.filter(F.array(*(s for k in range(1, LONGEST) for s in sides(k))), lambda x: F.floor(x["slot"] / 2) < F.size("w"))
    asked = split.select("lang", "phrase", F.explode(asked).alias("x")).select("lang", "phrase", "x.slot", "x.part")
    quick = asked.join(head, ["lang", "part"], "left")
    slow = quick.filter("f is null").drop("f").join(known.withColumnsRenamed({"phrase": "part", "a": "f"}), ["lang", "part"])
    columns = ["lang", "phrase", "slot", "f"]
    # slot 0: how often the phrase itself is there; slot 1: the longer phrases around it
    around = F.explode(F.array_distinct(F.array(*(cut(i, k) for k in range(2, LONGEST) for i in range(1, LONGEST - k + 2)))))
    longer = split.filter(F.size("w") > 2).select("lang", F.lit(1).alias("slot"), F.col("a").alias("f"), F.size("w").alias("size"), around.alias("phrase"))
    longer = longer.filter((F.size(F.split("phrase", " ")) < F.col("size")) & F.col("phrase").contains(" "))
    rows = quick.filter("f is not null").select(columns).union(slow.select(columns)).union(found.select("lang", "phrase", F.lit(0), "a")).union(longer.select(columns))
    one = rows.groupBy("lang", "phrase").agg(*(F.max(F.when(F.col("slot") == i, F.col("f"))).alias(f"f{i}") for i in range(2 * LONGEST)))
    score = lambda k: F.expr(f"2000000 * cast(f0 as decimal(20,0)) div (cast(f{2 * k} as decimal(20,0)) + cast(f{2 * k + 1} as decimal(20,0)))")
    cuts = F.array(*(F.when(F.col(f"f{2 * k}").isNotNull(), F.struct(score(k).alias("score"), F.lit(k).alias("k"), F.col(f"f{2 * k}").alias("l"), F.col(f"f{2 * k + 1}").alias("r"))) for k in range(1, LONGEST)))
    lasting = F.coalesce(100 * _big(F.col("f1")) < inside * _big(F.col("f0")), F.lit(True))
    scored = one.filter(F.col("f0").isNotNull() & lasting).select("lang", "phrase", F.col("f0").alias("a"), F.array_min(cuts).alias("c")).select("lang", "phrase", "a", "c.l", "c.r", "c.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    place = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    first = scored.withColumn("spread", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).withColumn("rank", place("lang", "spread")).filter(F.col("rank") <= top)
    ranked = first.withColumn("rank", place("lang").cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
