"""Many fixed patterns looked for in one pass over a text."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.session import materialise

#: Patterns of one automaton, which every worker holds; more patterns are looked for in several passes.
MOST = 100_000


def automaton(patterns: Iterable[tuple[int, str]]) -> tuple[object, int | None]:
    """An automaton that gives each pattern's smallest place, and the smallest place of the empty pattern, which is in every text."""
    made, empty = ahocorasick.Automaton(), None
    for place, pattern in patterns:
        if pattern == "":
            empty = place if empty is None else min(empty, place)
        elif pattern is not None and (pattern not in made or made.get(pattern) > place):
            made.add_word(pattern, place)
    if len(made):
        made.make_automaton()
    return made, empty


def _finder(held: Broadcast) -> Callable[[Column], Column]:
    """text -> the smallest place of a pattern of an automaton that it contains."""

    @F.arrow_udf("long")
    def find(texts: pa.Array) -> pa.Array:
        made, empty = held.value
        out = []
        for text in texts.to_pylist():
            found = [place for _, place in made.iter(text)] if text and len(made) else []
            out.append(None if text is None else min(found if empty is None else [*found, empty], default=None))
        return pa.array(out, pa.int64())

    return find


def with_first_match(rows: DataFrame, text: Column, patterns: DataFrame, name: str, most: int = MOST) -> DataFrame:
    """rows with a column: the smallest place among patterns(place, pattern) that the text contains, null without one.

    Case counts. The empty pattern is in every text but null, a null pattern in none. Of equal patterns the smallest place counts.
    A worker holds one automaton of `most` patterns; more patterns are looked for one group after the other, with the rows written between.
    """
    left = ((r[0], r[1]) for r in patterns.select(F.col("place").cast("long"), "pattern").filter("place is not null and pattern is not null").toLocalIterator())
    sent = None
    rows = rows.withColumn(name, F.lit(None).cast("long"))
    while group := list(islice(left, most)):
        if sent is not None:
            rows = materialise(rows, "matched")
            sent.destroy()
        sent = rows.sparkSession.sparkContext.broadcast(automaton(group))  # `most` patterns
        rows = rows.withColumn(name, F.least(F.col(name), _finder(sent)(text)))
    return rows
