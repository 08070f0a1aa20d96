"""A paged, rate-limited service as a Spark data source: `spark.read.format(name)` for all pages, `readStream` for what is new.

Spark's reader tasks ask for pages themselves. The allowed rate is shared out over the tasks, calls are repeated after a
growing pause, and a page or a detail that fails for good becomes a row with its error, so that the others arrive.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol, TypeVar

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: number: the page's, or of the change. item, detail: JSON. error: what went wrong last, null if nothing did.
SCHEMA = "number long, key string, item string, detail string, error string"

Answer = TypeVar("Answer")


class Service(Protocol):
    """What the source asks of a service; it travels to the tasks. Any failure is an exception."""

    def pages(self) -> int:
        """How many pages there are, numbered from 1."""

    def page(self, number: int) -> list[dict]:
        """The items of a page."""

    def key(self, item: dict) -> str:
        """What tells items apart."""

    def detail(self, key: str) -> dict | None:
        """More about an item."""

    def latest(self) -> int:
        """The number of the last change; 0 without any."""

    def changes(self, after: int, upto: int) -> list[tuple[int, dict]]:
        """Numbered items that were new or changed after one number, up to another."""


@dataclass
class Limits:
    """rate: calls a second, of all tasks together; 0 is unlimited. tries: calls for one answer. pause: seconds before the second call, doubled each time."""

    tasks: int = 4
    rate: float = 0.0
    tries: int = 3
    pause: float = 0.5
    details: bool = False

    @staticmethod
    def of(options: dict[str, str]) -> Limits:
        d = Limits()
        told = {k.lower(): v for k, v in options.items()}
        made = Limits(int(told.get("tasks", d.tasks)), float(told.get("rate", d.rate)), int(told.get("tries", d.tries)), float(told.get("pause", d.pause)), told.get("details", "false").lower() == "true")
        if made.tasks < 1 or made.tries < 1 or made.rate < 0:
            raise ValueError("tasks and tries must be positive")
        return made


@dataclass
class Span(InputPartition):
    """Numbers after one up to another, and how many tasks share the rate."""

    after: int
    upto: int
    tasks: int


def spans(after: int, upto: int, tasks: int) -> list[Span]:
    """The numbers in even runs, one for each task at most."""
    n = max(0, upto - after)
    many = min(tasks, n)
    cuts = [after + n * i // many for i in range(many + 1)] if many else []
    return [Span(a, b, many) for a, b in zip(cuts, cuts[1:])]


class Caller:
    """Calls a service no faster than its share of the rate."""

    def __init__(self, limits: Limits, tasks: int, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep) -> None:
        self.limits, self.clock, self.sleep = limits, clock, sleep
        self.apart = tasks / limits.rate if limits.rate else 0.0
        self.next = clock()

    def __call__(self, ask: Callable[[], Answer]) -> tuple[Answer | None, str | None]:
        """(answer, None), or (None, error) when all tries failed."""
        error = None
        for n in range(self.limits.tries):
            wait = max(self.next - self.clock(), self.limits.pause * 2 ** (n - 1) if n else 0.0)
            if wait > 0:
                self.sleep(wait)
            self.next = self.clock() + self.apart
            try:
                return ask(), None
            except Exception as e:  # noqa: BLE001  becomes the row's error
                error = f"{type(e).__name__}: {e}"
        return None, error

    def row(self, service: Service, number: int, item: dict) -> tuple:
        key = service.key(item)
        detail, error = self(lambda: service.detail(key)) if self.limits.details else (None, None)
        text = lambda x: None if x is None else json.dumps(x, ensure_ascii=False, sort_keys=True)
        return number, key, text(item), text(detail), error


class PageReader(DataSourceReader):
    def __init__(self, service: Service, limits: Limits) -> None:
        self.service, self.limits = service, limits

    def partitions(self) -> list[Span]:
        pages, error = Caller(self.limits, 1)(self.service.pages)
        if pages is None:
            raise RuntimeError(f"the service doesn't say how many pages it has: {error}")
        return spans(0, pages, self.limits.tasks) or [Span(0, 0, 1)]

    def read(self, partition: Span) -> Iterator[tuple]:
        call = Caller(self.limits, partition.tasks)
        for number in range(partition.after + 1, partition.upto + 1):
            items, error = call(lambda: self.service.page(number))
            if items is None:
                yield number, None, None, None, error
            for item in items or []:
                yield call.row(self.service, number, item)


class ChangeReader(DataSourceStreamReader):
    """Offsets are numbers of changes; what lies between two of them is read again in the same way after a failure.

    A change that can't be fetched stops the query, which goes on from there when it is started again: an error row would
    take the place of the items behind it for good.
    """

    def __init__(self, service: Service, limits: Limits) -> None:
        self.service, self.limits = service, limits

    def initialOffset(self) -> dict:
        return {"number": 0}

    def latestOffset(self) -> dict:
        last, error = Caller(self.limits, 1)(self.service.latest)
        if last is None:
            raise RuntimeError(f"the service doesn't say what is new: {error}")
        return {"number": last}

    def partitions(self, start: dict, end: dict) -> list[Span]:
        return spans(start["number"], end["number"], self.limits.tasks)

    def read(self, partition: Span) -> Iterator[tuple]:
        call = Caller(self.limits, partition.tasks)
        found, error = call(lambda: self.service.changes(partition.after, partition.upto))
        if found is None:
            raise RuntimeError(f"changes {partition.after} to {partition.upto}: {error}")
        for number, item in found:
            yield call.row(self.service, number, item)


def register(spark: SparkSession, name: str, service: Service) -> None:
    """Make a service readable as spark.read.format(name) and spark.readStream.format(name); options: tasks, rate, tries, pause, details (see Limits)."""

    class Listing(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return SCHEMA

        def reader(self, schema: object) -> DataSourceReader:
            return PageReader(service, Limits.of(self.options))

        def streamReader(self, schema: object) -> DataSourceStreamReader:
            return ChangeReader(service, Limits.of(self.options))

    spark.dataSource.register(Listing)
