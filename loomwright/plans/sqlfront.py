"""A guarded SQL front door: schema text, statement guard, safe execution, a correcting loop, explanations and history."""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession

DEFAULT_LIMIT, MOST_ROWS, SLOW_SECONDS, CACHE_SECONDS, RETRIES = 100, 10_000, 5.0, 600.0, 3
IDENTIFIER = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_WRITES = re.compile(r"^[\s:|+-]*'?(Insert|Create|Drop|Delete|Update|Merge|Alter|Truncate|Replace|Overwrite|Append|Load|Set|Add|\w*Command\b)\w*", re.MULTILINE)
#: Nodes of a parsed statement that only read; whatever else is at its root is refused.
_QUERY = re.compile(r"^'?(Project|Filter|Aggregate|Sort|GlobalLimit|LocalLimit|Distinct|Union|Except|Intersect|Join|SubqueryAlias|CTE|UnresolvedWith|WithCTE|UnresolvedRelation|UnresolvedInlineTable|LocalRelation|OneRowRelation|Range|Window|Having|UnresolvedHaving|WithWindowDefinition|Offset|LateralJoin|Pivot|Generate|UnresolvedTableValuedFunction|Sample)\b")


def clean(sql: str) -> str:
    """Without fences, comments at its beginning and a last semicolon."""
    text = re.sub(r"```(?:sql)?", "", sql, flags=re.IGNORECASE).strip()
    return re.sub(r";\s*$", "", text).strip()


def is_query(spark: SparkSession, sql: str) -> bool:
    """Whether a text parses as one statement that only reads. Names such as updated_at are no matter."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(clean(sql))
    except (ParseException, AnalysisException):
        return False
    tree = plan.toString()
    return bool(_QUERY.match(tree.lstrip("+-: "))) and not _WRITES.search(tree)


def quoted(name: str) -> str:
    """An identifier in upper case and quotes; anything else is refused."""
    if not IDENTIFIER.fullmatch(name):
        raise ValueError(f"not an identifier: {name!r}")
    return f'"{name.upper()}"'


def columns(spark: SparkSession, database: str | None = None) -> list[tuple[str, str, str, str]]:
    """(table, column, type, comment) of all tables and views, by table and place."""
    names = sorted(t.name for t in spark.catalog.listTables(database))
    return [(t, c.name, c.dataType, c.description or "") for t in names for c in spark.catalog.listColumns(f"{database}.{t}" if database else t)]


def describe(found: list[tuple[str, str, str, str]]) -> str:
    """A table heading and a line for each column."""
    out: list[str] = []
    for table, name, kind, comment in found:
        if not out or table != last:
            out.append(f"Table {table}:")
        last = table
        out.append(f"  - {name} ({kind})" + (f": {comment}" if comment else ""))
    return "\n".join(out)


def diagram(found: list[tuple[str, str, str, str]]) -> str:
    """An entity diagram as Mermaid text."""
    out = ["erDiagram"]
    for table in dict.fromkeys(t for t, *_ in found):
        out += [f"  {table} {{", *(f"    {re.sub('[^A-Za-z0-9]+', '_', k).strip('_')} {c}" for t, c, k, _ in found if t == table), "  }"]
    return "\n".join(out)


def explain(df: DataFrame) -> dict[str, str | None]:
    """The plan, and a warning if it holds a product of tables."""
    plan = df._jdf.queryExecution().toString()
    return {"plan": plan, "warning": "cartesian product" if re.search("CartesianProduct|BroadcastNestedLoopJoin", plan) else None}


def limited(df: DataFrame, n: int = DEFAULT_LIMIT, most: int = MOST_ROWS) -> DataFrame:
    """At most n rows, or at most `most` if the whole query, and not only a part of it, has a limit of its own."""
    root = df._jdf.queryExecution().analyzed().nodeName()
    return df.limit(most if root in ("GlobalLimit", "LocalLimit", "LimitAndOffset") else n)


#: What a generator is told, and examples of questions with their queries.
RULES = (
    "You write one SQL query that answers the user's question.",
    "Use only tables and columns of the schema. Only read: SELECT or WITH.",
    f"Add LIMIT {DEFAULT_LIMIT} unless the question asks for a number of rows or an aggregate.",
    "Answer with the query alone.",
)
EXAMPLES = (
    ("How many customers does each region have?", "SELECT r_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"),
    ("Which customers have never ordered?", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)"),
)


def request(question: str, schema: str, error: str | None = None, examples: tuple[tuple[str, str], ...] = EXAMPLES) -> list[dict[str, str]]:
    """Messages for a generator: rules and schema, examples, the question, and the error of the draft before."""
    out = [{"role": "system", "content": "\n".join([*RULES, "", "Schema:", schema])}]
    for asked, sql in examples:
        out += [{"role": "user", "content": asked}, {"role": "assistant", "content": sql}]
    return [*out, {"role": "user", "content": question if error is None else f"{question}\nThe query before failed: {error}"}]


@dataclass
class FrontDoor:
    """generate(question, schema, error) writes SQL; everything else is here."""

    spark: SparkSession
    generate: Callable[[str, str, str | None], str]
    database: str | None = None
    clock: Callable[[], float] = time.monotonic
    timeout: float = 60.0
    history: list[dict] = field(default_factory=list)
    slow: list[dict] = field(default_factory=list)
    _schema: tuple[float, str] | None = None

    def schema(self) -> str:
        """The schema text, read again after CACHE_SECONDS."""
        if self._schema is None or self.clock() - self._schema[0] > CACHE_SECONDS:
            self._schema = self.clock(), describe(columns(self.spark, self.database))
        return self._schema[1]

    def run(self, sql: str) -> tuple[list[dict] | None, str | None]:
        """(rows, None) or (None, why not); a query over the time limit is cancelled."""
        import threading

        text = clean(sql)
        if not is_query(self.spark, text):
            return None, "only one statement that reads is allowed"
        group, began = f"front-door-{uuid.uuid4().hex}", self.clock()
        self.spark.addTag(group)
        watch = threading.Timer(self.timeout, self.spark.interruptTag, [group])
        watch.start()
        try:
            return [r.asDict(recursive=True) for r in limited(self.spark.sql(text)).collect()], None
        except PySparkException as e:
            return None, str(e).splitlines()[0]
        finally:
            watch.cancel()
            self.spark.removeTag(group)
            if (took := self.clock() - began) > SLOW_SECONDS:
                self.slow.append({"sql": text, "seconds": took})

    def ask(self, question: str) -> dict:
        """Generate and run, at most RETRIES times again with the error before."""
        error = rows = None
        for attempt in range(1 + RETRIES):
            sql = clean(self.generate(question, self.schema(), error))
            rows, error = self.run(sql)
            if error is None:
                break
        self.history.append({"question": question, "sql": sql, "error": error, "attempts": attempt + 1})
        return {"sql": sql, "rows": rows, "error": error, "attempts": attempt + 1}

    def history_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.history, "question string, sql string, error string, attempts int")
