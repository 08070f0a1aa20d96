"""Readers and writers with declared schemas."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwright.functions.text import clean_text
from loomwright.schemas import BANK, BANK_WIDTHS, LISTING


def listing(spark: SparkSession, path: str) -> DataFrame:
    """Items of staged listing responses (one JSON document in a file); a response whose RespCode isn't 0 is an error."""
    raw = spark.read.schema(LISTING).option("multiLine", True).json(path)
    checked = raw.withColumn("items", F.when(F.col("RespCode") == 0, F.coalesce("WebTitleLst", F.array())).otherwise(F.raise_error(F.concat(F.lit("listing failed: "), F.coalesce("RespText", F.lit(""))))))
    return checked.select(F.inline("items"))


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document in a line; empty lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_jsonl(df: DataFrame, path: str, one_file: bool = False, mode: str = "errorifexists") -> None:
    (df.coalesce(1) if one_file else df).write.mode(mode).json(path)


def append_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)


def validated(df: DataFrame, schema: T.StructType, widths: dict[str, int] | None = None) -> DataFrame:
    """df with the schema's columns and types; columns that it doesn't know, or misses, are an error, and so is a text that is too wide."""
    unknown, missing = set(df.columns) - set(schema.names), set(schema.names) - set(df.columns)
    if unknown or missing:
        raise ValueError(f"unknown columns {sorted(unknown)}, missing columns {sorted(missing)}")
    wide = lambda c: F.when(F.length(c) > widths[c], F.raise_error(F.lit(f"{c} is wider than {widths[c]}")).cast("string")).otherwise(F.col(c)) if c in (widths or {}) else F.col(c)
    return df.select(*(wide(f.name).cast(f.dataType).alias(f.name) for f in schema))


def load_csv(spark: SparkSession, path: str, table: str, schema: str = BANK, widths: dict[str, int] | None = None, replace: bool = False) -> int:
    """A `;` separated file with a header into a table; all rows or none. The number of rows."""
    kind = T._parse_datatype_string(schema) if hasattr(T, "_parse_datatype_string") else spark.createDataFrame([], schema).schema
    raw = spark.read.option("sep", ";").option("header", True).option("mode", "FAILFAST").csv(path)
    rows = validated(raw, kind, BANK_WIDTHS if widths is None and schema == BANK else widths)
    rows.write.mode("overwrite" if replace else "append").saveAsTable(table)
    return raw.count()


def create_table(spark: SparkSession, name: str, schema: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet")


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of a database whose driver is on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs, then tables with cells joined by ` | `; what is no such file gives nothing."""
    try:
        body = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml")).find(f"{_W}body")
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_W}t")).strip()
    rows = [" | ".join(filter(None, map(text, r.iter(f"{_W}tc")))) for t in body.iter(f"{_W}tbl") for r in t.iter(f"{_W}tr")]
    return "\n".join(filter(None, [*map(text, body.findall(f"{_W}p")), *rows]))


def doc_text(data: bytes, least: int = 4) -> str:
    """Runs of at least `least` printable characters in UTF-16 of an old Word file."""
    runs = re.findall("[^\x00-\x08\x0b\x0c\x0e-\x1f\ud800-\udfff�￿]{%d,}" % least, data.decode("utf-16-le", "replace"))
    return "\n".join(x.strip() for x in runs if sum(c.isalnum() or c.isspace() for c in x) > 0.7 * len(x))


def file_text(name: str, data: bytes | None, pdf: Callable[[bytes], str] | None = None) -> tuple[str, str]:
    """(text, status: ok, empty, no_pypdf or skipped). A .doc is tried as .docx first; PDF needs a reader."""
    data, end = data or b"", name.lower().rpartition(".")[2]
    if end == "pdf" or data[:4] == b"%PDF":
        if pdf is None:
            return "", "no_pypdf"
        text = pdf(data) if data[:4] == b"%PDF" else ""
    elif end in ("docx", "doc"):
        text = docx_text(data) or (doc_text(data) if end == "doc" else "")
    else:
        return "", "skipped"
    return text, "ok" if text.strip() else "empty"


def attachments(spark: SparkSession, path: str, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """filename, content, fetch_status of the files of a folder; the .docx beside a .doc wins."""

    def run(batches):
        for b in batches:
            names = [p.rpartition("/")[2] for p in b.column(0).to_pylist()]
            found = [file_text(n, d, pdf) for n, d in zip(names, b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([t for t, _ in found]), pa.array([s for _, s in found])], names=["filename", "raw", "fetch_status"])

    made = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "filename string, raw string, fetch_status string")
    twin = made.filter(F.col("filename").endswith(".docx")).select(F.regexp_replace("filename", "[.]docx$", ".doc").alias("filename"))
    return made.join(twin, "filename", "left_anti").select("filename", clean_text(F.col("raw")).alias("content"), "fetch_status")


def catalog(mapping: DataFrame, files: DataFrame) -> DataFrame:
    """mapping(pos, filename, doc_id, url_signature) of the files that exist."""
    return mapping.join(files, "filename")


def fetch_status(kind: Column, fetched: Column | None = None) -> Column:
    """auth_required for office pages, else what a fetch said, else skipped."""
    other = F.lit("skipped") if fetched is None else F.coalesce(fetched, F.lit("skipped"))
    return F.when(kind.isin("word_online", "excel_online", "powerpoint_online"), "auth_required").otherwise(other)
