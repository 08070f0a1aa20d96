"""JSON over HTTP and a language-model service, with clients that tests replace."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions.text import clean_text, drive_id
from loomwright.sources.files import fetch_status


def post_json(url: str, payload: dict, timeout: float = 30, open_: Callable = urllib.request.urlopen) -> dict:
    """The decoded answer; any failure is a RuntimeError."""
    request = urllib.request.Request(url, json.dumps(payload).encode(), {"Content-Type": "application/json"})
    try:
        with open_(request, timeout=timeout) as answer:
            return json.loads(answer.read().decode(answer.headers.get_content_charset() or "utf-8"))
    except (urllib.error.URLError, TimeoutError, ValueError) as e:
        raise RuntimeError(f"{url}: {e}") from e


def get_bytes(url: str, timeout: float = 25, open_: Callable = urllib.request.urlopen) -> bytes | None:
    try:
        with open_(url, timeout=timeout) as answer:
            return answer.read()
    except (urllib.error.URLError, TimeoutError, ValueError):
        return None


def details(rows: DataFrame, key: str, fetch: Callable[[str], dict], delay: float = 0.15) -> DataFrame:
    """(key, detail JSON or null, error or null): one call for each row, `delay` seconds apart within a task; a failure stays with its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for k in b.column(0).to_pylist():
                try:
                    out.append((k, json.dumps(fetch(k), ensure_ascii=False), None))
                except Exception as e:  # noqa: BLE001  kept with the row
                    out.append((k, None, str(e)))
                time.sleep(delay)
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string()) for i in range(3)], names=["key", "detail", "error"])

    return rows.select(rows[key].cast("string").alias("key")).mapInArrow(run, "key string, detail string, error string")


#: Kinds of links that are fetched, and where two services give a document's text or file.
FETCHED = ("pdf", "google_doc", "google_drive")
EXPORT = {"google_doc": "https://docs.google.com/document/d/{}/export?format=txt", "google_drive": "https://drive.google.com/uc?export=download&id={}"}


def attachment_bytes(kind: str, url: str, file_id: str | None, get: Callable[[str], bytes | None], pdf: Callable[[bytes], str] | None) -> tuple[str | None, str]:
    """(raw text, status: ok, empty, fetch_error or no_pypdf) of one link of FETCHED. A warning page in place of a file is an error, any other file that is no PDF is empty."""
    if kind in EXPORT and not file_id:
        return None, "fetch_error"
    if kind == "pdf" and pdf is None:
        return None, "no_pypdf"
    data = get(EXPORT[kind].format(file_id) if kind in EXPORT else url)
    if data is None:
        return None, "fetch_error"
    if kind == "google_doc":
        text = data.decode("utf-8", "replace")
    elif kind == "google_drive" and not data.startswith(b"%PDF"):
        page = data[:100].lower().lstrip().startswith(b"<!doc") or b"<html" in data[:200].lower()
        return None, "fetch_error" if page else "empty"
    elif pdf is None:
        return None, "no_pypdf"
    else:
        text = pdf(data)
    return (text, "ok") if text and text.strip() else (None, "empty")


def fetch_attachments(links: DataFrame, get: Callable[[str], bytes | None] = get_bytes, pdf: Callable[[bytes], str] | None = None, delay: float = 0.3, most: int | None = None) -> DataFrame:
    """links(url, type, ...) with content and fetch_status: each distinct address is fetched once, `delay` seconds apart within a task.

    Pages that need a login are auth_required and other kinds skipped, both without a call; a failure stays with its row. most: characters that are kept, by default all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for kind, url, file_id in zip(*(c.to_pylist() for c in b.columns)):
                try:
                    found.append(attachment_bytes(kind, url, file_id, get, pdf))
                except Exception:  # noqa: BLE001  kept with the row
                    found.append((None, "fetch_error"))
                time.sleep(delay)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([t for t, _ in found], pa.string()), pa.array([s for _, s in found], pa.string())], names=["type", "url", "raw", "status"])

    asked = links.filter(F.col("type").isin(*FETCHED)).select("type", "url", drive_id(F.col("url")).alias("file_id")).distinct()
    text = clean_text(F.col("raw"))
    made = asked.mapInArrow(run, "type string, url string, raw string, status string").withColumn("new_content", F.when(F.col("status") == "ok", text if most is None else F.substring(text, 1, most)))
    made = made.select("type", "url", F.nullif("new_content", F.lit("")).alias("new_content"), F.when((F.col("status") == "ok") & (F.col("new_content") == ""), "empty").otherwise(F.col("status")).alias("status"))
    joined = links.drop("content", "fetch_status").join(made, ["type", "url"], "left")
    return joined.withColumn("content", F.col("new_content")).withColumn("fetch_status", fetch_status(F.col("type"), F.col("status"))).drop("new_content", "status")


class LanguageModel:
    """generate() and stream() of a service that takes {model, prompt, system} and answers {response}, whole or line by line."""

    def __init__(self, base: str, model: str, open_: Callable = urllib.request.urlopen) -> None:
        self.base, self.model, self.open_ = base.rstrip("/"), model, open_

    def _body(self, prompt: str, system: str, stream: bool) -> dict:
        return {"model": self.model, "prompt": prompt, "system": system, "stream": stream}

    def generate(self, prompt: str, system: str = "", timeout: float = 120) -> str:
        return post_json(f"{self.base}/api/generate", self._body(prompt, system, False), timeout, self.open_)["response"]

    def stream(self, prompt: str, system: str = "", timeout: float = 120) -> Iterator[str]:
        request = urllib.request.Request(f"{self.base}/api/generate", json.dumps(self._body(prompt, system, True)).encode(), {"Content-Type": "application/json"})
        with self.open_(request, timeout=timeout) as answer:
            for line in answer:
                if line.strip():
                    yield json.loads(line).get("response", "")

    def healthy(self, timeout: float = 5) -> bool:
        """Whether the service knows a model whose name begins so."""
        found = get_bytes(f"{self.base}/api/tags", timeout, self.open_)
        return any(m.get("name", "").startswith(self.model) for m in json.loads(found)["models"]) if found else False
