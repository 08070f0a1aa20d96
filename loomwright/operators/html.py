"""Text and links of HTML pages."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser
from urllib.parse import urljoin

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions.text import by_slices, clean_text, generic_anchor, link_type

#: Tags that stand on a line of their own.
BLOCK = frozenset(
    "address article aside blockquote br dd div dl dt figcaption figure footer h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split()
)
AROUND = 180
RAW = "struct<text:string,links:array<struct<index:int,anchor:string,url:string,raw_href:string,context:string>>>"
_RAW = pa.struct([("text", pa.string()), ("links", pa.list_(pa.struct([("index", pa.int32()), ("anchor", pa.string()), ("url", pa.string()), ("raw_href", pa.string()), ("context", pa.string())])))])


class _Page(HTMLParser):
    """Text so far as a list with its length, and (href, start, end) of the links."""

    def __init__(self, drop_script: bool) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.size, self.links, self.href, self.silent, self.drop = 0, [], None, 0, drop_script

    def _add(self, text: str) -> None:
        self.out.append(text)
        self.size += len(text)

    def _line(self) -> None:
        if self.size and not self.out[-1].endswith("\n"):
            self._add("\n")

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCK:
            self._line()
        if tag == "a":
            self.href = (dict(attrs).get("href") or "", self.size)
        self.silent += tag in ("script", "style")

    def handle_endtag(self, tag: str) -> None:
        if tag == "a" and self.href is not None:
            self.links.append((*self.href, self.size))
            self.href = None
        if tag in BLOCK:
            self._line()
        if tag in ("script", "style"):
            self.silent = max(0, self.silent - 1)

    def handle_data(self, data: str) -> None:
        if data and not (self.drop and self.silent):
            self._add(data)


def parse(html: str | None, base: str | None, drop_script: bool = False) -> dict:
    """Raw text, and the links with AROUND characters about them; the left edge moves on to the next word."""
    page = _Page(drop_script)
    page.feed(html or "")
    text, links = "".join(page.out), []
    for i, (href, start, end) in enumerate(page.links, 1):
        left = max(0, start - AROUND)
        if left and not text[left - 1].isspace() and -1 < (space := text.find(" ", left)) < start:
            left = space + 1
        try:
            url = urljoin(base or "", href)
        except ValueError:
            url = href
        links.append({"index": i, "anchor": text[start:end], "url": url, "raw_href": href, "context": text[left : end + AROUND]})
    return {"text": unicodedata.normalize("NFC", text), "links": links}


def parsed(html: Column, base: Column, drop_script: bool = False) -> Column:
    @F.arrow_udf(RAW)
    def run(pages: pa.Array, bases: pa.Array) -> pa.Array:
        # a slice of the pages and of their links at a time; the bases are short
        left = iter(bases.to_pylist())
        return by_slices(pages, lambda part: pa.array([parse(h, next(left), drop_script) for h in part.to_pylist()], _RAW))

    return run(html, base)


def text_and_links(html: Column, base: Column, title: Column, drop_script: bool = False) -> Column:
    """struct<text, links>: clean text and links with type, context and meaning. Anchors that say nothing mean their context."""
    raw = parsed(html, base, drop_script)

    def link(x: Column) -> Column:
        anchor = F.coalesce(F.nullif(clean_text(x["anchor"], False), F.lit("")), x["url"])
        context = clean_text(x["context"], False)
        meaning = F.when(generic_anchor(anchor), F.concat(F.lit("Liên kết trong bài '"), title, F.lit("': "), context)).otherwise(anchor)
        return F.struct(x["index"].alias("index"), anchor.alias("anchor_text"), x["url"].alias("url"), x["raw_href"].alias("raw_href"), link_type(x["url"]).alias("type"), context.alias("context"), meaning.alias("meaning"))

    return F.struct(clean_text(raw["text"], False).alias("text"), F.transform(raw["links"], link).alias("links"))
