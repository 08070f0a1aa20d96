"""Hashes and stable identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the name space of point ids (the DNS name space of RFC 4122).
POINT_NAMESPACE = "6ba7b8109dad11d180b400c04fd430c8"


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """UUID version 5 of a name, from SHA-1, without a Python function."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8")))
    part = lambda a, n: F.substring(h, a, n)
    variant = F.translate(part(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def two_digits(n: Column) -> Column:
    """At least two digits."""
    return F.when(n < 100, F.lpad(n.cast("string"), 2, "0")).otherwise(n.cast("string"))


def summary_id(parent: Column) -> Column:
    return F.concat(parent, F.lit("_summary"))


def body_id(parent: Column, slug: Column, page: Column) -> Column:
    return F.concat(parent, F.lit("_body_"), slug, F.lit("_p"), two_digits(page))


def attachment_chunk_id(parent: Column, attachment_id: Column, number: Column, page: Column | None = None) -> Column:
    """Of a page of an attachment, or of its summary."""
    base = F.concat(parent, F.lit("_att_"), F.substring(attachment_id, 1, 8), F.lit("_"), two_digits(number))
    return F.concat(base, F.lit("_sum")) if page is None else F.concat(base, F.lit("_p"), two_digits(page))


def add_prefix(prefix: str, doc_id: Column) -> Column:
    return F.concat(F.lit(prefix), doc_id.cast("string"))


def strip_prefix(prefix: str, key: Column) -> Column:
    """Without the first occurrence of the prefix."""
    at = F.instr(key, prefix)
    return F.when(at > 0, F.concat(F.substring(key, F.lit(1), at - 1), F.substring(key, at + len(prefix), F.length(key)))).otherwise(key)
