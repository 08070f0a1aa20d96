"""Text scalars as Column -> Column functions. Everything but NFC normalisation stays in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Geometric symbols that cleaning drops besides category So.
SYMBOLS = "□☐■▪▫♦●○★☆▶►◄▼▲"
#: Names of anchors that say nothing, after accents and case are taken off.
GENERIC_ANCHORS = ("tai day", "link", "xem them", "bam vao day", "click here")
#: Attachment names that are anchor text.
JUNK_NAMES = ("tại đây", "tại đây.", "tai day", "tai day.", "ở đây", "ở đây.", "o day", "o day.", "xem tại đây", "xem tại đây.", "here", "click here", "download here", "tại đây!", "xem thêm")
#: Letters that can't begin a word.
MID_VOWELS = "ăâêôơư"
#: File name endings that give a link its type.
FILE_ENDINGS = ("pdf", "docx", "doc", "xlsx", "xls", "pptx", "ppt", "zip", "rar", "png", "jpg", "jpeg")
#: Bytes of texts that are Python objects at a time.
SLICE_BYTES = 1_000_000
#: All characters with Unicode's White_Space property.
SPACE = "".join(map(chr, (*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
#: Patterns.
EMAIL = "[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+[.][a-zA-Z]{2,}"
TAG = r"\[([^\]]+)\](?!\()"
SYSTEM_TAGS = ("Nội dung tài liệu", "Biểu mẫu đính kèm")
NUMBERED_LINE = r"^\d{2,3}\.\s"
TAG_LINE = r"(?U)^\[[\w\s]+\]\s*$"
RELATED = "Liên kết"
RELATED_LINE = r"""(?m)^-\s*Liên kết trong bài ['"].+?['"]:.+$"""
RELATED_HEADER = r"Liên kết liên quan:\s*\n"
#: Fixed value: a first word and the marks around it, in lower-case letters of Vietnamese, ASCII letters and digits.
CUT_WORD = r"(?U)^[^\s\w]*[a-zA-Z0-9àáảãạăắằẳẵặâấầnẩẫậèéẻẽẹêếềểễệìíỉĩịòóỏõọôốồổỗộơớờởỡợùúủũụưứừửữựỳýỷỹỵđ]+[^\s\w]*\s+"
LEGAL_HEADINGS = (r"(?m)^Điều\s+\d+[.:]?\s", r"(?m)^Chương\s+[IVXLCDM\d]+[.:]?\s", r"(?m)^Mục\s+\d+[.:]?\s")
FORM_SIGNATURE = "(?iu)(CỘNG HÒA|CỘNG HOÀ|Độc lập|Kính gửi|Họ (và |)tên|MSSV|Tôi xin cam|BỘ GIÁO DỤC)"


def _accents() -> tuple[str, str]:
    """Every letter below U+2000 that NFD takes to one ASCII letter and marks, and that letter; đ and Đ besides."""
    pairs = [("đ", "d"), ("Đ", "D")]
    for point in range(0xC0, 0x2000):
        base = "".join(c for c in unicodedata.normalize("NFD", chr(point)) if unicodedata.category(c) != "Mn")
        if len(base) == 1 and base.isascii() and base.isalpha():
            pairs.append((chr(point), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _accents()


def by_slices(values: pa.Array, made: Callable[[pa.Array], pa.Array]) -> pa.Array:
    """made() of slices of SLICE_BYTES or one value, so that only a slice of Python's objects is held at a time; all of it as one array."""
    size = np.cumsum(pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    parts, at = [], 0
    while at < len(values):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
        parts.append(made(values.slice(at, end - at)))
        at = end
    found = pa.concat_arrays(parts) if parts else made(values)
    pa.default_memory_pool().release_unused()
    return found


@F.arrow_udf(T.StringType())
def nfc(values: pa.Array) -> pa.Array:
    """NFC form; Spark has no function for it. An array whose values are all ASCII comes back as it is."""
    if pc.all(pc.string_is_ascii(values), skip_nulls=True).as_py() in (None, True):
        return values
    return by_slices(values, lambda part: pa.array([None if x is None else x if x.isascii() else unicodedata.normalize("NFC", x) for x in part.to_pylist()], pa.string()))


def strip_accents(c: Column) -> Column:
    """Letters without their accents: translation of composed letters, and combining marks dropped."""
    return F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{Mn}", "")


def clean_symbols(c: Column) -> Column:
    """Without control characters (but line breaks and tabs), symbols of category So and some geometric ones; runs of spaces are one; null is empty."""
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), rf"[\p{{So}}{SYMBOLS}]|[\p{{Cc}}&&[^\n\r\t]]", "")
    return trim_space(F.regexp_replace(kept, " +", " "))


def trim_space(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(SPACE))


def clean_text(c: Column, normalise: bool = True) -> Column:
    """NFC, no symbols, single spaces, no space around line breaks, at most one empty line in a row."""
    text = clean_symbols(nfc(c) if normalise else c)
    text = F.regexp_replace(F.replace(text, F.lit(" "), F.lit(" ")), "[ \t\r\f\u000b]+", " ")
    return trim_space(F.regexp_replace(F.regexp_replace(text, " *\n *", "\n"), "\n{3,}", "\n\n"))


def _edged(c: Column, mark: str) -> Column:
    return F.regexp_replace(c, f"^{mark}+|{mark}+$", "")


def _or_default(slug: Column, default: str) -> Column:
    """The default for an empty slug. nullif() would evaluate the slug twice, and in a lambda twice for each value."""
    return F.regexp_replace(slug, "^$", default)


def url_slug(c: Column, default: str = "khong-co-tieu-de") -> Column:
    text = F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), "[^a-z0-9]+", "-")
    return _or_default(_edged(text, "-"), default)


def section_slug(c: Column, most: int = 24, default: str = "sec") -> Column:
    text = _edged(F.lower(F.regexp_replace(strip_accents(F.coalesce(c, F.lit(""))), "[^a-zA-Z0-9]+", "_")), "_")
    return _or_default(F.substring(text, 1, most), default)


def section_slugs(c: Column, most: int = 24, default: str = "sec") -> Column:
    """section_slug() of each line of a text, as an array: the text goes through each step once, not each line by itself.

    A slug is its line's letters and digits with single marks between, so its first `most` characters are decided where
    letter or digit number most + 1 stands, or at the line's end. What follows is left out before each run of other
    characters is replaced, which is the costly step.
    """
    plain = F.when(F.octet_length(c) == F.char_length(c), c).otherwise(strip_accents(c))
    decided = F.regexp_replace(plain, rf"(?md)^((?:[^a-zA-Z0-9\n]*+[a-zA-Z0-9]){{{most + 1}}})[^\n]*+", "$1")
    lines = F.split(F.lower(F.regexp_replace(decided, r"[^a-zA-Z0-9\n]+", "_")), "\n")
    # a run of other characters is one "_" by now
    cut = F.transform(lines, lambda x: F.substring(F.btrim(x, F.lit("_")), 1, most))
    return F.transform(cut, lambda x: F.when(x == "", default).otherwise(x))


def folded(c: Column) -> Column:
    """Trimmed, lower case, runs of white space one space."""
    return F.lower(F.regexp_replace(trim_space(c), r"\s+", " "))


def preview(c: Column, most: int = 160) -> Column:
    text = trim_space(F.regexp_replace(c, r"\s+", " "))
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def generic_anchor(c: Column) -> Column:
    text = F.regexp_replace(F.lower(strip_accents(F.coalesce(c, F.lit("")))), "[^a-z0-9 ]+", " ")
    return F.trim(F.regexp_replace(text, " +", " ")).isin(*GENERIC_ANCHORS)


def attachment_name(local: Column, anchor: Column, context: Column, default: str, longest: int = 80) -> Column:
    """The name of a linked file: that of the local file, else the anchor, else the first line of the context that says something, else the default.

    Addresses and generic anchors are no names, and an anchor must be shorter than `longest`. A context line loses Markdown, its first word
    (it may be cut) and what is longer; lines of mails, of digits only, and of three characters say nothing.
    """
    full = lambda c: F.nullif(trim_space(F.coalesce(c, F.lit(""))), F.lit(""))
    said = lambda c: ~generic_anchor(c)
    plain = lambda x: trim_space(F.regexp_replace(F.regexp_replace(x, r"\[([^\]]+)\]\([^)]+\)", "$1"), r"[#*|_]+", ""))
    lines = F.transform(F.split(F.coalesce(context, F.lit("")), "\n"), lambda x: trim_space(F.regexp_replace(plain(x), CUT_WORD, "")))
    meaning = F.filter(lines, lambda x: said(x) & (F.length(x) > 3) & ~x.contains("@") & ~x.rlike(r"(?U)^\d+$"))
    file, label = full(local), full(anchor)
    return F.coalesce(F.when(~file.startswith("http") & said(file), file), F.when(said(label) & (F.length(label) < longest), label), F.substring(F.try_element_at(meaning, F.lit(1)), 1, longest), F.lit(default))


def junk_attachment(name: Column) -> Column:
    """Names of under 5 characters, anchor text, and short all-upper names without digits."""
    n = F.trim(F.coalesce(name, F.lit("")))
    return (F.length(n) < 5) | F.lower(n).isin(*JUNK_NAMES) | ((n == F.upper(n)) & (F.length(n) <= 12) & ~n.rlike("[0-9]"))


def emails(c: Column) -> Column:
    """Distinct addresses, sorted."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(f"({EMAIL})"), F.lit(1))))
    return F.when(~c.contains("@"), F.array().cast("array<string>")).otherwise(found)  # the pattern is slow where there is none


def bracket_tags(c: Column) -> Column:
    """Distinct [tags] of 2 to 49 characters that are no links and no system tags, sorted."""
    found = F.transform(F.regexp_extract_all(c, F.lit(TAG), F.lit(1)), lambda x: F.trim(x))
    fits = lambda x: (F.length(x) > 1) & (F.length(x) < 50) & ~x.startswith(SYSTEM_TAGS[0]) & ~x.startswith(SYSTEM_TAGS[1])
    return F.array_sort(F.array_distinct(F.filter(found, fits)))


def link_type(url: Column) -> Column:
    low = F.lower(url)
    bare = F.substring_index(F.substring_index(low, "?", 1), "#", 1)
    out = F.when(bare.rlike(f"[.]({'|'.join(FILE_ENDINGS)})$"), F.regexp_extract(bare, "[.]([a-z]+)$", 1)).when(url.startswith("mailto:"), "email")
    out = out.when(bare.contains("forms.office.com") | bare.contains("docs.google.com/forms"), "form")
    for mark, kind in (("w", "word_online"), ("x", "excel_online"), ("p", "powerpoint_online")):
        out = out.when(low.contains(f"sharepoint.com/:{mark}:/"), kind)
    for part, kind in (("docs.google.com/document", "google_doc"), ("docs.google.com/spreadsheets", "google_sheet"), ("drive.google.com", "google_drive")):
        out = out.when(bare.contains(part), kind)
    return out.when(bare.rlike("^https?://"), "html_or_external").otherwise("relative_or_unknown")


def drive_id(url: Column) -> Column:
    """The id of a shared document or file, null without."""
    part = lambda p: F.nullif(F.regexp_extract(url, p, 1), F.lit(""))
    return F.coalesce(part("/document/d/([a-zA-Z0-9_-]+)"), part("[?&]id=([a-zA-Z0-9_-]+)"), part("/file/d/([a-zA-Z0-9_-]+)"))


def related_links(c: Column) -> Column:
    """struct<body, lines>: the text without lines that only list links, and these lines."""
    lines = F.regexp_extract_all(c, F.lit(f"({RELATED_LINE})"), F.lit(1))
    body = F.regexp_replace(F.regexp_replace(c, RELATED_LINE, ""), RELATED_HEADER, "")
    none = ~c.contains(RELATED)  # which is quickly seen
    body = F.when(none, c).otherwise(body)
    lines = F.when(none, F.array().cast("array<string>")).otherwise(lines)
    return F.struct(trim_space(F.regexp_replace(body, "\n{3,}", "\n\n")).alias("body"), lines.alias("lines"))


def chunk_prefix(title: Column, category: Column, mails: Column, section: Column, attachment: Column | None = None) -> Column:
    """The lines that stand before a chunk's text, empty where nothing is known; attachment: its name, for chunks of attachments."""
    third = F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Mục: "), section)) if attachment is None else F.concat(F.lit("Biểu mẫu/Tài liệu đính kèm: "), attachment)
    contact = F.when(F.size(mails) > 0, F.concat(F.lit("Liên hệ: "), F.array_join(F.slice(mails, 1, 2), ", ")))
    head = F.concat_ws("\n", F.concat(F.lit("Bài viết: "), title), F.concat(F.lit("Chuyên mục: "), category), third, contact)
    return F.when(head != "", F.concat(head, F.lit("\n"))).otherwise("")


def link_listing(links: Column) -> Column:
    """One line for each link of array<struct<meaning, anchor_text, type, url>>; empty without links."""
    line = lambda x: F.concat(F.lit("- "), x["meaning"], F.lit(" | anchor='"), x["anchor_text"], F.lit("' | type="), x["type"], F.lit(" | url="), x["url"])
    return F.when(F.size(links) > 0, F.concat(F.lit("Liên kết liên quan:\n"), F.array_join(F.transform(links, line), "\n"))).otherwise("")


def relabel_links(text: Column, anchor: Column, url: Column, label: Column) -> Column:
    """Markdown links [anchor](url) with another label; if there is none, every link to the url."""
    old = F.concat(F.lit("["), anchor, F.lit("]("), url, F.lit(")"))
    new = F.concat(F.lit("["), label, F.lit("]("), url, F.lit(")"))
    loose = F.regexp_replace(text, F.concat(F.lit(r"\[([^\]]+)\]\(\Q"), url, F.lit(r"\E\)")), F.regexp_replace(new, r"([\\$])", r"\\$1"))
    return F.when(F.contains(text, old), F.replace(text, old, new)).otherwise(loose)


def code_block(c: Column) -> Column:
    """What stands in the first pair of fences, without the word python and one line break at its beginning; without a pair the whole text. Trimmed."""
    found = F.regexp_extract_all(c, F.lit("(?s)```(?:python)?\\n?(.*?)```"), F.lit(1))
    return trim_space(F.coalesce(F.try_element_at(found, F.lit(1)), c))


def strip_sql_fence(c: Column) -> Column:
    return trim_space(F.regexp_replace(c, "(?i)```sql|```", ""))


def filled_lines(c: Column) -> Column:
    """How many lines have more than white space."""
    return F.size(F.filter(F.split(c, "\n"), lambda x: x.rlike(r"\S")))


def model_input(c: Column, kind: str, model: str) -> Column:
    """Trimmed text, with `passage: ` or `query: ` before it for models of the e5 family."""
    return F.concat(F.lit(f"{kind}: "), trim_space(c)) if "e5" in model.lower() else trim_space(c)


def legal_document(c: Column) -> Column:
    return F.substring(c, 1, 3000).rlike("|".join(LEGAL_HEADINGS[:2]))


def form_document(c: Column) -> Column:
    return F.substring(c, 1, 2000).rlike(FORM_SIGNATURE)


def hard_cut(c: Column) -> Column:
    """Whether a text begins within a word: with a vowel that begins none."""
    return F.substring(F.regexp_replace(c, r"^\s+", ""), 1, 1).isin(*MID_VOWELS)


def section_boundary(line: Column) -> Column:
    first = F.substring(F.ltrim(line), 1, 1)  # spares most lines the patterns
    return F.coalesce(F.when(first.between("0", "9"), F.trim(line).rlike(NUMBERED_LINE)).when(first == "[", F.trim(line).rlike(TAG_LINE)), F.lit(False))


def tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits, distinct and in order of first occurrence."""
    return F.array_distinct(F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda x: x != ""))
