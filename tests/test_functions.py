"""Scalars against literal rows."""

import re
import unicodedata
import uuid

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright.functions import chat, ids, scores, text, vectors


def one(spark, make, *values):
    """make(columns...) on one row."""
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'array<string>'}" for i, v in enumerate(values)))
    return df.select(make(*(df[c] for c in df.columns))).first()[0]


@pytest.mark.parametrize("make,value,want", [
    (text.clean_text, "e\u0301  a\u00a0b \n\n\n\n c\t☐★", "é a b\n\nc"), (text.clean_text, None, ""), (text.clean_symbols, "a\x00b  c ✔", "ab c"), (text.url_slug, "Đăng ký học: 2024!", "dang-ky-hoc-2024"), (text.url_slug, "!!", "khong-co-tieu-de"),
    (text.section_slug, "31. Hoãn thi", "31_hoan_thi"), (text.section_slug, None, "sec"), (text.section_slug, "x" * 40, "x" * 24),
    (text.link_type, "https://x.org/a.PDF?dl=1#p", "pdf"), (text.link_type, "https://docs.google.com/forms/d/1", "form"), (text.link_type, "https://t.sharepoint.com/:w:/g/a", "word_online"),
    (text.link_type, "https://docs.google.com/spreadsheets/d/1", "google_sheet"), (text.link_type, "https://drive.google.com/file/d/ab/view", "google_drive"), (text.link_type, "mailto:a@b.org", "email"),
    (text.link_type, "https://x.org/", "html_or_external"), (text.link_type, "/local", "relative_or_unknown"),
    (text.drive_id, "https://drive.google.com/open?id=a-b_1", "a-b_1"), (text.drive_id, "https://docs.google.com/document/d/zz/edit", "zz"), (text.drive_id, "https://x.org", None),
    (text.junk_attachment, "abc", True), (text.junk_attachment, "click here", True), (text.junk_attachment, "QD HB", True), (text.junk_attachment, "QD123", False), (text.junk_attachment, "Form.pdf", False),
    (text.generic_anchor, "Tại đây!", True), (text.generic_anchor, "Form", False), (text.hard_cut, "  ong", False), (text.hard_cut, " ơ", True),
    (text.code_block, "a\n```python\nx = 1\n```\n```\ny\n```", "x = 1"), (text.code_block, " plain ", "plain"), (text.strip_sql_fence, "```sql\nSELECT 1\n```", "SELECT 1"),
    (text.filled_lines, "a\n \n\nb", 2), (text.preview, "a  b" * 80, ("a b" * 80)[:160] + "..."), (text.folded, "  A \n b ", "a b"),
    (text.legal_document, "x\nĐiều 1. y", True), (text.form_document, "kính gửi: ai", True), (text.section_boundary, "12. x", True), (text.section_boundary, "[Học bổng]", True), (text.section_boundary, "1. x", False),
])
def test_text(spark, make, value, want):
    assert one(spark, make, value) == want


def test_tags_and_mails(spark):
    assert one(spark, text.bracket_tags, "[A tag] [b](u) [Ctag] [x] [Nội dung tài liệu 1]") == ["A tag", "Ctag"]
    assert one(spark, text.emails, "b@x.org a@x.org b@x.org no@x") == ["a@x.org", "b@x.org"]


def test_related_links_leave_other_lines(spark):
    body = "a\nLiên kết liên quan:\n- Liên kết trong bài 'T': b\n- other | anchor='x'\n"
    found = one(spark, text.related_links, body)
    assert found.lines == ["- Liên kết trong bài 'T': b"] and found.body == "a\n- other | anchor='x'"


def test_prefix_and_labels(spark):
    df = spark.createDataFrame([("T", "C", ["a@b.c", "d@e.f", "x@y.z"], "S")], "t string, c string, m array<string>, s string")
    assert df.select(text.chunk_prefix(df.t, df.c, df.m, df.s)).first()[0] == "Bài viết: T\nChuyên mục: C\nMục: S\nLiên hệ: a@b.c, d@e.f\n"
    assert df.select(text.chunk_prefix(df.t, df.c, F.array().cast("array<string>"), F.lit(""), F.lit("F"))).first()[0] == "Bài viết: T\nChuyên mục: C\nBiểu mẫu/Tài liệu đính kèm: F\n"
    assert one(spark, lambda t, a, u, n: text.relabel_links(t, a, u, n), "see [here](http://x/?a=1)", "here", "http://x/?a=1", "Form $1") == "see [Form $1](http://x/?a=1)"
    assert one(spark, lambda t, a, u, n: text.relabel_links(t, a, u, n), "see [Here ](http://x/?a=1)", "here", "http://x/?a=1", "Form $1") == "see [Form $1](http://x/?a=1)"


@settings(max_examples=15, deadline=None)
@given(st.text(max_size=30))
def test_accents_are_those_of_nfd(spark, value):
    want = "".join(c for c in unicodedata.normalize("NFD", value) if unicodedata.category(c) != "Mn").replace("đ", "d").replace("Đ", "D")
    if all(unicodedata.category(c) != "Mn" and unicodedata.normalize("NFD", c) == c or c in text.ACCENTED for c in value):
        assert one(spark, text.strip_accents, value) == want


def test_ids(spark):
    for name in ("doc_1_summary", "tài_liệu"):
        assert one(spark, ids.uuid5, name) == str(uuid.uuid5(uuid.NAMESPACE_DNS, name))
    assert one(spark, lambda p, s: ids.body_id(p, s, F.lit(3)), "doc_1", "sec") == "doc_1_body_sec_p03"
    assert one(spark, lambda p, a: ids.attachment_chunk_id(p, a, F.lit(0), F.lit(12)), "d", "0123456789") == "d_att_01234567_00_p12"
    assert one(spark, lambda k: ids.strip_prefix("doc_", k), "doc_1doc_") == "1doc_"


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0], [0.0, 0.0])], "a array<float>, b array<float>, z array<float>")
    r = df.select(vectors.cosine(df.a, df.b).alias("c"), vectors.cosine(df.a, df.z).alias("n"), vectors.normalised(df.a).alias("u")).first()
    assert abs(r.c - 0.96) < 1e-12 and r.n is None and r.u == [0.6, 0.8]


def test_rewards(spark):
    rows = [("```python\nx = 1\nprint(x)\n```", 1.0, 1.0, 1.0, 0.2), ("hello there", 0.0, 0.3, 1.0, 0.2), ("```\na = 1\nb = 2\nc = 3\n```", 0.5, 1.0, 1.0, 1.0), ("```python\npass\n```", 1.0, 1.0, 0.0, 0.2)]
    df = spark.createDataFrame([(r[0],) for r in rows], "c string")
    found = df.select(scores.reward_format(df.c), scores.reward_syntax(df.c), scores.reward_no_placeholder(df.c), scores.reward_length(df.c)).collect()
    assert [tuple(r) for r in found] == [r[1:] for r in rows]
    full = {k: F.lit(v) for k, v in {"executable": 1.0, "syntax": 1.0, "no_placeholder": 1.0, "format": 1.0, "length": 0.2}.items()}
    assert one(spark, lambda _: scores.combined(full), "x") == 0.96
    half = {k: F.lit(v) for k, v in {"executable": 0.0, "syntax": 0.3, "no_placeholder": 1.0, "format": 0.0, "length": 0.2}.items()}
    assert one(spark, lambda _: scores.combined(half), "x") == 0.285


@pytest.mark.parametrize("n,c,k,want", [(10, 3, 1, 0.3), (10, 3, 5, 1 - 21 / 252), (10, 6, 5, 1.0), (10, 0, 5, 0.0)])
def test_pass_at_k(spark, n, c, k, want):
    assert abs(one(spark, lambda a, b: scores.pass_at_k(a, b, k), n, c) - want) < 1e-12


def test_early_stop(spark):
    values = [0.500, 0.504, 0.506, 0.506, 0.507, 0.508, 0.9]
    df = spark.createDataFrame([([(i, v) for i, v in enumerate(values, 1)],)], "h array<struct<step:long,value:double>>")
    s = df.select(scores.early_stop(df.h).alias("s")).first().s
    assert (s.best, s.best_step, s.stopped_step) == (0.506, 3, 6)


def test_chat(spark):
    df = spark.createDataFrame([([("user", "q"), ("tool", "a"), ("tool", "b"), ("assistant", "z")],)], f"m {chat.MESSAGE}")
    rendered = df.select(chat.render(df.m)).first()[0]
    assert rendered == (
        f"<|im_start|>system\n{chat.DEFAULT_SYSTEM}<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>user\n<tool_response>\na\n</tool_response>\n<tool_response>\nb\n</tool_response><|im_end|>\n<|im_start|>assistant\nz<|im_end|>\n"
    )
    assert one(spark, chat.response_spans, rendered) == ["z"]
    assert one(spark, lambda q, a: chat.render(chat.instruction_messages(q, a, "sys")), "q", "a") == "<|im_start|>system\nsys<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n"
    assert one(spark, lambda q: chat.render(chat.instruction_messages(q), prompt=True), "q").endswith("<|im_start|>assistant\n")


def test_python_holds_a_slice_of_texts_at_a_time(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(text, "SLICE_BYTES", 10)
    values, seen = pa.array(["abcdef", None, "ghij", "x" * 30, "", "yz"])[1:], []
    found = text.by_slices(values, lambda part: seen.append(len(part)) or part)
    assert found.to_pylist() == values.to_pylist() and seen == [2, 1, 2]
    assert text.by_slices(values[:0], lambda part: part).to_pylist() == []


def slug_by_hand(line, most=24):
    plain = "".join(c for c in unicodedata.normalize("NFD", line).replace("đ", "d").replace("Đ", "D") if unicodedata.category(c) != "Mn")
    return re.sub("^_+|_+$", "", re.sub("[^a-zA-Z0-9]+", "_", plain).lower())[:most] or "sec"


def test_slugs_of_a_text_are_those_of_its_lines(spark):
    """Also where letter 24 or 25 ends a line, is followed by marks only, or by marks and more."""
    runs = ["a" * n + end for n in (1, 23, 24, 25, 26, 60) for end in ("", "!", " !? ", " b", "  b c", "_b", "\tb")]
    spread = [" ".join("a" * n) + end for n in (11, 12, 13, 24, 25, 26) for end in ("", " ", ".", " z")]
    odd = ["", " ", "___", "12. Hoãn thi", "Đơn xin nghỉ học có lý do chính đáng", "e\u0301te\u0301 " * 9, "a\rb\u2028c\u0085d" * 8, "😀x😀" * 30, "!" * 3000, "!" * 3000 + "end", "\r", "x" * 20_000]
    texts = ["\n".join(runs), "\n".join(spread), "\n".join(odd), *odd, "\n", "\n\na\n", "a" * 30 + "\n" + "b" * 30, None]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    each = F.transform(F.split("text", "\n"), lambda x: text.section_slug(x))
    for found in docs.select("i", text.section_slugs(F.col("text")).alias("all"), each.alias("each")).collect():
        hand = None if texts[found.i] is None else [slug_by_hand(x) for x in texts[found.i].split("\n")]
        assert found["all"] == hand and found["each"] == hand, texts[found.i]


def test_slugs_are_evaluated_once(spark):
    """A slug that stands twice in the plan is made twice."""
    docs = spark.createDataFrame([(1, "A b\nc")], "doc_id long, text string")
    for slug in (text.section_slug(F.col("text")), text.url_slug(F.col("text")), text.section_slugs(F.col("text"))):
        plan = docs.select(slug.alias("s"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("translate(") == 1, plan.count("translate(")
