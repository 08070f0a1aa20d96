"""Operators on small tables."""

import io
import json
import threading
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomwright import queries
from loomwright.operators import html, retrieval, segment, store, training
from loomwright.operators.keyed import Conflict, KeyedTable
from loomwright.plans import answer, execution, ingest, prompt, sqlfront
from loomwright.schemas import ARTICLE, BANK, RAW_ITEM
from loomwright.sources import files, http
from loomwright.streaming import embed

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.Q))
def test_every_query_runs(spark, name):
    found = queries.Q[name](spark, SF)
    assert found.columns and found.limit(1).count() == 1


def hits(spark, *keys):
    return spark.createDataFrame([(k, i) for i, k in enumerate(keys, 1)], "chunk_id string, rank int")


def test_rrf(spark):
    found = {r.chunk_id: r for r in retrieval.rrf([hits(spark, "a", "b"), hits(spark, "b", "c")]).collect()}
    assert abs(found["b"].score - (1 / 62 + 1 / 61)) < 1e-12 and (found["a"].rank_1, found["a"].rank_2) == (1, None) and (found["c"].rank_1, found["c"].rank_2) == (None, 2)


CHUNKS = "chunk_id string, doc_id string, chunk_index int, chunk_type string, attachment_name string, attachment_index int, attachment_chunk_index int, text string"


def chunk_rows(spark):
    rows = [("s", "1", 0, "summary", None, None, -1, "sum"), ("b0", "1", 1, "body", None, None, -1, "x"), ("b1", "1", 2, "body", None, None, -1, "y"), ("b2", "1", 3, "body", None, None, -1, "z")]
    rows += [("as", "1", 4, "summary", "F", 0, -1, "f")] + [(f"a{i}", "1", 5 + i, "attachment", "F", 0, i, "t") for i in range(7)] + [("o", "2", 0, "body", None, None, -1, "other")]
    return spark.createDataFrame(rows, CHUNKS)


@pytest.mark.parametrize("hit,query,want", [
    ("b0", "", {"b0": 1.0, "b1": 0.8}), ("b1", "", {"b0": 0.8, "b1": 1.0, "b2": 0.8}), ("b0", "mẫu nào?", {"b0": 1.0, "b1": 0.8, "a0": 0.7, "a1": 0.7, "a2": 0.7}),
    ("a3", "", {"a2": 0.8, "a3": 1.0, "a4": 0.8}), ("as", "", {"as": 1.0, **{f"a{i}": 0.9 for i in range(7)}}), ("s", "", {"s": 1.0, "b0": 0.9, "b1": 0.9, "b2": 0.9, **{f"a{i}": 0.9 for i in range(7)}}),
])
def test_expansion(spark, hit, query, want):
    h = spark.createDataFrame([(hit, 1.0, 1)], "chunk_id string, score double, rank int")
    found = retrieval.expand(h, chunk_rows(spark), query).collect()
    assert {r.chunk_id: round(r.score, 6) for r in found} == want and [r.chunk_index for r in found] == sorted(r.chunk_index for r in found)


def test_a_hit_that_another_pulled_in_keeps_the_decayed_score(spark):
    h = spark.createDataFrame([("b0", 1.0, 1), ("b1", 0.9, 2)], "chunk_id string, score double, rank int")
    assert {r.chunk_id: round(r.score, 6) for r in retrieval.expand(h, chunk_rows(spark)).collect()} == {"b0": 1.0, "b1": 0.8, "b2": 0.72}


def test_verdicts(spark):
    cases = spark.createDataFrame([(i, t) for i, t in enumerate([["x"], ["x"], ["x"], ["x"], []])], "case_id int, expected_terms array<string>")
    ex = spark.createDataFrame([(0, 1, "X"), (1, 1, "n"), (1, 2, "x"), (2, 1, "n"), (3, 1, "n")], "case_id int, rank int, text string")
    seed = spark.createDataFrame([(2, 3, "x"), (3, 4, "x")], "case_id int, rank int, text string")
    found = retrieval.verdicts(cases, seed, ex)
    assert [r.verdict for r in found.orderBy("case_id").collect()] == ["PASS", "PARTIAL", "PARTIAL", "FAIL", "MANUAL"]
    assert [tuple(r) for r in retrieval.verdict_counts(found).collect()] == [("PASS", 1), ("PARTIAL", 2), ("FAIL", 1), ("MANUAL", 1)]


def test_change_detection(spark):
    old = spark.createDataFrame([("a", "h1", 5, 0), ("b", "h1", 5, 0), ("c", "h1", 5, 0), ("d", "h", 5, 0)], "id string, content_hash string, embedded_at int, created_at int")
    new = spark.createDataFrame([("a", "h1"), ("b", "h2"), ("c", None), ("e", "h")], "id string, content_hash string")
    found = {r.id: (r.embedded_at, r.created_at) for r in store.upsert_chunks(old, new, F.lit(9)).collect()}
    assert found == {"a": (5, 9), "b": (None, 9), "c": (None, 9), "d": (5, 0), "e": (None, 9)}


def test_embedding_rounds_lose_nothing(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}") for i in range(150)], "id string, text string").withColumns({"embedded_at": F.lit(None).cast("timestamp"), "created_at": F.current_timestamp()})
    table = KeyedTable.create(spark, f"file://{tmp_path}/chunks", chunks.schema, ["id"], buckets=3)
    table.upsert(chunks)
    made = lambda name: KeyedTable.create(spark, f"file://{tmp_path}/{name}", "chunk_id string, point_id string, embedding array<float>", ["chunk_id"], buckets=3, keep=True)
    vectors, encode = made("vectors"), embed.hashing_encoder()
    assert embed.embed_pending(table, vectors, encode, dry_run=True) == 150
    assert [embed.embed_pending(table, vectors, encode, limit=100) for _ in range(3)] == [100, 50, 0]
    assert vectors.read().count() == 150 == vectors.read().select("point_id").distinct().count()
    assert store.progress(table.read()).first().percent == 100.0
    # a changed text is pending again
    table.merge(spark.createDataFrame([("c3", "changed")], "id string, text string"), {"embedded_at": F.when(F.col("old.text").eqNullSafe(F.col("new.text")), F.col("old.embedded_at")), "created_at": F.col("old.created_at")})
    assert embed.embed_pending(table, vectors, encode, dry_run=True) == 1
    # two streams whose batches have the same numbers, into a table that is there or not
    for target in (vectors, made("fresh")):
        before = target.read().count()
        for name, first in (("a", 1000), ("b", 2000), ("b", 2000)):
            folder = f"{tmp_path}/new-{name}"
            spark.range(first, first + 20).selectExpr("'s' || id AS id", "'text ' || id AS text").write.mode("overwrite").parquet(folder)
            embed.embed_stream(spark.readStream.schema("id string, text string").parquet(folder), target, f"file://{tmp_path}/cp-{name}-{before}", encode).awaitTermination()
        assert target.read().count() == before + 40


def test_event_windows_in_batch_and_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    batch = embed.windowed(events, "ts", ["event_type"], "1 day", "1 hour", F.count("*").alias("n"), F.sum("value").alias("v"))
    want = {(r.window_start, r.event_type): r.n for r in batch.collect()}
    events.write.parquet(f"{tmp_path}/e")
    q = embed.windowed(spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e"), "ts", ["event_type"], "1 day", "1 hour", F.count("*").alias("n")).writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.window_start, r.event_type): r.n for r in spark.table("daily").collect()} == want


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab. ,\n|ăé"), max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_splitter(value, size, overlap):
    parts = segment.split_text(value, size, overlap)
    assert all(0 < len(p) <= size for p in parts)
    squeeze = lambda x: "".join(x.split())
    if not overlap:
        assert squeeze("".join(parts)) == squeeze(value)
    at = 0
    for p in parts:
        at = value.index(p, max(0, at - size))
    for f in (segment.split_section, segment.split_attachment):
        assert squeeze("".join(f(value))) == squeeze(value)


def test_tables_stay_whole_and_long_ones_are_cut_between_rows():
    table = "\n".join(f"| a{i} | b |" for i in range(40))
    assert table in segment.split_guarded("x " * 500 + "\n" + table + "\n" + "y " * 500, 200, 0)
    rows = [f"| {'c' * 90} {i} |" for i in range(50)]
    parts = segment.split_guarded("\n".join(rows), 200, 0)
    assert all(len(p) <= segment.LARGEST_TABLE for p in parts) and "\n".join(parts) == "\n".join(rows)


def test_legal_and_form_splits():
    text = "Phần đầu " * 10 + "\n" + "\n".join(f"Điều {i}. Tên\n" + "1. Khoản một của điều này. " * (8 if i != 2 else 90) for i in range(1, 6))
    parts = segment.split_attachment(text)
    assert parts[0].startswith("Phần đầu") and any(p.startswith("Điều 2. Tên") for p in parts) and all(len(p) <= 1.5 * segment.LEGAL for p in parts)
    assert len(parts) == len(set(parts))
    form = "Kính gửi: trường\n" + "\n".join(f"{h} " + "điền vào đây " * 50 for h in ("Họ và tên", "MSSV", "Lớp", "Tôi xin cam đoan"))
    blocks = segment.split_form(form)
    assert blocks and "".join("".join(b.split()) for b in blocks) == "".join(form.split())
    assert segment.split_form("Kính gửi: a\nMSSV: 1") is None and segment.split_legal("Điều 1. x") is None
    assert segment.glue_hard_cuts(["ab", "ơc", "d"]) == ["ab ơc", "d"]


def test_sections(spark):
    df = spark.createDataFrame([(1, "intro\n12. Head \nbody\n[Tag]\nx"), (2, "13. First\ny")], "id int, text string")
    found = [(r.id, r.section, r.header, r.body) for r in segment.sections(df, "id").orderBy("id", "section").collect()]
    assert found == [(1, 0, "", "intro"), (1, 1, "12. Head", "12. Head \nbody"), (1, 2, "[Tag]", "[Tag]\nx"), (2, 1, "13. First", "13. First\ny")]
    sized = spark.createDataFrame([(1, i, f"h{i}", "x" * n) for i, n in enumerate([100, 200, 400, 100])], "id int, section int, header string, body string")
    merged = segment.merged_sections(sized, "id").orderBy("group_no").collect()
    assert [(r.header, len(r.body)) for r in merged] == [("h0", 302), ("h2", 502)]


PAGE = '<div>A<p>B <a href="/x?y=1">tại đây</a> c</p><script>var q = 1;</script><!-- no --></div><a href="f.pdf">Form &amp; more</a>'


def test_html(spark):
    df = spark.createDataFrame([(PAGE, "https://h.org/d/e", "T")], "h string, b string, t string")
    p = df.select(html.text_and_links(df.h, df.b, df.t).alias("p"), html.text_and_links(df.h, df.b, df.t, drop_script=True)["text"].alias("s")).first()
    assert p.p.text == "A\nB tại đây c\nvar q = 1;\nForm & more" and "var q" not in p.s
    a, b = p.p.links
    assert (a.url, a.type, a.anchor_text) == ("https://h.org/x?y=1", "html_or_external", "tại đây") and a.meaning.startswith("Liên kết trong bài 'T': ")
    assert (b["index"], b.url, b.type, b.meaning) == (2, "https://h.org/d/f.pdf", "pdf", "Form & more")


def test_ingest_from_listing_to_chunks(spark, tmp_path):
    items = [{"DocumentID": str(i), "Title": f"Bài {i}", "TypeDoc": t, "Status": s, "TimeCreate": f"2024-0{i}", "Description": d, "CreaterID": "c"} for i, t, s, d in [(1, "X@HT", 1, PAGE), (2, "X@ĐS", 1, "<p>mail a@b.org [Thẻ]</p>"), (3, "X@HT", 0, "no"), (4, "other", 1, "no")]]
    (tmp_path / "l.json").write_text(json.dumps({"RespCode": 0, "RespText": "", "WebTitleLst": items}))
    listed = ingest.listed(files.listing(spark, str(tmp_path / "l.json")), ingest.categories(spark))
    assert [r.DocumentID for r in listed.collect()] == ["2", "1"]
    mapping = spark.createDataFrame([(1, "Mẫu đơn.docx", "h.org/never", "no"), (2, "Mẫu đơn.docx", "example.org", "Nội dung dài " * 20)], "pos int, filename string, url_signature string, content string")
    made = ingest.with_attachments(ingest.with_local_files(ingest.articles(listed), mapping)).select(*[c.strip().split(" ")[0] for c in ARTICLE.split(", ")][:14], "links", "attachments", "keywords")
    rows = {r.doc_id: r for r in made.collect()}
    assert rows["2"].category_code == "DS" and rows["2"].keywords.emails == ["a@b.org"] and rows["2"].keywords.tags == ["Thẻ"]
    assert [a.name for a in rows["1"].attachments] == ["Mẫu đơn.docx"] * 2 and rows["1"].rag_text.startswith("Tiêu đề: Bài 1\nNhóm: Học tập\n")
    chunks = ingest.chunks(made)
    found = chunks.orderBy("doc_id", "chunk_index").collect()
    one = [r for r in found if r.doc_id == "1"]
    assert [r.chunk_index for r in one] == list(range(len(one))) and len({r.id for r in found}) == len(found)
    assert [r.chunk_type for r in one] == ["summary", "body", "summary", "attachment", "summary", "attachment"] and one[0].id == "doc_1_summary" and one[3].id.endswith("_00_p00")
    held = chunks.withColumns({"embedded_at": F.current_timestamp(), "created_at": F.current_timestamp()})
    again_articles, again = ingest.ingest(made, held, made.filter("doc_id = '1'"))
    assert again.count() == held.count() and again.filter("embedded_at is null").count() == 0 and again_articles.count() == 2
    assert ingest.rag_documents(made).filter("size(attachments) = 2").first().metadata.doc_id == "1"
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({"RespCode": 1, "RespText": "x", "WebTitleLst": []}))
    with pytest.raises(Exception, match="listing failed"):
        files.listing(spark, str(bad)).collect()
    assert files.read_jsonl(spark, str(tmp_path / "l.json"), RAW_ITEM).count() == 1


def docx(*paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs) + "<w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_attachment_files(spark, tmp_path):
    (tmp_path / "x.docx").write_bytes(docx("Một", "Hai"))
    (tmp_path / "x.doc").write_bytes(b"old")
    (tmp_path / "y.doc").write_bytes(b"\x01\x02" + "Nội dung cũ của tệp".encode("utf-16-le") + b"\x00\x00")
    (tmp_path / "z.pdf").write_bytes(b"%PDF-1.4")
    found = {r.filename: (r.content, r.fetch_status) for r in files.attachments(spark, str(tmp_path)).collect()}
    assert found["x.docx"] == ("Một\nHai\na | b", "ok") and "x.doc" not in found and "Nội dung cũ" in found["y.doc"][0] and found["z.pdf"] == ("", "no_pypdf")
    assert files.file_text("z.pdf", b"%PDF", lambda d: "text") == ("text", "ok") and files.file_text("a.zip", b"") == ("", "skipped")


def test_typed_csv(spark, tmp_path):
    names = [c.strip().split(" ")[0] for c in BANK.split(", ")]
    row = ["30", "admin", "single", "x", "no", "-5", "no", "no", "cell", "3", "may", "10", "1", "-1", "0", "unknown", "no"]
    (tmp_path / "b.csv").write_text("\n".join([";".join(names), ";".join(row), ";".join(row)]))
    spark.sql("DROP TABLE IF EXISTS bank")
    assert files.load_csv(spark, str(tmp_path / "b.csv"), "bank", replace=True) == 2 == spark.table("bank").count()
    (tmp_path / "c.csv").write_text(";".join([*names, "more"]) + "\n")
    with pytest.raises(ValueError, match="more"):
        files.load_csv(spark, str(tmp_path / "c.csv"), "bank")
    with pytest.raises(Exception, match="wider"):
        files.validated(spark.createDataFrame([("x" * 30,)], "marital string"), spark.createDataFrame([], "marital string").schema, {"marital": 20}).collect()
    spark.sql("DROP TABLE bank")


@pytest.mark.parametrize("sql,want", [
    ("DROP TABLE t", False), ("SELECT 1", True), ("SELECT updated_at FROM t", True), ("```sql\nWITH a AS (SELECT 1 x) SELECT x FROM a;\n```", True), ("SELECT 1; DROP TABLE t", False), ("INSERT INTO t SELECT 1", False),
    ("FROM a INSERT INTO t SELECT 1", False), ("WITH a AS (SELECT 1) INSERT INTO t SELECT * FROM a", False), ("CREATE TABLE t AS SELECT 1", False), ("SET x = 1", False), ("SELECT a FROM t UNION SELECT b FROM u ORDER BY 1 LIMIT 3", True), ("VALUES (1), (2)", True), ("nonsense", False),
])
def test_guard(spark, sql, want):
    assert sqlfront.is_query(spark, sql) is want


def test_front_door(spark):
    spark.range(5).createOrReplaceTempView("five")
    drafts = ["DELETE FROM five", "SELECT nope FROM five", "SELECT id FROM five WHERE id > 2"]
    seen = []
    door = sqlfront.FrontDoor(spark, lambda q, schema, error: seen.append(error) or drafts[len(seen) - 1])
    got = door.ask("?")
    assert [r["id"] for r in got["rows"]] == [3, 4] and got["attempts"] == 3 and seen[0] is None and "nope" in seen[2]
    assert "Table five:\n  - id (bigint)" in door.schema() and door.history_table().count() == 1
    assert "five {" in sqlfront.diagram(sqlfront.columns(spark)) and sqlfront.explain(spark.table("five"))["warning"] is None
    assert sqlfront.limited(spark.range(500)).count() == 100 and sqlfront.limited(spark.range(500).limit(300)).count() == 300
    spark.range(20_000).createOrReplaceTempView("many")
    for sql, n in (("SELECT id AS creditLimit FROM many", 100), ("SELECT id FROM many WHERE id >= (SELECT id FROM many LIMIT 1)", 100), ("SELECT id FROM many ORDER BY id LIMIT 150", 150), ("SELECT id FROM many LIMIT 15000", sqlfront.MOST_ROWS)):
        assert sqlfront.limited(spark.sql(sql)).count() == n, sql
    told = sqlfront.request("q?", "Table t:", "no such column")
    assert told[0]["role"] == "system" and "Table t:" in told[0]["content"] and told[-1]["content"].startswith("q?\n") and len(told) == 2 + 2 * len(sqlfront.EXAMPLES)
    assert sqlfront.quoted("a_b") == '"A_B"'
    with pytest.raises(ValueError):
        sqlfront.quoted("a b")


def test_prompt_and_chain(spark):
    docs = spark.createDataFrame([(1, "x" * 50, "T", "u", "body"), (2, "form", "F", "v", "attachment")], "pos int, text string, title string, source_url string, chunk_type string")
    long = prompt.context(docs.limit(1), most=60).collect()
    assert len(long) == 1 and long[0].entry.endswith("...\nNguồn: u\n")
    assert [r.entry.splitlines()[1] for r in prompt.context(docs, "mẫu").orderBy("place").collect()][0] == "form"
    assert prompt.NOTHING in prompt.prompt(prompt.context(docs.limit(0)), "q").first().prompt
    chunks = chunk_rows(spark).withColumn("text", F.concat_ws(" ", "text", "chunk_id"))
    vectors = embed.embed(chunks.select(F.col("chunk_id").alias("id"), "text"), embed.hashing_encoder(16))
    encode = lambda q: embed.hashing_encoder(16)([q])[0]
    for mode in answer.MODES:
        chain = answer.Chain(chunks, vectors, encode, lambda p, s: "yes", lambda p, s: iter(["a", "b"]), mode=mode)
        got = chain.answer("x b0")
        assert got["answer"] == "yes" and got["sources"] and "x b0" in got["prompt"], mode
    assert list(chain.stream_answer("x b0")) == ["a", "b"]
    with pytest.warns(UserWarning, match="unknown mode"):
        answer.retrieve(chunks, vectors, "x", encode("x"), "other").count()


def test_details_keep_errors_with_their_rows(spark):
    def fetch(k):
        if k == "2":
            raise RuntimeError("gone")
        return {"k": k}

    found = {r.key: (r.detail, r.error) for r in http.details(spark.range(1, 4), "id", fetch, 0).collect()}
    assert found == {"1": ('{"k": "1"}', None), "2": (None, "gone"), "3": ('{"k": "3"}', None)}
    with pytest.raises(RuntimeError):
        http.post_json("http://127.0.0.1:9/x", {}, 0.2)
    assert http.get_bytes("http://127.0.0.1:9/x", 0.2) is None and http.LanguageModel("http://127.0.0.1:9", "m").healthy(0.2) is False


def test_execution_is_off_and_bounded(spark):
    df = spark.createDataFrame([("```python\nprint(1)\n```",), ("```python\n1/0\n```",), ("```python\nwhile True: pass\n```",), ("```python\n(\n```",)], "completion string")
    with pytest.raises(PermissionError):
        execution.with_execution(df)
    assert [r.r_executable for r in execution.with_execution(df, seconds=1, allow=True).collect()] == [1.0, 0.2, 0.1, 0.0]


def test_training_tables(spark):
    rows = spark.range(2000)
    parts = {r.part: r["count"] for r in training.split(rows, "id").groupBy("part").count().collect()}
    assert 150 < parts["test"] < 250 and training.split(rows, "id").exceptAll(training.split(rows, "id")).isEmpty()
    made = training.with_rewards(spark.createDataFrame([("```python\nx = 1\n```",), ("no no",)], "completion string"))
    r = training.rates(made).first()
    assert (r.syntax_rate, r.format_rate) == (0.5, 0.5)
    m = spark.createDataFrame([(1, {"rewards/a": 1.0, "completions/b": 2.0, "loss": 3.0})], "step int, metrics map<string,double>")
    g = training.metric_groups(m).first()
    assert (g.rewards, g.completions, g.other) == ({"rewards/a": 1.0}, {"completions/b": 2.0}, {"loss": 3.0})


def test_published_versions_survive_a_writer_that_died(spark, tmp_path):
    root = f"file://{tmp_path}/t"
    store.publish(spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string"), root)
    second = store.publish(spark.createDataFrame([(1, "c"), (2, "b")], "id int, v string"), root)
    # a version that was written but never took a number
    spark.createDataFrame([(9, "x")], "id int, v string").write.parquet(f"{root}/v-{9:012d}-{'0' * 32}")
    assert store.versions(spark, root)[-1] == second
    read = lambda: sorted(tuple(r) for r in store.current(spark, root).collect())
    assert read() == [(1, "c"), (2, "b")]
    # two writers that saw the same last version: one gets a conflict, nothing vanishes
    df, both = spark.createDataFrame([(3, "e")], "id int, v string"), threading.Barrier(2)
    real = store.put_once
    results = []

    def at_once(spark, target, text):
        both.wait()
        return real(spark, target, text)

    def write():
        try:
            results.append(store.publish(df, root))
        except Conflict:
            results.append(None)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(store, "put_once", at_once)
        threads = [threading.Thread(target=write) for _ in range(2)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    assert sorted(r is None for r in results) == [False, True] and len(store.versions(spark, root)) == 3 and read() == [(3, "e")]
    assert store.vacuum(spark, root, 1) == 2 and len(store.versions(spark, root)) == 1 and read() == [(3, "e")]


def test_run_log(spark, tmp_path):
    path = str(tmp_path / "log")
    a, b = store.start_run(spark, path, fetch_attachments=True), store.start_run(spark, path)
    store.finish_run(spark, path, a, 3, 20, 4, {"ok": 2}, status="success")
    found = {r.id: r for r in store.latest_runs(spark.read.schema(store.RUN).json(path)).collect()}
    assert found[b].status == "running" and (found[a].status, found[a].chunks, found[a].fetch_attachments, found[a].attachment_counts) == ("success", 20, True, {"ok": 2})


def test_attachments_are_fetched_by_kind(spark):
    answers = {
        "https://docs.google.com/document/d/ab/export?format=txt": " Nội  dung ".encode(), "https://drive.google.com/uc?export=download&id=cd": b"%PDF x", "https://drive.google.com/uc?export=download&id=ef": b"<!DOCTYPE html>",
        "https://drive.google.com/uc?export=download&id=gh": b"GIF8", "https://h.org/a.pdf": b"%PDF y", "https://h.org/none.pdf": None, "https://h.org/blank.pdf": b"%PDF blank",
    }
    rows = [
        ("https://docs.google.com/document/d/ab/edit", "google_doc"), ("https://docs.google.com/document/u", "google_doc"), ("https://drive.google.com/file/d/cd/view", "google_drive"), ("https://drive.google.com/file/d/ef/view", "google_drive"),
        ("https://drive.google.com/file/d/gh/view", "google_drive"), ("https://h.org/a.pdf", "pdf"), ("https://h.org/a.pdf", "pdf"), ("https://h.org/none.pdf", "pdf"), ("https://h.org/blank.pdf", "pdf"), ("https://h.org/x", "html_or_external"), ("https://t.sharepoint.com/:w:/a", "word_online"),
    ]
    links = spark.createDataFrame([(i, u, k, None, "?") for i, (u, k) in enumerate(rows)], "index int, url string, type string, content string, fetch_status string")
    pdf = lambda data: "" if b"blank" in data else f"text of {data[5:].decode()}"
    found = [(r.content, r.fetch_status) for r in http.fetch_attachments(links, answers.get, pdf, 0).orderBy("index").collect()]
    assert found == [("Nội dung", "ok"), (None, "fetch_error"), ("text of x", "ok"), (None, "fetch_error"), (None, "empty"), ("text of y", "ok"), ("text of y", "ok"), (None, "fetch_error"), (None, "empty"), (None, "skipped"), (None, "auth_required")]
    assert http.attachment_bytes("pdf", "u", None, answers.get, None) == (None, "no_pypdf")
    assert http.fetch_attachments(links.filter("index = 0"), answers.get, pdf, 0, most=3).first().content == "Nội"


def test_early_stop_goes_on_from_a_state(spark):
    values = [0.5, 0.504, 0.506, 0.506, 0.507, 0.508]
    rows = lambda part: spark.createDataFrame([([(i, v) for i, v in part],)], "h array<struct<step:long,value:double>>")
    from loomwright.functions import scores

    whole = rows(list(enumerate(values))).select(scores.early_stop(F.col("h"))).first()[0]
    first = rows(list(enumerate(values))[:3]).select(scores.early_stop(F.col("h")).alias("s"))
    again = first.crossJoin(rows(list(enumerate(values))[3:])).select(scores.early_stop(F.col("h"), state=F.col("s"))).first()[0]
    assert again == whole and whole.stopped_step == 5


def test_routes_and_long_attachments():
    assert [segment.route(x) for x in ("short", "Điều 1. " + "x " * 2000, "Kính gửi " + "x " * 2000, "x " * 2000)] == ["intact", "legal", "form", "general"]
    text = "câu văn. " * 9000
    assert "".join("".join(segment.split_attachment(text)).split()) .count("câuvăn.") >= 9000 and sum(map(len, segment.split_attachment(text, 5000))) < 6000


def test_verdict_exit(spark):
    assert retrieval.failed(spark.createDataFrame([("PASS",), ("FAIL",)], "verdict string")) and not retrieval.failed(spark.createDataFrame([("PASS",)], "verdict string"))


def test_parts_are_made_once_for_each_article(spark):
    docs = spark.createDataFrame([(1, "t", None, "12. a\nb", [("x", "Mẫu đơn", "nội dung " * 20)]), (2, None, None, "only text", []), (3, None, None, "", None)], "doc_id long, title string, category_name string, text string, attachments array<struct<attachment_id:string,name:string,content:string>>")
    made = segment.chunks(docs)
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_parts(") == 1
    got = {(r.doc_id, r.chunk_index): r.text for r in made.collect()}
    assert got[("1", 0)] == "Bài viết: t\nBài viết 't'."
    assert got[("2", 0)] == "only text"
    assert all(doc != "3" for doc, _ in got)
