"""One query for each operator of the survey, over the driver's tables, and the same in SQL where SQL can express it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from loomwright.functions import chat, ids, scores, text
from loomwright.functions.patterns import with_first_match
from loomwright.operators import html, quality, retrieval, segment, store, training
from loomwright.operators.candidates import JsonIndex, TrigramIndex
from loomwright.operators.inverted import TextIndex
from loomwright.operators.keyed import KeyedTable
from loomwright.operators.quarantine import Quarantine, Stage, attempt, checks
from loomwright.operators.vector_index import VectorIndex
from loomwright.plans import ingest, prompt, sqlfront
from loomwright.session import shared_dir
from loomwright.sources import files

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        name = f.__name__.strip("_")
        Q[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def scratch(spark: SparkSession, name: str) -> str:
    """A folder of its own for a table that a query writes."""
    return f"{shared_dir(spark)}/loomwright/{name}-{uuid.uuid4().hex}"


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


WORDS = r"list_distinct(list_filter(string_split_regex(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"
CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({}, '[\p{{So}}□☐■▪▫♦●○★☆▶►◄▼▲]', '', 'g'), '[ \t\r\f\v]+', ' ', 'g'), ' *\n *', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT doc_id, {CLEAN.format('nfc_normalize(text)')} AS clean FROM documents")
def clean_text(s, d):
    return t(s, d, "documents").select("doc_id", text.clean_text(F.col("text")).alias("clean"))


@query(rf"SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '{text.EMAIL}'))), ',') AS emails FROM documents")
def emails_distinct(s, d):
    return t(s, d, "documents").select("doc_id", F.array_join(text.emails(F.col("text")), ",").alias("emails"))


TAGGED = "concat('[', source, '] ', text, ' [x] [', lang, '](u)')"


@query(rf"""SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(replace({TAGGED}, '[' || lang || '](u)', ''), '\[([^\]]+)\]', 1), lambda x: length(x) BETWEEN 2 AND 49))), ',') AS tags FROM documents""")
def bracket_tags(s, d):
    tagged = F.expr(TAGGED)
    return t(s, d, "documents").select("doc_id", F.array_join(text.bracket_tags(tagged), ",").alias("tags"))


TITLE = r"regexp_extract(html, '<title>([^<]*)</title>', 1)"
ASCII = r"regexp_replace(strip_accents(nfc_normalize({})), '[đĐ]', 'd', 'g')"


@query(rf"""SELECT page_id, coalesce(nullif(regexp_replace(regexp_replace(lower({ASCII.format(TITLE)}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), ''), 'khong-co-tieu-de') AS slug FROM pages""")
def url_slug(s, d):
    return t(s, d, "pages").select("page_id", text.url_slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


@query(rf"""SELECT page_id, coalesce(nullif(substr(regexp_replace(lower(regexp_replace({ASCII.format(TITLE)}, '[^a-zA-Z0-9]+', '_', 'g')), '^_+|_+$', '', 'g'), 1, 24), ''), 'sec') AS slug FROM pages""")
def section_slug(s, d):
    return t(s, d, "pages").select("page_id", text.section_slug(F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("slug"))


HREFS = """regexp_extract_all(html, '<a href="([^"]*)"', 1)"""
LINK_CASE = """CASE WHEN regexp_matches(b, '[.](pdf|docx|doc|xlsx|xls|pptx|ppt|zip|rar|png|jpg|jpeg)$') THEN regexp_extract(b, '[.]([a-z]+)$', 1)
 WHEN starts_with(u, 'mailto:') THEN 'email' WHEN contains(b, 'forms.office.com') OR contains(b, 'docs.google.com/forms') THEN 'form'
 WHEN contains(lower(u), 'sharepoint.com/:w:/') THEN 'word_online' WHEN contains(lower(u), 'sharepoint.com/:x:/') THEN 'excel_online' WHEN contains(lower(u), 'sharepoint.com/:p:/') THEN 'powerpoint_online'
 WHEN contains(b, 'docs.google.com/document') THEN 'google_doc' WHEN contains(b, 'docs.google.com/spreadsheets') THEN 'google_sheet' WHEN contains(b, 'drive.google.com') THEN 'google_drive'
 WHEN regexp_matches(b, '^https?://') THEN 'html_or_external' ELSE 'relative_or_unknown' END"""
LINKS = ["https://x.org/a.PDF?dl=1#p", "https://docs.google.com/forms/d/1", "https://t.sharepoint.com/:w:/g/a", "https://docs.google.com/spreadsheets/d/1", "https://drive.google.com/file/d/ab/view", "mailto:a@b.org", "https://x.org/", "/local"]
LINK_ROWS = " UNION ALL ".join(f"SELECT {-i - 1}, '{u}'" for i, u in enumerate(LINKS))


@query(f"WITH r AS (SELECT page_id, url AS u FROM pages UNION ALL SELECT page_id, unnest({HREFS}) FROM pages UNION ALL {LINK_ROWS}), b AS (SELECT page_id, u, split_part(split_part(lower(u), '?', 1), '#', 1) AS b FROM r) SELECT page_id, u AS url, {LINK_CASE} AS type FROM b")
def link_type(s, d):
    p = t(s, d, "pages")
    urls = p.select("page_id", "url").union(p.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))))).union(s.createDataFrame([(-i - 1, u) for i, u in enumerate(LINKS)], "page_id long, url string"))
    return urls.select("page_id", "url", text.link_type(F.col("url")).alias("type"))


@query(f"SELECT page_id, unnest({HREFS}) AS href FROM pages")
def href_extract(s, d):
    return t(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), F.lit(1))).alias("href"))


ANCHORS = """regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)"""


@query(rf"""WITH a AS (SELECT page_id, unnest({ANCHORS}) AS anchor FROM pages UNION ALL SELECT -1, 'Tại đây!' UNION ALL SELECT -2, 'Click  here' UNION ALL SELECT -3, 'Xem thêm')
SELECT page_id, anchor, trim(regexp_replace(regexp_replace(lower({ASCII.format('anchor')}), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) IN ('tai day', 'link', 'xem them', 'bam vao day', 'click here') AS generic FROM a""")
def generic_anchor(s, d):
    a = t(s, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('<a href="[^"]*">([^<]*)</a>'), F.lit(1))).alias("anchor"))
    a = a.union(s.createDataFrame([(-1, "Tại đây!"), (-2, "Click  here"), (-3, "Xem thêm")], "page_id long, anchor string"))
    return a.select("page_id", "anchor", text.generic_anchor(F.col("anchor")).alias("generic"))


@query("""WITH n AS (SELECT unnest(['abc', 'click here', 'QD HB', 'QD123', 'Form.pdf', 'tại đây', 'LONG UPPER NAME']) AS name UNION ALL SELECT DISTINCT source FROM documents)
SELECT name, length(trim(name)) < 5 OR lower(trim(name)) IN ('click here', 'tại đây', 'download here', 'xem thêm') OR (trim(name) = upper(trim(name)) AND length(trim(name)) <= 12 AND NOT regexp_matches(name, '[0-9]')) AS junk FROM n""")
def junk_attachment(s, d):
    n = s.createDataFrame([(x,) for x in ("abc", "click here", "QD HB", "QD123", "Form.pdf", "tại đây", "LONG UPPER NAME")], "name string").union(t(s, d, "documents").select("source").distinct())
    return n.select("name", text.junk_attachment(F.col("name")).alias("junk"))


@query()
def html_text_links(s, d):
    """The page's whole text and the links with context and meaning; Python's parser decides, tests hold it against literal pages."""
    p = t(s, d, "pages").select("page_id", html.text_and_links(F.col("html"), F.col("url"), F.lit("page")).alias("p"))
    return p.select("page_id", F.length("p.text").alias("n_chars"), F.size("p.links").alias("n_links"), F.sha2("p.text", 256).alias("text_hash"))


@query("SELECT doc_id, sha256(text) AS content_hash FROM documents")
def content_hash(s, d):
    return t(s, d, "documents").select("doc_id", ids.content_hash(F.col("text")).alias("content_hash"))


@query("SELECT page_id, substr(sha256(url), 1, 16) AS attachment_id FROM pages")
def attachment_id(s, d):
    return t(s, d, "pages").select("page_id", ids.short_hash(F.col("url")).alias("attachment_id"))


@query(r"""WITH h AS (SELECT doc_id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode('doc_' || doc_id)) AS h FROM documents)
SELECT doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + ('0x' || substr(h, 17, 1))::INT % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS point_id FROM h""")
def point_uuid5(s, d):
    return t(s, d, "documents").select("doc_id", ids.uuid5(F.concat(F.lit("doc_"), "doc_id")).alias("point_id"))


@query("""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS seq, unnest(string_split(text, chr(10))) AS line FROM documents),
g AS (SELECT doc_id, seq, coalesce(nullif(substr(regexp_replace(lower(regexp_replace(regexp_replace(strip_accents(nfc_normalize(line)), '[đĐ]', 'd', 'g'), '[^a-zA-Z0-9]+', '_', 'g')), '^_+|_+$', '', 'g'), 1, 24), ''), 'sec') AS slug FROM l),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY seq) - 1 AS page FROM g)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS chunk_index, 'doc_' || doc_id || '_body_' || slug || '_p' || CASE WHEN page < 100 THEN lpad(page::VARCHAR, 2, '0') ELSE page::VARCHAR END AS id FROM n""")
def stable_chunk_id(s, d):
    made = t(s, d, "documents").select("doc_id", text.section_slugs(F.col("text")).alias("slugs"))
    rows = made.select("doc_id", F.posexplode(F.arrays_zip("slugs", segment.pages(F.col("slugs")).alias("pages"))).alias("chunk_index", "p"))
    return rows.select("doc_id", "chunk_index", ids.body_id(ids.add_prefix("doc_", F.col("doc_id")), F.col("p.slugs"), F.col("p.pages")).alias("id"))


@query("""SELECT count(*) AS n, round(avg(length(text)), 2) AS mean_chars, max(length(text)) AS max_chars, min(length(text)) AS min_chars, count(*) FILTER (length(text) > 2000) AS too_long,
count(*) FILTER (length(text) < 200) AS too_short, count(doc_id) - count(DISTINCT doc_id) AS repeated_ids, count(*) FILTER (regexp_matches(text, '^\\s*[ăâêôơư]')) AS hard_cuts FROM documents""".replace("\\\\", "\\"))
def profile_lengths(s, d):
    return quality.profile(t(s, d, "documents"), id_col="doc_id")


@query("SELECT md5(text) AS key, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, key LIMIT 5")
def dup_ids_top5(s, d):
    return quality.repeated(t(s, d, "documents").select(F.md5("text").alias("key")), "key")


@query("SELECT sha256(text) AS content_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def dup_text_groups(s, d):
    return t(s, d, "documents").groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def status_map(s, d):
    return quality.status_counts(t(s, d, "events"), "event_type").select(F.explode("counts").alias("event_type", "n"))


@query("""SELECT count(*) AS total, count(*) FILTER (l.quality IS NOT NULL) AS embedded, count(*) FILTER (l.quality IS NULL) AS pending,
round(100.0 * count(*) FILTER (l.quality IS NOT NULL) / nullif(count(*), 0), 1)::DOUBLE AS percent FROM documents d LEFT JOIN labels l USING (doc_id)""")
def embed_progress(s, d):
    return store.progress(t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left").withColumn("embedded_at", F.col("quality")))


@query(r"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))) AS n_lines FROM documents")
def line_nonempty_count(s, d):
    return t(s, d, "documents").select("doc_id", text.filled_lines(F.col("text")).alias("n_lines"))


@query(r"""WITH l AS (SELECT conv_id, turn, role, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS section FROM conversations)
SELECT conv_id, section::INT AS section, CASE WHEN section = 0 THEN '' ELSE '12. ' || min(turn) END AS header, count(*) AS n_lines FROM l GROUP BY conv_id, l.section""")
def sections_islands(s, d):
    """Each user's turn begins a section of its conversation."""
    line = F.when(F.col("role") == "user", F.concat(F.lit(" 12. "), "turn")).otherwise(F.concat(F.lit("turn "), "turn"))
    docs = t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))).alias("x")).select("conv_id", F.array_join(F.col("x.line"), "\n").alias("text"))
    return segment.sections(docs, "conv_id").select("conv_id", "section", "header", F.size(F.split("body", "\n")).alias("n_lines"))


@query(r"""WITH l AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS section, unnest(string_split(text, chr(10))) AS body FROM documents),
o AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY doc_id ORDER BY section) = 1 OR length(trim(body)) >= 350 THEN 1 ELSE 0 END AS opens FROM l),
g AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY section) AS group_no FROM o),
m AS (SELECT doc_id, group_no, min(section) AS first_line, regexp_replace(string_agg(body, chr(10) || chr(10) ORDER BY section), '\s+\n\n', chr(10) || chr(10), 'g') AS body FROM g GROUP BY doc_id, group_no)
SELECT doc_id, group_no::INT AS group_no, 'line ' || first_line AS header, md5(body) AS body_hash FROM m WHERE regexp_matches(body, '\S')""")
def sections_merge_tiny(s, d):
    found = segment.lines(t(s, d, "documents"), "doc_id").select("doc_id", F.col("line_no").alias("section"), F.concat(F.lit("line "), "line_no").alias("header"), F.col("line").alias("body"))
    return segment.merged_sections(found, "doc_id").select("doc_id", "group_no", "header", F.md5("body").alias("body_hash"))


@query(r"""WITH d AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^\S{6,}(\s|$)') THEN '17. ' || x ELSE x END) AS x FROM documents),
l AS (SELECT doc_id, unnest(range(len(x))) AS n, unnest(x) AS line FROM d),
f AS (SELECT *, regexp_matches(trim(line), '^[0-9]{2,3}\.\s') OR regexp_matches(trim(line), '^\[[\p{L}\p{N}_\s]+\]\s*$') AS starts FROM l),
g AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM f)
SELECT doc_id, section::INT AS section, coalesce(max(CASE WHEN starts THEN trim(line) END), '') AS header, length(string_agg(line, chr(10) ORDER BY n)) AS n_chars FROM g GROUP BY 1, 2 HAVING section > 0 OR string_agg(line, chr(10) ORDER BY n) <> ''""")
def section_parse(s, d):
    """Sections with their headers, of texts whose longer first words of lines are numbered."""
    numbered = F.concat_ws("", F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.when(i > 0, "\n").otherwise(""), F.when(x.rlike(r"^\S{6,}(\s|$)"), "17. ").otherwise(""), x)))
    return segment.sections(t(s, d, "documents").select("doc_id", numbered.alias("text")), "doc_id").select("doc_id", "section", "header", F.length("body").alias("n_chars"))


@query()
def recursive_split(s, d):
    """Tests check size, coverage and order of the parts."""
    made = t(s, d, "documents").select("doc_id", F.posexplode(segment.splitter(segment.split_text)(F.col("text"))).alias("seq", "part"))
    return made.select("doc_id", "seq", F.length("part").alias("n_chars"), F.sha2("part", 256).alias("part_hash"))


@query()
def attachment_split(s, d):
    made = t(s, d, "documents").select("doc_id", F.posexplode(segment.splitter(segment.split_attachment)(F.col("text"))).alias("seq", "part"))
    return made.select("doc_id", "seq", F.length("part").alias("n_chars"), F.sha2("part", 256).alias("part_hash"))


@query()
def chunk_assembly(s, d):
    att = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(ids.short_hash(F.col("text")).alias("attachment_id"), F.concat("source", F.lit(" form")).alias("name"), F.col("text").alias("content")))).otherwise(F.array())
    made = t(s, d, "documents").select("doc_id", F.concat("lang", F.lit(" "), "source").alias("title"), F.col("lang").alias("category_name"), "text", att.alias("attachments"))
    return segment.chunks(made).select("id", "parent_id", "chunk_index", "chunk_type", "attachment_index", "attachment_chunk_index", "content_hash")


ROUTE = r"""SELECT doc_id, CASE WHEN length(x) <= 1800 THEN 'intact' WHEN regexp_matches(substr(x, 1, 3000), '(?m)^Điều\s+\d+[.:]?\s') THEN 'legal'
WHEN regexp_matches(substr(x, 1, 2000), 'Kính gửi') THEN 'form' ELSE 'general' END AS route FROM
(SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'Điều 1. ' || text WHEN 1 THEN 'Kính gửi ' || text ELSE text END AS x FROM documents)"""


@query(ROUTE)
def legal_form_route(s, d):
    x = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Điều 1. "), "text")).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Kính gửi "), "text")).otherwise(F.col("text"))
    docs = t(s, d, "documents").select("doc_id", x.alias("x"))
    return docs.select("doc_id", segment.routes(F.col("x")).alias("route"))


PROBE = [1.0 if i % 2 else -0.5 for i in range(64)]
PROBE_SQL = "[" + ", ".join(f"{x}::DOUBLE" for x in PROBE) + "]"
COS = f"round(list_cosine_similarity(embedding::DOUBLE[], {PROBE_SQL}), 6)"


def _ranked(inner: str, order: str, k: int) -> str:
    return f"SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM ({inner}) QUALIFY rank <= {k}"


@query(_ranked(f"SELECT vec_id, {COS} AS score FROM embeddings", "score DESC, vec_id", 20))
def vector_topk(s, d):
    return retrieval.vector_topk(t(s, d, "embeddings"), PROBE, 20, "vec_id", digits=6)


@query(_ranked(f"SELECT vec_id, {COS} AS score FROM embeddings WHERE label = 3", "score DESC, vec_id", 10))
def vector_topk_filtered(s, d):
    return retrieval.vector_topk(retrieval.payload_filter(t(s, d, "embeddings"), label=3, vec_id=None), PROBE, 10, "vec_id", digits=6)


ASK = "the and that"
ALL_WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x IN ('the', 'and', 'that'))"
TEXT_HITS = _ranked(f"SELECT doc_id, len({ALL_WORDS})::DOUBLE AS score FROM documents WHERE len(list_distinct({ALL_WORDS})) = 3", "score DESC, doc_id", 20)


@query(TEXT_HITS)
def text_topk_and(s, d):
    return retrieval.text_topk(t(s, d, "documents"), ASK, 20, "doc_id")


VEC_AS_DOC = _ranked(f"SELECT vec_id AS doc_id, {COS} AS score FROM embeddings", "score DESC, doc_id", 20)
FUSED = f"""WITH v AS ({VEC_AS_DOC}), x AS ({TEXT_HITS})
SELECT coalesce(v.doc_id, x.doc_id) AS doc_id, round(coalesce(1.0::DOUBLE / (60 + v.rank), 0) + coalesce(1.0::DOUBLE / (60 + x.rank), 0), 9) AS score, v.rank AS vector_rank, x.rank AS text_rank FROM v FULL JOIN x USING (doc_id)"""


def _lists(s, d):
    return retrieval.vector_topk(t(s, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), PROBE, 20, "doc_id", digits=6), retrieval.text_topk(t(s, d, "documents"), ASK, 20, "doc_id")


@query(FUSED)
def rrf_fuse(s, d):
    return retrieval.rrf(list(_lists(s, d)), id_col="doc_id").select("doc_id", F.round("score", 9).alias("score"), F.col("rank_1").alias("vector_rank"), F.col("rank_2").alias("text_rank"))


@query(f"""WITH f AS ({FUSED}), k AS (SELECT *, row_number() OVER (ORDER BY score DESC, vector_rank NULLS LAST, text_rank NULLS LAST) AS rank FROM f QUALIFY rank <= 20)
SELECT doc_id, lang, score, vector_rank, text_rank, rank FROM k JOIN documents USING (doc_id)""")
def hybrid_search(s, d):
    v, x = _lists(s, d)
    found = retrieval.hybrid(v, x, t(s, d, "documents").select("doc_id", "lang"), 20, id_col="doc_id")
    return found.select("doc_id", "lang", F.round("score", 9).alias("score"), "vector_rank", "text_rank", "rank")


@query(f"WITH x AS ({TEXT_HITS}) SELECT doc_id, round(1.0::DOUBLE / (60 + rank), 9) AS score, rank FROM x WHERE rank <= 5")
def text_only_search(s, d):
    return retrieval.single_mode(_lists(s, d)[1], t(s, d, "documents").select("doc_id"), 5, "text", id_col="doc_id").select("doc_id", F.round("score", 9).alias("score"), "rank")


QUESTION = "the thing that is"
OVERLAP = f"len(list_intersect({WORDS.format('d.text')}, ['the', 'thing', 'that', 'is'])) / 4.0::DOUBLE"


@query(f"""WITH h AS ({TEXT_HITS}), s AS (SELECT h.doc_id, h.score AS pre_rerank_score, round({OVERLAP}, 6) AS rerank_score FROM h JOIN documents d USING (doc_id))
SELECT *, row_number() OVER (ORDER BY rerank_score DESC, pre_rerank_score DESC, doc_id) AS rank FROM s QUALIFY rank <= 5""")
def rerank_stub(s, d):
    hits = t(s, d, "documents").select("doc_id", "text").join(_lists(s, d)[1], "doc_id")
    return retrieval.rerank(hits, QUESTION, 5, id_col="doc_id").select("doc_id", "pre_rerank_score", F.round("rerank_score", 6).alias("rerank_score"), "rank")


TURNS = "SELECT conv_id || '-' || turn AS chunk_id, conv_id AS doc_id, turn AS chunk_index, role, text FROM conversations"


def turns(s, d):
    return t(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("chunk_index"), F.col("role").alias("chunk_type"), "text")


@query(f"WITH c AS ({TURNS}) SELECT h.chunk_id AS hit_id, n.chunk_id FROM c h JOIN c n ON h.doc_id = n.doc_id AND n.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1 AND n.role <> 'system' WHERE h.chunk_index = 1")
def neighbor_expand(s, d):
    c = turns(s, d)
    hits = c.filter("chunk_index = 1").select("doc_id", "chunk_index", F.col("chunk_id").alias("hit_rank"), F.lit(1.0).alias("score"))
    return retrieval.neighbours(hits, c, skip=("system",)).select(F.col("hit_rank").alias("hit_id"), "chunk_id")


def as_chunks(c: DataFrame, kind: str, name: str | None) -> DataFrame:
    """Turns as chunks of one kind, and of one attachment of that name."""
    att = F.lit(name).cast("string")
    return c.withColumns({"chunk_type": F.lit(kind), "attachment_name": att, "attachment_index": F.when(att.isNotNull(), 0), "attachment_chunk_index": F.when(att.isNotNull(), F.col("chunk_index").cast("int")).otherwise(-1)})


@query(f"""WITH c AS ({TURNS}), n AS (SELECT doc_id, count(*) AS n FROM c GROUP BY 1)
SELECT x.doc_id, x.chunk_index, CASE WHEN x.chunk_index = 1 THEN 1.0 ELSE 0.8 END::DOUBLE AS score FROM c h JOIN c x USING (doc_id) JOIN n USING (doc_id) WHERE h.chunk_index = 1 AND (n.n <= 5 OR x.chunk_index BETWEEN 0 AND 2)""")
def short_or_window_expand(s, d):
    """Each conversation is one attachment: short ones come whole, of others the neighbours of the hit."""
    c = as_chunks(turns(s, d), "attachment", "a")
    hits = c.filter("chunk_index = 1").select("chunk_id", F.lit(1.0).alias("score"), F.col("doc_id").alias("rank"))
    return retrieval.expand(hits, c).select("doc_id", "chunk_index", "score")


@query(f"""WITH c AS ({TURNS}), k AS (SELECT doc_id, chunk_index + 1 AS chunk_index, row_number() OVER (PARTITION BY doc_id ORDER BY chunk_index) AS n FROM c)
SELECT doc_id, chunk_index, 0.9::DOUBLE AS score FROM k WHERE n <= 10 UNION ALL SELECT DISTINCT doc_id, 0, 1.0::DOUBLE FROM c""")
def parent_children_cap(s, d):
    """Each conversation has a summary, which brings the first ten turns."""
    c = as_chunks(turns(s, d).withColumn("chunk_index", F.col("chunk_index") + 1), "body", None)
    one = turns(s, d).select("doc_id").distinct().select(F.concat(F.col("doc_id").cast("string"), F.lit("-top")).alias("chunk_id"), "doc_id", F.lit(0).cast("long").alias("chunk_index"), F.lit("").alias("chunk_type"), F.lit("").alias("text"))
    top = as_chunks(one, "summary", None)
    hits = top.select("chunk_id", F.lit(1.0).alias("score"), F.col("doc_id").alias("rank"))
    return retrieval.expand(hits, c.union(top)).select("doc_id", "chunk_index", "score")


@query(f"""WITH c AS ({TURNS}), h AS (SELECT *, 2 * doc_id + 3 - chunk_index AS hit_rank FROM c WHERE chunk_index IN (1, 2) AND role <> 'system'),
e AS (SELECT chunk_id, doc_id, chunk_index, hit_rank, 0 AS phase, 1.0::DOUBLE / hit_rank AS score FROM h
      UNION ALL SELECT n.chunk_id, n.doc_id, n.chunk_index, h.hit_rank, 1, 0.8::DOUBLE * (1.0::DOUBLE / h.hit_rank) FROM h JOIN c n ON h.doc_id = n.doc_id AND n.role <> 'system' AND n.chunk_index BETWEEN h.chunk_index - 1 AND h.chunk_index + 1)
SELECT doc_id, chunk_index, round(score, 9) AS score, hit_rank, phase FROM e QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY hit_rank, phase, chunk_index) = 1""")
def expand_first_wins(s, d):
    """Turns 1 and 2 of every conversation are hits, the later one first."""
    c = turns(s, d).withColumn("chunk_type", F.when(F.col("chunk_type") == "system", "summary").otherwise("body"))
    c = c.withColumns({"attachment_name": F.lit(None).cast("string"), "attachment_index": F.lit(None).cast("int"), "attachment_chunk_index": F.lit(-1)})
    hits = c.filter("chunk_index IN (1, 2) AND chunk_type = 'body'").withColumn("rank", 2 * F.col("doc_id") + 3 - F.col("chunk_index")).withColumn("score", F.lit(1.0) / F.col("rank"))
    return retrieval.expand(hits, c).select("doc_id", "chunk_index", F.round("score", 9).alias("score"), "hit_rank", "phase")


CASES = [(1, ["the"]), (2, ["zzzz", "ation"]), (3, ["qqqq"]), (4, []), (5, ["  THE   And "])]
CASE_SQL = " UNION ALL ".join(f"SELECT {i} AS case_id, {[' '.join(x.lower().split()) for x in terms]}::VARCHAR[] AS terms" for i, terms in CASES)


@query(f"""WITH k AS ({CASE_SQL}), h AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS hay FROM documents QUALIFY rank <= 3),
s AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars, doc_id) AS rank, regexp_replace(lower(trim(text)), '\\s+', ' ', 'g') AS hay FROM documents QUALIFY rank <= 3),
e AS (SELECT case_id, min(rank) AS r FROM k, h WHERE len(list_filter(terms, lambda x: contains(hay, x))) > 0 GROUP BY 1), f AS (SELECT case_id, min(rank) AS r FROM k, s WHERE len(list_filter(terms, lambda x: contains(hay, x))) > 0 GROUP BY 1)
SELECT k.case_id, CASE WHEN len(terms) = 0 THEN 'MANUAL' WHEN e.r = 1 THEN 'PASS' WHEN e.r <= 3 OR f.r <= 3 THEN 'PARTIAL' ELSE 'FAIL' END AS verdict FROM k LEFT JOIN e USING (case_id) LEFT JOIN f USING (case_id)""")
def retrieval_verdict(s, d):
    cases = s.createDataFrame(CASES, "case_id int, expected_terms array<string>")
    docs, every = t(s, d, "documents").select("doc_id", "text", "n_chars"), F.explode(F.array(*(F.lit(i) for i, _ in CASES))).alias("case_id")
    hits = lambda *order: retrieval.top(docs, 3, *order).select(every, "rank", "text", F.lit("").alias("chunk_id"))
    return retrieval.verdicts(cases, hits(F.col("n_chars"), F.col("doc_id")), hits(F.desc("n_chars"), F.col("doc_id"))).select("case_id", "verdict")


@query("""WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN source = 'src3' THEN 0 ELSE 1 END, doc_id) AS place, trim(text, E' \\n\\t') AS x FROM documents),
e AS (SELECT place, 'Tài liệu [' || place || '] - Không rõ tiêu đề' || chr(10) || x || chr(10) || 'Nguồn: Không rõ URL' || chr(10) AS entry FROM o)
SELECT place, entry FROM e QUALIFY sum(length(entry)) OVER (ORDER BY place) <= 12000""")
def context_budget(s, d):
    docs = t(s, d, "documents").select(F.col("doc_id").alias("pos"), "text", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("source_url"), F.when(F.col("source") == "src3", "attachment").otherwise("body").alias("chunk_type"))
    return prompt.context(docs, "mẫu đơn")


OLD = "SELECT doc_id::VARCHAR AS id, md5(text) AS content_hash, 'old' AS v, CASE WHEN doc_id % 2 = 0 THEN doc_id END AS embedded_at FROM documents WHERE doc_id % 7 <> 0"
NEW = "SELECT doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 5 = 0 THEN 'changed' ELSE md5(text) END AS content_hash, 'new' AS v FROM documents WHERE doc_id % 4 <> 0"


@query(f"""WITH o AS ({OLD}), n AS ({NEW}) SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN o.content_hash ELSE n.content_hash END AS content_hash, coalesce(n.v, o.v) AS v,
CASE WHEN n.id IS NULL OR n.content_hash IS NOT DISTINCT FROM o.content_hash THEN o.embedded_at END AS embedded_at FROM o FULL JOIN n ON o.id = n.id""")
def upsert_change_detect(s, d):
    docs = t(s, d, "documents")
    old = docs.filter("doc_id % 7 <> 0").select(F.col("doc_id").cast("string").alias("id"), F.md5("text").alias("content_hash"), F.lit("old").alias("v"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")).alias("embedded_at"), F.lit(0).alias("created_at"))
    h = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 5 == 0, "changed").otherwise(F.md5("text"))
    new = docs.filter("doc_id % 4 <> 0").select(F.col("doc_id").cast("string").alias("id"), h.alias("content_hash"), F.lit("new").alias("v"))
    return store.upsert_chunks(old, new, F.lit(1)).drop("created_at")


@query("""SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'last' WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 5 <> 0 THEN source ELSE 'none' END || '+' || lang ELSE source END AS v
FROM documents WHERE (doc_id % 5 <> 0 OR doc_id % 3 = 0 OR doc_id % 11 = 0) AND (doc_id % 7 <> 0 OR doc_id % 11 = 0)""")
def keyed_merge(s, d):
    """A written table after an upsert, a merge that reads the old rows, a delete, a compaction and another upsert."""
    docs = t(s, d, "documents")
    table = KeyedTable.create(s, scratch(s, "keyed"), "doc_id long, v string", ["doc_id"], buckets=8)
    table.upsert(docs.filter("doc_id % 5 <> 0").select("doc_id", F.col("source").alias("v")))
    table.merge(docs.filter("doc_id % 3 = 0").select("doc_id", F.col("lang").alias("v")), {"v": F.concat(F.coalesce("old.v", F.lit("none")), F.lit("+"), "new.v")})
    table.delete(docs.filter("doc_id % 7 = 0"))
    table.compact(deltas=1)
    table.upsert(docs.filter("doc_id % 11 = 0").select("doc_id", F.lit("last").alias("v")))
    return table.read()


@query(_ranked(f"""SELECT vec_id, {COS} AS score FROM (SELECT vec_id, CASE WHEN vec_id % 9 = 4 THEN (label + 1) % 10 ELSE label END AS label, CASE WHEN vec_id % 9 = 4 THEN list_reverse(embedding) ELSE embedding END AS embedding
FROM embeddings WHERE vec_id % 8 <> 3 OR vec_id % 9 = 4) WHERE label = 3""", "score DESC, vec_id", 10))
def vector_index_filtered(s, d):
    """A written collection, of whose vectors some went and some changed, searched under a filter."""
    rows = t(s, d, "embeddings")
    index = VectorIndex.create(s, scratch(s, "vectors"), "long", "label int", ["label"]).build(rows, "vec_id")
    index.delete(rows.filter("vec_id % 8 = 3"), "vec_id")
    index.upsert(rows.filter("vec_id % 9 = 4").withColumns({"label": (F.col("label") + 1) % 10, "embedding": F.reverse("embedding")}), "vec_id")
    found = index.search(PROBE, 10, label=3).withColumnRenamed("id", "vec_id")
    return found.withColumn("score", F.round("score", 6))


INDEXED = r"""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'The that AND ' || text ELSE text END AS text FROM documents WHERE doc_id % 17 <> 0),
w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM x)"""


def text_index(s, d) -> TextIndex:
    """A keyword index of the documents, of which some changed and some went."""
    docs = t(s, d, "documents").select("doc_id", "text")
    index = TextIndex.create(s, scratch(s, "index"), "long", buckets=16)
    index.build(docs, "doc_id")
    index.upsert(docs.filter("doc_id % 13 = 0").withColumn("text", F.concat(F.lit("The that AND "), "text")), "doc_id")
    index.delete(docs.filter("doc_id % 17 = 0"), "doc_id")
    return index


@query(INDEXED + _ranked("""SELECT doc_id, round(len(list_filter(w, lambda x: x IN ('the', 'and', 'that'))) / (1 + ln(len(w))), 9) AS score FROM w
WHERE list_has_all(w, ['the', 'and', 'that'])""", "score DESC, doc_id", 50))
def inverted_index_and(s, d):
    return text_index(s, d).search(ASK, 50, "log").withColumn("score", F.round("score", 9)).withColumnRenamed("id", "doc_id")


@query(INDEXED + _ranked("""SELECT doc_id, len(list_filter(w, lambda x: x IN ('of', 'the')))::DOUBLE AS score FROM w
WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) > 0""", "score DESC, doc_id", 50))
def inverted_index_phrase(s, d):
    return text_index(s, d).search("of the", 50, phrase=True).withColumnRenamed("id", "doc_id")


@query("""WITH x AS (SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'Information and ' || text ELSE text END AS text FROM documents WHERE doc_id % 17 <> 0)
SELECT doc_id, md5(text) AS found FROM x WHERE contains(lower(text), 'ation and') AND text LIKE '%the%'""")
def trigram_contains(s, d):
    """A written trigram index of the documents, of which some changed and some went; its matches meet a second condition."""
    docs = t(s, d, "documents").select("doc_id", "text")
    index = TrigramIndex.create(s, scratch(s, "trigrams"), "long", buckets=32)
    index.build(docs, "doc_id")
    index.upsert(docs.filter("doc_id % 13 = 0").withColumn("text", F.concat(F.lit("Information and "), "text")), "doc_id")
    index.delete(docs.filter("doc_id % 17 = 0"), "doc_id")
    return index.contains("ATION and", ignore_case=True).filter("text like '%the%'").select(F.col("id").alias("doc_id"), F.md5("text").alias("found"))


@query("""WITH x AS (SELECT event_id, (props->>'k')::BIGINT AS k, event_id % 11 = 4 AS broken, event_id % 10 = 3 AS lost FROM events)
SELECT event_id, CASE WHEN NOT lost AND k >= 10 THEN k END AS k, CASE WHEN lost THEN 'read' WHEN k < 10 THEN 'range' END AS stage, CASE WHEN lost THEN 'KeyError: ''k''' WHEN k < 10 THEN 'large' END AS error,
CASE WHEN lost THEN 2 WHEN k < 10 AND broken THEN 1 WHEN k < 10 THEN 2 END::INT AS tries FROM x""")
def quarantine_runs(s, d):
    """Two stages over all events, some of them broken, and a second run after a repair of what the first stage met: what came through, and what is still aside."""
    events, key = t(s, d, "events"), "event_id"
    broken, lost = F.col(key) % 11 == 4, F.col(key) % 10 == 3
    rows = events.select(key, F.when(lost, "{}").when(broken, F.concat("props", F.lit("//"))).otherwise(F.col("props")).alias("props"))

    def stages(repaired: bool) -> list[Stage]:
        read = attempt(lambda x: json.loads(x.removesuffix("//") if repaired else x)["k"], T.LongType())
        first = lambda r: r.withColumn("p", read(F.col("props"))).select(key, F.col("p.value").alias("k"), F.col("p.error").alias("error"))
        return [Stage("read", first), Stage("range", lambda r: r.withColumn("error", checks(large=F.col("k") >= 10)))]

    held = Quarantine.create(s, scratch(s, "quarantine"), "long")
    table = KeyedTable.create(s, scratch(s, "read"), "event_id long, k long", [key], buckets=8)
    held.run(stages(False), rows, key, table.upsert)
    held.run(stages(True), rows.limit(0), key, table.upsert)
    aside = held.open().select(F.col("id").alias(key), F.lit(None).cast("long").alias("k"), "stage", "error", "tries")
    return table.read().unionByName(aside, allowMissingColumns=True)


GRAMS = "list_distinct(list_transform(range(1, length({0}) - 1), lambda i: replace(lower({0}), 'ς', 'σ')[i:i + 2]))"
SAYING = "What is the best and the most recent information on this?"


@query(_ranked(f"""SELECT id, round(c / (n + m - c), 9) AS score FROM (SELECT id, len(list_intersect(g, q))::DOUBLE AS c, len(g) AS n, len(q) AS m
FROM (SELECT (conv_id * 1000 + turn)::VARCHAR AS id, {GRAMS.format('text')} AS g, {GRAMS.format(f"'{SAYING}'")} AS q FROM conversations)) WHERE c / (n + m - c) >= 0.1""", "score DESC, id", 25))
def trigram_similar(s, d):
    said = t(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id"), "text")
    index = TrigramIndex.create(s, scratch(s, "trigrams"), buckets=16)
    index.build(said)
    return index.similar(SAYING, 0.1, 25).withColumn("score", F.round("score", 9))


@query("""SELECT event_id, event_type, (props->>'k')::INT AS k FROM events
WHERE event_type = 'click' AND ((props->>'k')::INT BETWEEN 10 AND 40) AND (CASE WHEN event_id % 3 = 0 THEN NULL ELSE user_id % 5 END) IS NOT DISTINCT FROM 2 AND event_id % 7 IN (1, 2)""")
def json_containment(s, d):
    """Nested JSON made of the events, by what it contains: an object in an object, members of an array, and a range besides."""
    third = F.when(F.col("event_id") % 3 != 0, F.col("user_id") % 5)
    made = F.concat(F.lit('{"kind": {"name": "'), "event_type", F.lit('", "third": '), F.coalesce(third.cast("string"), F.lit("null")), F.lit(', "props": '), "props", F.lit('}, "week": ['), (F.col("event_id") % 7).cast("string"), F.lit(', {"of": 7}, "x"]}'))
    index = JsonIndex.create(s, scratch(s, "json"), "long", buckets=32)
    index.build(t(s, d, "events").select("event_id", made.alias("text")), "event_id")
    between = lambda v: F.variant_get(v, "$.kind.props.k", "int").between(10, 40)
    both = [index.contains({"kind": {"third": 2, "name": "click"}, "week": [{"of": 7}, day]}, between) for day in (1, 2)]
    found = both[0].unionByName(both[1]).withColumn("v", F.parse_json("text"))
    return found.select(F.col("id").alias("event_id"), F.variant_get("v", "$.kind.name", "string").alias("event_type"), F.variant_get("v", "$.kind.props.k", "int").alias("k"))


@query("SELECT d.doc_id AS id, d.lang AS parent_id FROM documents d WHERE d.lang IN (SELECT lang FROM documents d2 JOIN labels l USING (doc_id) WHERE l.toxic = 1) AND d.doc_id NOT IN (SELECT doc_id FROM labels)")
def stale_anti_delete(s, d):
    docs, labels = t(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("parent_id")), t(s, d, "labels")
    toxic = labels.filter("toxic = 1").select(F.col("doc_id").alias("id"))
    return store.stale(docs, labels.select(F.col("doc_id").alias("id")), docs.join(toxic, "id", "left_semi")).select("id", "parent_id")


@query("SELECT c.doc_id, c.lang FROM documents c WHERE c.doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def cascade_delete(s, d):
    return store.cascade(t(s, d, "documents").select("doc_id", "lang"), t(s, d, "labels").filter("quality = 1"), "doc_id", "doc_id")


@query("SELECT user_id AS id, event_type AS status, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) = 1")
def run_log_latest(s, d):
    return store.latest_runs(t(s, d, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("status"), "value", F.col("ts").alias("logged_at"))).drop("logged_at")


@query("SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang = 'en' ORDER BY n_chars, id LIMIT 20")
def pending_batch(s, d):
    docs = t(s, d, "documents").join(t(s, d, "labels"), "doc_id", "left").select(F.col("doc_id").alias("id"), "lang", F.col("lang").alias("category_code"), F.col("quality").alias("embedded_at"), F.col("n_chars").alias("created_at"))
    return store.pending(docs, 20, "en").select("id", "lang")


CODES = ("HT", "HC", "HB", "ĐS", "KN", "HD", "ZZ")
CODE_SQL = "CASE doc_id % 7 " + " ".join(f"WHEN {i} THEN '{c.replace('Đ', 'D')}'" for i, c in enumerate(CODES)) + " END"
KNOWN_SQL = " UNION ALL ".join(f"SELECT '{c}' AS category_code, {n} AS category_order, '{name}' AS category_name" for c, n, name, _ in ingest.CATEGORIES)


@query(f"WITH i AS (SELECT doc_id, {CODE_SQL} AS category_code FROM documents WHERE doc_id % 3 <> 0), k AS ({KNOWN_SQL}) SELECT doc_id::VARCHAR AS id, category_code, category_order, category_name FROM i JOIN k USING (category_code)")
def category_dim_join(s, d):
    """Published items of known categories, with the category's row."""
    kind = F.concat(F.lit("x@"), F.element_at(F.array(*map(F.lit, CODES)), (F.col("doc_id") % 7 + 1).cast("int")))
    items = t(s, d, "documents").select(F.col("doc_id").cast("string").alias("DocumentID"), kind.alias("TypeDoc"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("Status"), F.lit("2024").alias("TimeCreate"))
    return ingest.listed(items, ingest.categories(s)).select(F.col("DocumentID").alias("id"), "category_code", "category_order", "category_name")


SIGNATURES = [(1, "example.net"), (2, "page=2"), (3, "/en/"), (4, "https://")]
LINK = "array<struct<index:int,anchor_text:string,url:string,raw_href:string,type:string,context:string,meaning:string,content:string,fetch_status:string,local_filename:string>>"


@query("""SELECT page_id, CASE WHEN contains(url, 'example.net') THEN 'file 1' WHEN contains(url, 'page=2') THEN 'file 2' WHEN contains(url, '/en/') THEN 'file 3' WHEN contains(url, 'https://') THEN 'file 4' END AS filename,
CASE WHEN contains(url, 'example.net') OR contains(url, 'page=2') OR contains(url, '/en/') OR contains(url, 'https://') THEN 'ok' ELSE 'skipped' END AS fetch_status FROM pages""")
def url_contains_first_match(s, d):
    """Each page's address as a link that gets the first file whose signature it holds."""
    found = s.createDataFrame([(i, f"file {i}", sign, "content") for i, sign in SIGNATURES], "pos int, filename string, url_signature string, content string")
    link = F.array(F.struct(F.lit(1), F.lit("a"), "url", "url", F.lit("pdf"), F.lit(""), F.lit(""), F.lit(None).cast("string"), F.lit("skipped"), F.lit(None).cast("string"))).cast(LINK)
    made = t(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.lit("t").alias("title"), F.lit("c").alias("category_name"), F.lit("k").alias("type_doc"), F.lit("").alias("time_create"), F.lit("").alias("text"), link.alias("links"))
    return ingest.with_local_files(made, found).select(F.col("doc_id").alias("page_id"), F.col("links")[0]["local_filename"].alias("filename"), F.col("links")[0]["fetch_status"].alias("fetch_status"))


SIGNS = "SELECT page_id AS pos, CASE WHEN page_id % 50 = 7 THEN 'example' ELSE substr(url, 9 + (page_id % 9)::INT, 8 + (page_id % 23)::INT) END AS sign FROM pages"


@query(f"WITH s AS ({SIGNS}), m AS (SELECT p.page_id, min(s.pos) AS pos FROM pages p JOIN s ON contains(p.url || p.html, s.sign) GROUP BY p.page_id) SELECT page_id, pos FROM pages LEFT JOIN m USING (page_id)")
def signature_match(s, d):
    """The first of many signatures, overlapping and nested ones, that each page's address and source hold."""
    p = t(s, d, "pages")
    sign = F.when(F.col("page_id") % 50 == 7, "example").otherwise(F.substring("url", 9 + (F.col("page_id") % 9).cast("int"), 8 + (F.col("page_id") % 23).cast("int")))
    return with_first_match(p, F.concat("url", "html"), p.select(F.col("page_id").alias("place"), sign.alias("pattern")), "pos").select("page_id", "pos")


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN 'Đơn ' || page_id || '.docx' WHEN 1 THEN 'Biểu mẫu ' || page_id WHEN 2 THEN 'hai ba ' || page_id WHEN 3 THEN 'Tài liệu đính kèm' WHEN 4 THEN 'nội dung ' || repeat('x', 71) ELSE 'đơn xin nghỉ ' || page_id END AS name FROM pages""")
def attachment_names(s, d):
    """Local file, anchor, a line of the context behind generic and over-long anchors, or the default."""
    k, n = F.col("page_id") % 6, F.col("page_id").cast("string")
    local = F.when(k == 0, F.concat(F.lit(" Đơn "), n, F.lit(".docx"))).when(k == 1, "http://h.org/a").when(k == 2, "Tại đây")
    anchor = F.when(k == 1, F.concat(F.lit("Biểu mẫu "), n)).when(k == 4, F.repeat(F.lit("rất dài "), F.lit(20))).otherwise("tại đây")
    context = F.when(k == 2, F.concat(F.lit("\n  \n## một **hai** [ba](http://x) "), n)).when(k == 3, "a@b.org\nmail a@b.org\nsố 12345\nxem link").when(k == 4, F.concat(F.lit("cắt nội dung "), F.repeat(F.lit("x"), F.lit(200)))).otherwise(F.concat(F.lit("ghiệp; đơn xin nghỉ "), n))
    return t(s, d, "pages").select("page_id", text.attachment_name(local, anchor, context, ingest.DEFAULT_ATTACHMENT).alias("name"))


@query(r"""SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE concat('Bài viết ', chr(39), lang, chr(39), ' thuộc ', source, '.', CASE doc_id % 3 WHEN 1 THEN chr(10) || 'Gồm các chủ đề: một.' WHEN 2 THEN chr(10) || 'Gồm các chủ đề: a, b, c, d, e.' ELSE '' END,
CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Liên hệ: x@y.org, z@y.org.' ELSE '' END) END AS doc_summary,
CASE WHEN coalesce(text, '') <> '' THEN concat('File đính kèm: ', source, '.', chr(10), 'Bài viết: ', lang, '. Chuyên mục: ', source, '.', CASE doc_id % 3 WHEN 1 THEN chr(10) || 'Liên quan: một.' WHEN 2 THEN chr(10) || 'Liên quan: a, b.' ELSE '' END,
CASE WHEN doc_id % 2 = 0 THEN chr(10) || 'Liên hệ: x@y.org, z@y.org.' ELSE '' END, coalesce(chr(10) || 'Nội dung: ' || nullif(trim(regexp_replace(substr(text, 1, 150), '\s+', ' ', 'g')), '') || '...', '')) END AS att_summary FROM documents""")
def summary_texts(s, d):
    tags = F.when(F.col("doc_id") % 3 == 0, F.array().cast("array<string>")).when(F.col("doc_id") % 3 == 1, F.array(F.lit("một"))).otherwise(F.array(*map(F.lit, ("a", "b", " ", "c", "d", "e", "f"))))
    mails = F.when(F.col("doc_id") % 2 == 0, F.array(*map(F.lit, ("x@y.org", "z@y.org", "w@y.org")))).otherwise(F.array().cast("array<string>"))
    title = F.when(F.col("doc_id") % 4 != 0, F.col("lang"))
    return t(s, d, "documents").select("doc_id", segment.document_summary(title, F.col("source"), tags, mails).alias("doc_summary"), segment.attachment_summary(F.col("source"), F.col("text"), F.col("lang"), F.col("source"), tags, mails).alias("att_summary"))


@query(r"""SELECT count(*) AS n_docs, sum(CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END)::BIGINT AS junk_attachments, count(*) FILTER (n + k > 0) AS docs_with_links, sum(n + k)::BIGINT AS links
FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 2 ELSE 0 END AS k, len(regexp_extract_all(text, '(?m)^-\s*Liên kết trong bài [''"].+?[''"]:.+$')) AS n FROM documents)""")
def source_profile(s, d):
    name = lambda c: F.struct(c.alias("name"))
    att = F.array(name(F.when(F.col("doc_id") % 3 == 0, "tại đây").otherwise("Đơn xin nghỉ")), name(F.when(F.col("doc_id") % 5 == 0, "ABC").otherwise("Form.pdf")))
    lines = F.when(F.col("doc_id") % 2 == 0, "\nLiên kết liên quan:\n- Liên kết trong bài 'a': x\n- Liên kết trong bài 'b': y").otherwise("")
    return quality.source_profile(t(s, d, "documents").select(F.concat("text", lines).alias("text"), att.alias("attachments")))


@query("SELECT count(*) FILTER (role = 'user') AS body_chunks, count(*) FILTER (role = 'assistant') AS attachment_chunks, count(*) FILTER (role = 'system') AS summary_chunks, count(*) FILTER (role = 'assistant' AND turn > 2) AS placed_parts FROM conversations")
def chunk_kinds(s, d):
    kind = F.when(F.col("role") == "user", "body").when(F.col("role") == "assistant", "attachment").otherwise("summary")
    return quality.kinds(t(s, d, "conversations").select(kind.alias("chunk_type"), (F.col("turn") - 3).alias("attachment_chunk_index")))


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal::DECIMAL(12,2)::DOUBLE AS balance, c_nationkey AS nation FROM customer")
def csv_typed_load(s, d):
    """Rows of text, as a file has them, with a table's types."""
    raw = t(s, d, "customer").select(F.col("c_nationkey").cast("string").alias("nation"), F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("c_acctbal").cast("string").alias("balance"))
    kind = s.createDataFrame([], "id long, name string, balance decimal(12,2), nation int").schema
    return files.validated(raw, kind, {"name": 40}).withColumn("balance", F.col("balance").cast("double"))


def _messages(s, d):
    return t(s, d, "conversations").groupBy("conv_id").agg(chat.conversations(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))


@query("SELECT conv_id, string_agg(role || '=' || text, '|' ORDER BY turn) AS messages FROM conversations GROUP BY 1")
def messages_build(s, d):
    return _messages(s, d).select("conv_id", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit("="), m["content"])), "|").alias("messages"))


TURN = "'<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10)"
RENDER = f"""SELECT conv_id, CASE WHEN arg_min(role, turn) = 'system' THEN '' ELSE '<|im_start|>system' || chr(10) || '{chat.DEFAULT_SYSTEM}<|im_end|>' || chr(10) END || string_agg({TURN}, '' ORDER BY turn)"""


@query(f"{RENDER} AS text FROM conversations GROUP BY 1")
def chatml_render(s, d):
    return _messages(s, d).select("conv_id", chat.render(F.col("messages")).alias("text"))


CALL = """CASE WHEN role = 'assistant' AND turn % 3 = 1 THEN '<|im_start|>assistant' || CASE WHEN turn % 2 = 0 THEN chr(10) || text ELSE '' END || chr(10) || '<tool_call>' || chr(10) || '{"name": "look", "arguments": {"turn": ' || turn || '}}' || chr(10) || '</tool_call><|im_end|>' || chr(10)
WHEN role = 'system' AND first THEN '' ELSE '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) END"""
BREAK = "' || chr(10) || '"


@query(f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS first FROM conversations)
SELECT conv_id, '<|im_start|>system' || chr(10) || CASE WHEN arg_min(role, turn) = 'system' THEN arg_min(text, turn) ELSE '{chat.DEFAULT_SYSTEM}' END || '{chat.TOOLS_BEFORE.replace(chr(10), BREAK)}'
|| chr(10) || '{{"name": "look"}}' || '{chat.TOOLS_AFTER.replace(chr(10), BREAK)}' || '<|im_end|>' || chr(10) || string_agg({CALL}, '' ORDER BY turn) AS text FROM t GROUP BY 1""")
def chatml_tools(s, d):
    """One tool, which every third turn calls if it is an answer."""
    call = F.when((F.col("role") == "assistant") & (F.col("turn") % 3 == 1), F.array(F.struct(F.lit("look").alias("name"), F.concat(F.lit('{"turn": '), "turn", F.lit("}")).alias("arguments"))))
    content = F.when(call.isNull() | (F.col("turn") % 2 == 0), F.col("text"))
    rows = t(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", content.alias("content"), call.alias("tool_calls")))).alias("x"))
    messages = F.transform("x", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content"), m["tool_calls"].alias("tool_calls")))
    return rows.select("conv_id", chat.render(messages, tools=F.array(F.lit('{"name": "look"}')), calls=True).alias("text"))


@query(f"{RENDER} || '<|im_start|>assistant' || chr(10) AS text FROM conversations WHERE role <> 'assistant' GROUP BY 1")
def prompt_only(s, d):
    asked = t(s, d, "conversations").filter("role <> 'assistant'").groupBy("conv_id").agg(chat.conversations(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("messages"))
    return asked.select("conv_id", chat.render(F.col("messages"), prompt=True).alias("text"))


@query("SELECT doc_id, CASE WHEN ('0x' || substr(md5('42-' || doc_id), 1, 8))::BIGINT % 1000 < 100 THEN 'test' ELSE 'train' END AS part FROM documents")
def hash_split_90_10(s, d):
    return training.split(t(s, d, "documents"), "doc_id").select("doc_id", "part")


@query("SELECT doc_id, lang FROM documents ORDER BY md5('42-' || doc_id), doc_id LIMIT 200")
def shuffled_head(s, d):
    return training.shuffled_head(t(s, d, "documents").select("doc_id", "lang"), "doc_id", 200)


COMPLETIONS = [
    (-1, "```python\nx = 1\nprint(x)\n```"), (-2, "hello there"), (-3, "text\n```\na\nb\nc\n```"), (-4, "```python\ndef f():\n    pass\n# TODO\n    return 1\n```"), (-5, "```python\nopen"),
    (-9, "```python x = 1```"), (-10, "see ```js\nlet y\n``` and ```python\nz\n```"), (-11, "``````"), (-12, "a ``` b"),
    (-6, "```python\n" + "\n".join(f"x{i} = {i}" for i in range(60)) + "\n```"), (-7, "```python\nraise NotImplementedError\n```"), (-8, "```python\n" + "\n".join(f"x{i} = {i}" for i in range(120)) + "\n```"),
]
LITERAL = " UNION ALL ".join("SELECT {}, '{}'".format(i, c.replace("\n", "' || chr(10) || '")) for i, c in COMPLETIONS)
COMPLETION_SQL = f"SELECT conv_id * 1000 + turn AS id, text AS c FROM conversations WHERE role = 'assistant' UNION ALL {LITERAL}"
#: What stands between the first two fences, by splitting at them.
BLOCK = r"trim(CASE WHEN len(string_split(c, '```')) < 3 THEN c ELSE regexp_replace(string_split(c, '```')[2], '^(python)?\n?', '') END, E' \n\t')"


def completions(s, d):
    return t(s, d, "conversations").filter("role = 'assistant'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("text").alias("completion")).union(s.createDataFrame(COMPLETIONS, "id long, completion string"))


REWARD_FORMAT = "CASE WHEN regexp_matches(c, '(?s)```python.*```') THEN 1.0 WHEN contains(c, '```') THEN 0.5 ELSE 0.0 END::DOUBLE"
REWARD_PLACEHOLDER = rf"CASE WHEN regexp_matches({BLOCK}, '\bpass\b|#\s*TODO|#\s*FIXME|raise\s+NotImplementedError|[.][.][.]') THEN 0.0 ELSE 1.0 END::DOUBLE"
FILLED = rf"len(list_filter(string_split({BLOCK}, chr(10)), lambda x: regexp_matches(x, '\S')))"
REWARD_LENGTH = f"CASE WHEN {FILLED} < 3 THEN 0.2 WHEN {FILLED} <= 50 THEN 1.0 WHEN {FILLED} <= 100 THEN 0.7 ELSE 0.3 END::DOUBLE"


@query(f"SELECT id, {BLOCK} AS code FROM ({COMPLETION_SQL}) x(id, c)")
def code_blocks(s, d):
    return completions(s, d).select("id", text.code_block(F.col("completion")).alias("code"))


@query(f"SELECT id, {REWARD_FORMAT} AS r_format FROM ({COMPLETION_SQL}) x(id, c)")
def reward_format(s, d):
    return completions(s, d).select("id", scores.reward_format(F.col("completion")).alias("r_format"))


@query(f"SELECT id, {REWARD_PLACEHOLDER} AS r_no_placeholder FROM ({COMPLETION_SQL}) x(id, c)")
def reward_placeholder(s, d):
    return completions(s, d).select("id", scores.reward_no_placeholder(F.col("completion")).alias("r_no_placeholder"))


@query(f"SELECT id, {REWARD_LENGTH} AS r_length FROM ({COMPLETION_SQL}) x(id, c)")
def reward_length(s, d):
    return completions(s, d).select("id", scores.reward_length(F.col("completion")).alias("r_length"))


@query()
def reward_syntax(s, d):
    """Python's own parser decides; tests hold it against literals."""
    return completions(s, d).select("id", scores.reward_syntax(F.col("completion")).alias("r_syntax"))


@query(f"SELECT id, round(0.20::DOUBLE * {REWARD_PLACEHOLDER} + 0.10::DOUBLE * {REWARD_FORMAT} + 0.05::DOUBLE * {REWARD_LENGTH}, 4) AS reward FROM ({COMPLETION_SQL}) x(id, c)")
def reward_combined_static(s, d):
    return training.with_rewards(completions(s, d), syntax=False).select("id", "reward")


@query(f"SELECT round(avg(r), 4) AS avg_reward, min(r) AS min_reward, max(r) AS max_reward FROM (SELECT round(0.20::DOUBLE * {REWARD_PLACEHOLDER} + 0.10::DOUBLE * {REWARD_FORMAT} + 0.05::DOUBLE * {REWARD_LENGTH}, 4) AS r FROM ({COMPLETION_SQL}) x(id, c))")
def reward_summary(s, d):
    return training.reward_summary(training.with_rewards(completions(s, d), syntax=False))


@query("SELECT event_id, round((value - avg(value) OVER w) / (coalesce(stddev_samp(value) OVER w, 0) + 1e-4), 6) AS advantage FROM events WINDOW w AS (PARTITION BY user_id)")
def group_advantage(s, d):
    return training.group_advantage(t(s, d, "events"), "user_id", "value").select("event_id", F.round("advantage", 6).alias("advantage"))


DAILY = "SELECT event_type, (row_number() OVER (PARTITION BY event_type ORDER BY day))::BIGINT AS step, v FROM (SELECT event_type, ts::DATE AS day, round(avg(value), 6) AS v FROM events GROUP BY 1, 2)"


@query(f"""WITH RECURSIVE m AS ({DAILY}), f AS (
SELECT event_type, step, v AS best, step AS best_step, 0 AS wait, NULL::BIGINT AS stopped_step FROM m WHERE step = 1
UNION ALL SELECT m.event_type, m.step, CASE WHEN f.stopped_step IS NOT NULL THEN f.best WHEN m.v > f.best + 0.005 THEN m.v ELSE f.best END, CASE WHEN f.stopped_step IS NOT NULL THEN f.best_step WHEN m.v > f.best + 0.005 THEN m.step ELSE f.best_step END,
CASE WHEN f.stopped_step IS NOT NULL THEN f.wait WHEN m.v > f.best + 0.005 THEN 0 ELSE f.wait + 1 END, CASE WHEN f.stopped_step IS NOT NULL THEN f.stopped_step WHEN NOT m.v > f.best + 0.005 AND f.wait + 1 >= 3 THEN m.step END
FROM f JOIN m ON m.event_type = f.event_type AND m.step = f.step + 1)
SELECT event_type, best, best_step, wait, stopped_step FROM f QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY step DESC) = 1""")
def early_stop_fold(s, d):
    daily = t(s, d, "events").groupBy("event_type", F.col("ts").cast("date").alias("day")).agg(F.round(F.avg("value"), 6).alias("v"))
    return training.early_stop(daily.withColumn("step", F.row_number().over(Window.partitionBy("event_type").orderBy("day"))), "step", "v", group=["event_type"])


@query("""WITH g AS (SELECT user_id, count(*) AS n, (count(*) FILTER (value > 50))::BIGINT AS c FROM events GROUP BY 1 HAVING count(*) >= 5)
SELECT user_id, n, c, round(CASE WHEN n - c < 5 THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - 5.0::DOUBLE / i)) END::DOUBLE, 6) AS pass_at_5 FROM g""")
def pass_at_k(s, d):
    made = training.mean_pass_at_k(t(s, d, "events").withColumn("passed", F.col("value") > 50), 5, "user_id")
    return made.select("user_id", "n", "c", F.round("pass_at_k", 6).alias("pass_at_5"))


@query("""WITH m AS (SELECT event_type, CASE WHEN event_type IN ('click', 'view') THEN 'rewards/' WHEN event_type = 'purchase' THEN 'completions/' ELSE 'other/' END || event_type AS k, round(avg(value), 6) AS v FROM events GROUP BY 1)
SELECT CASE WHEN starts_with(k, 'rewards/') THEN 'rewards' WHEN starts_with(k, 'completions/') THEN 'completions' ELSE 'other' END AS part, k AS metric, v AS value FROM m""")
def metric_prefix_breakdown(s, d):
    k = F.concat(F.when(F.col("event_type").isin("click", "view"), "rewards/").when(F.col("event_type") == "purchase", "completions/").otherwise("other/"), "event_type")
    m = t(s, d, "events").groupBy(k.alias("k")).agg(F.round(F.avg("value"), 6).alias("v")).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metrics")).withColumn("step", F.lit(1))
    g = training.metric_groups(m)
    parts = F.map_from_arrays(F.array(*(F.lit(x) for x in ("rewards", "completions", "other"))), F.array("rewards", "completions", "other"))
    return g.select(F.explode(parts).alias("part", "m")).select("part", F.explode("m").alias("metric", "value"))


@query("SELECT round(sum(CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END) / nullif(count(*), 0), 6)::DOUBLE AS accuracy FROM lineitem WHERE l_linenumber <> 1")
def token_accuracy(s, d):
    rows = t(s, d, "lineitem").filter("l_linenumber <> 1")
    return rows.agg(F.round(scores.token_accuracy(F.col("l_returnflag") == "N", F.lit(1)), 6).alias("accuracy"))


#: Statements about a name, and whether they only read.
STATEMENTS = {
    "DROP TABLE {}": False, "SELECT 1 AS {}": True, "SELECT updated_at FROM {}": True, "WITH {0} AS (SELECT 1) SELECT * FROM {0}": True, "delete from {}": False, "SELECT 1; DROP TABLE {}": False,
    "```sql\nSELECT {};\n```": True, "INSERT INTO {} VALUES (1)": False, "CREATE TABLE {} (a int)": False, "GRANT ALL ON {} TO u": False,
}


@query(" UNION ALL ".join("SELECT replace('{}', '?', event_type) AS statement, {} AS allowed, n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 LIMIT 50)".format(x.replace("{0}", "?").replace("{}", "?").replace("\n", "' || chr(10) || '"), ok) for x, ok in STATEMENTS.items()))
def sql_guard(s, d):
    """Statements about the kinds of events (the first 50: the guard parses on the driver), and how many of each there are."""
    kinds = t(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n")).orderBy("event_type").limit(50).collect()
    return s.createDataFrame([(x.format(k.event_type), sqlfront.is_query(s, x.format(k.event_type)), k.n) for x in STATEMENTS for k in kinds], "statement string, allowed boolean, n long")


@query("SELECT user_id, count(*) AS n, round(sum(value), 4) AS v, ts::DATE AS day FROM events GROUP BY user_id, ts::DATE HAVING count(*) > 1")
def events_daily(s, d):
    return t(s, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v")).filter("n > 1")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS INT) BETWEEN 10 AND 20")
def json_int_between(s, d):
    k = F.get_json_object("props", "$.k").cast("int")
    return t(s, d, "events").select("event_id", k.alias("k")).filter(F.col("k").between(10, 20))


#: The shapes that the SQL front door has to answer, in SQL that both engines read.
FRONT_DOOR = {
    "sql_monthly_revenue": "SELECT date_trunc('month', o_orderdate) AS month, round(sum(o_totalprice), 2) AS revenue FROM orders GROUP BY date_trunc('month', o_orderdate)",
    "sql_customer_order_counts": "SELECT c_custkey, c_name, count(o_orderkey) AS n_orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_name",
    "sql_above_average": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)",
    "sql_rank_by_region": "SELECT r_name, c_custkey, revenue, rank() OVER (PARTITION BY r_name ORDER BY revenue DESC, c_custkey) AS place FROM (SELECT r_name, c_custkey, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, c_custkey) x",
    "sql_last_30_days": "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL '30' DAY",
    "sql_null_handling": "SELECT p_partkey, p_name, coalesce(q, 0) AS quantity FROM part LEFT JOIN (SELECT l_partkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_partkey) x ON p_partkey = l_partkey",
    "sql_category_region": "SELECT r_name, p_type, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey GROUP BY r_name, p_type",
    "sql_top5_customers": "SELECT c_custkey, c_name, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_custkey, c_name ORDER BY revenue DESC, c_custkey LIMIT 5",
    "sql_orders_last_month": "SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE date_trunc('month', o_orderdate) = (SELECT date_trunc('month', max(o_orderdate)) FROM orders)",
    "sql_anti_join": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    "sql_pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS qty, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charge, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
}


def _front_door(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        for name in set(TABLES) & set(sql.replace("(", " ").split()):
            t(s, d, name).createOrReplaceTempView(name)
        if not sqlfront.is_query(s, sql):
            raise ValueError("refused")
        return s.sql(sql)

    return run


for _name, _sql in FRONT_DOOR.items():
    Q[_name], SQL[_name] = _front_door(_sql), _sql


@query("SELECT region, n FROM (SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)")
def schema_guarded_query(s, d):
    """A question through the whole front door, with a generator that fails once."""
    for name in ("customer", "nation", "region"):
        t(s, d, name).createOrReplaceTempView(name)
    drafts = ["DROP TABLE region", "SELECT nothing FROM region", "```sql\nSELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name;\n```"]
    door = sqlfront.FrontDoor(s, lambda q, schema, error: drafts.pop(0))
    return s.createDataFrame(door.ask("customers by region")["rows"], "region string, n long")


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Pages' text, chunked and searched, fused with a vector search: documents and vectors share ids here."""
    v, x = _lists(spark, sf)
    return retrieval.hybrid(v, x, t(spark, sf, "documents").select("doc_id", "lang", "source"), 5, id_col="doc_id").orderBy("rank")
