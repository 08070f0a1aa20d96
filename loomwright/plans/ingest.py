"""From listed items to articles, RAG documents, attachments and chunks, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.functions import ids
from loomwright.functions.patterns import with_first_match
from loomwright.functions.text import attachment_name, bracket_tags, clean_text, emails, generic_anchor, link_listing, relabel_links, url_slug
from loomwright.operators import segment, store
from loomwright.operators.html import text_and_links
from loomwright.sources.files import fetch_status

#: Category codes with their order and name. An item's type ends with @ and the code.
CATEGORIES = [
    ("HT", 1, "Học tập", "Đăng ký học, kết quả, học lại, xét tốt nghiệp và các vấn đề học vụ."),
    ("HC", 2, "Thủ tục hành chính", "Giấy tờ, xác nhận, đơn từ và các thủ tục hành chính cho sinh viên."),
    ("HB", 3, "Học bổng & Hỗ trợ tài chính", "Học bổng khuyến khích, hỗ trợ tài chính và miễn giảm học phí."),
    ("DS", 4, "Đời sống & Hỗ trợ sinh viên", "BHYT, ký túc xá, vé xe buýt và các hỗ trợ đời sống sinh viên."),
    ("KN", 5, "Kỹ năng và hoạt động sinh viên", "Tài khoản, ứng dụng số của trường và kỹ năng cần thiết."),
    ("HD", 6, "Tốt nghiệp và việc làm", "Hoạt động ngoại khóa, rèn luyện và thủ tục tốt nghiệp."),
]
#: Fixed value: the name of an attachment that has none.
DEFAULT_ATTACHMENT = "Tài liệu đính kèm"


@dataclass
class Settings:
    page_base: str = "https://example.org/pages"
    prefix: str = "doc_"
    doc_type: str = "article"
    source: str = "pages"


def category_code(kind: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(kind, "@"), -1), "^Đ", "D")


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CATEGORIES, "category_code string, category_order int, category_name string, category_desc string")


def listed(items: DataFrame, known: DataFrame) -> DataFrame:
    """Items that are published and of a known type, the newest text of time first."""
    made = items.filter(F.col("Status") == 1).withColumn("category_code", category_code(F.col("TypeDoc")))
    return made.join(known, "category_code").orderBy(F.desc(F.coalesce("TimeCreate", F.lit(""))), "DocumentID")


def _either(a: str, b: str) -> Column:
    return F.coalesce(F.nullif(F.col(a), F.lit("")), F.col(b))


def articles(items: DataFrame, details: DataFrame | None = None, settings: Settings | None = None) -> DataFrame:
    """Articles from listed() items; details(DocumentID, Title, Description, TimeCreate) win over them where they aren't empty."""
    settings = settings or Settings()
    d = items
    if details is not None:
        more = details.select("DocumentID", *(F.col(c).alias(f"d_{c}") for c in ("Title", "Description", "TimeCreate")))
        d = items.join(more, "DocumentID", "left").withColumns({c: _either(f"d_{c}", c) for c in ("Title", "Description", "TimeCreate")})
    d = d.withColumn("title", clean_text(F.col("Title"))).withColumn("source_url", F.concat_ws("/", F.lit(settings.page_base), "DocumentID", url_slug(F.col("title"))))
    d = d.withColumn("p", text_and_links(F.coalesce("Description", F.lit("")), F.col("source_url"), F.col("title")))
    links = F.transform("p.links", lambda x: F.struct(x["index"].alias("index"), x["anchor_text"].alias("anchor_text"), x["url"].alias("url"), x["raw_href"].alias("raw_href"), x["type"].alias("type"), x["context"].alias("context"), x["meaning"].alias("meaning"), F.lit(None).cast("string").alias("content"), fetch_status(x["type"]).alias("fetch_status"), F.lit(None).cast("string").alias("local_filename")))
    made = d.select(
        F.col("DocumentID").cast("string").alias("doc_id"), "title", F.col("TypeDoc").alias("type_doc"), "category_code", "category_name", "category_desc", "category_order", "source_url", F.col("TimeCreate").alias("time_create"),
        F.col("Status").alias("status"), F.col("CreaterID").alias("creator_id"), F.col("Description").alias("html"), F.col("p.text").alias("text"), links.alias("links"),
    )
    made = made.withColumn("keywords", F.struct(emails(F.col("text")).alias("emails"), bracket_tags(F.col("text")).alias("tags")))
    return with_rag_text(made)


def with_rag_text(made: DataFrame) -> DataFrame:
    """rag_text: labelled lines, the text and the links; empty parts are skipped. The labels are fixed values."""
    full = lambda c: F.nullif(c, F.lit(""))
    head = [F.concat(F.lit("Tiêu đề: "), "title"), F.concat(F.lit("Nhóm: "), "category_name"), F.concat(F.lit("Loại tài liệu: "), "type_doc"), F.concat(F.lit("Cập nhật: "), F.coalesce("time_create", F.lit("")))]
    return made.withColumn("rag_text", clean_text(F.concat_ws("\n", *head, full(F.col("text")), full(link_listing(F.col("links"))))))


def with_local_files(made: DataFrame, files: DataFrame) -> DataFrame:
    """Links whose URL contains a signature of files(pos, filename, url_signature, content) get that file, the first by pos, which is unique; generic labels in the text take its name."""
    signs = files.select(F.col("pos").alias("place"), F.col("url_signature").alias("pattern"))
    first = with_first_match(made.select("doc_id", F.explode("links").alias("x")), F.col("x.url"), signs, "pos")
    first = first.join(files.select("pos", "filename", F.col("content").alias("found")), "pos", "left")
    new = first.select("doc_id", F.when(F.col("filename").isNotNull(), F.col("x").withField("content", F.col("found")).withField("local_filename", F.col("filename")).withField("fetch_status", F.when(F.coalesce("found", F.lit("")) != "", "ok").otherwise("empty"))).otherwise(F.col("x")).alias("x"))
    links = new.groupBy("doc_id").agg(F.array_sort(F.collect_list("x"), lambda a, b: a["index"] - b["index"]).alias("new_links"))
    joined = made.join(links, "doc_id", "left").withColumn("links", F.coalesce("new_links", "links")).drop("new_links")
    label = lambda x: F.coalesce(x["local_filename"], F.lit(DEFAULT_ATTACHMENT))
    text = F.aggregate("links", F.col("text"), lambda t, x: F.when(x["local_filename"].isNotNull() & generic_anchor(x["anchor_text"]), relabel_links(t, x["anchor_text"], x["url"], label(x))).otherwise(t))
    return with_rag_text(joined.withColumn("text", text))


def with_attachments(made: DataFrame) -> DataFrame:
    """Fetched links as attachments, with the name that attachment_name() finds; ids and hashes by SHA-256."""
    ok = F.filter("links", lambda x: (x["fetch_status"] == "ok") & (F.coalesce(x["content"], F.lit("")) != ""))
    name = lambda x: attachment_name(x["local_filename"], x["anchor_text"], x["context"], DEFAULT_ATTACHMENT)
    one = lambda x: F.struct(ids.short_hash(x["url"]).alias("attachment_id"), name(x).alias("name"), x["url"].alias("url"), x["local_filename"].alias("local_filename"), x["index"].alias("link_index"), x["fetch_status"].alias("fetch_status"), x["content"].alias("content"), ids.content_hash(x["content"]).alias("content_hash"))
    return made.withColumn("attachments", F.transform(ok, one))


def rag_documents(made: DataFrame, settings: Settings | None = None) -> DataFrame:
    settings = settings or Settings()
    meta = F.struct(F.lit(settings.source).alias("source"), "source_url", "doc_id", "type_doc", "category_code", "category_name", "time_create", F.col("keywords.emails").alias("emails"), F.col("keywords.tags").alias("tags"))
    return made.select(ids.add_prefix(settings.prefix, F.col("doc_id")).alias("id"), F.lit(settings.doc_type).alias("doc_type"), "title", F.col("rag_text").alias("text"), "attachments", meta.alias("metadata"))


def chunks(made: DataFrame, settings: Settings | None = None) -> DataFrame:
    return segment.chunks(made.withColumn("text", F.col("rag_text")), (settings or Settings()).prefix)


def ingest(old_articles: DataFrame, old_chunks: DataFrame, made: DataFrame, settings: Settings | None = None) -> tuple[DataFrame, DataFrame]:
    """(articles, chunks) after an upsert of made and its chunks; chunks of these articles that are gone upstream are deleted. All from one snapshot: publish both together."""
    new = chunks(made, settings).withColumns({"embedded_at": F.lit(None).cast("timestamp"), "created_at": F.current_timestamp()}).select(old_chunks.columns)
    parents = made.select(ids.add_prefix((settings or Settings()).prefix, F.col("doc_id")).alias("parent_id"))
    return store.upsert(old_articles, made.select(old_articles.columns), "doc_id"), store.upsert_chunks(store.without_stale(old_chunks, new, parents).select(old_chunks.columns), new)
