"""Declared schemas; nothing is inferred."""

LINK = "struct<index:int,anchor_text:string,url:string,raw_href:string,type:string,context:string,meaning:string,content:string,fetch_status:string,local_filename:string>"
ATTACHMENT = "struct<attachment_id:string,name:string,url:string,local_filename:string,link_index:int,fetch_status:string,content:string,content_hash:string>"
KEYWORDS = "struct<emails:array<string>,tags:array<string>>"
RAW_ITEM = "DocumentID string, Title string, TypeDoc string, Status int, TimeCreate string, Description string, CreaterID string"
LISTING = "RespCode int, RespText string, WebTitleLst array<struct<DocumentID:string,Title:string,TypeDoc:string,Status:int,TimeCreate:string,Description:string,CreaterID:string>>"
ARTICLE = (
    "doc_id string, title string, type_doc string, category_code string, category_name string, category_desc string, category_order int, source_url string, time_create string, status int, "
    f"creator_id string, html string, text string, rag_text string, links array<{LINK}>, attachments array<{ATTACHMENT}>, keywords {KEYWORDS}"
)
CHUNK = (
    "id string, parent_id string, doc_id string, chunk_index int, chunk_type string, is_attachment boolean, attachment_name string, attachment_index int, attachment_chunk_index int, "
    "section_header string, text string, content_hash string, emails array<string>, tags array<string>, related_links array<string>"
)
RUN = "id long, started_at timestamp, finished_at timestamp, total_articles int, total_chunks int, total_api_items int, status string, error_message string, attachment_stats map<string,long>"
MESSAGE = "struct<role:string,content:string>"
#: Columns and widths of the bank table.
BANK = (
    "age decimal(3,0), job string, marital string, education string, default string, balance decimal(12,0), housing string, loan string, contact string, day decimal(2,0), month string, "
    "duration decimal(10,0), campaign decimal(10,0), pdays decimal(10,0), previous decimal(10,0), poutcome string, y string"
)
BANK_WIDTHS = {"job": 50, "marital": 20, "education": 20, "default": 10, "housing": 10, "loan": 10, "contact": 20, "month": 10, "poutcome": 20, "y": 10}
