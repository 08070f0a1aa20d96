"""The thin queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import ann, collocations, embedding_dedup, exact_topk, gam, hard_negatives, langid, lm, packing, sentencepiece_codec, sharding, simhash, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "fingerprint", "component_id", "kept")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return ann.nearest(rows, rows.filter(F.col("vec_id") % 20 == 0))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()
    return sentencepiece_codec.digest(table(spark, sf_dir, "documents"), model)


def page_records(pages: DataFrame) -> DataFrame:
    """WARC-like records of raw pages: a full response of each page, and a visit a day later that found it not modified.

    Every seventh visit comes before the page's own response, and every eleventh one has another ETag.
    """
    h = lambda name, value: F.struct(F.lit(name).alias("name"), value.cast("string").alias("value"))
    tag, at = F.md5("html"), F.col("page_id") * 60
    back = F.when(F.col("page_id") % 7 == 0, at - 30).otherwise(at + 86_400)
    full = F.array(h("Content-Type", F.lit("text/html")), h("Content-Length", F.octet_length("html")), h("Date", at), h("ETag", F.concat(F.lit('"'), tag, F.lit('"'))))
    again = F.array(h("Date", back), h("ETag", F.concat(F.lit('W/"'), F.when(F.col("page_id") % 11 == 0, F.lit("other")).otherwise(tag), F.lit('"'))), h("Cache-Control", F.lit("max-age=60")), h("Content-Length", F.lit(0)))
    row = lambda k, ts, kind, headers: F.struct((F.col("page_id") * 2 + k).alias("record_id"), "url", ts.alias("ts"), F.lit(kind).alias("kind"), headers.alias("headers"))
    return pages.select(F.inline(F.array(row(0, at, "response", full), row(1, back, "revisit", again))))


def op9_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = warc.resolve(page_records(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.array_sort(F.transform("headers", lambda h: F.concat(h["name"], F.lit(": "), h["value"]))), "\n")
    return found.select("revisit_id", "canonical_url", "response_id", "status", lines.alias("headers"))


OP9_SQL = r"""
WITH p AS (
  SELECT page_id, md5(html) AS tag, strlen(html) AS n, regexp_replace(trim(url), '(?s)#.*$', '') AS u,
         page_id * 60 AS ts, CASE WHEN page_id % 7 = 0 THEN page_id * 60 - 30 ELSE page_id * 60 + 86400 END AS back
  FROM pages),
q AS (
  SELECT *, '^([a-zA-Z][a-zA-Z0-9+.-]*)://([^/?#]*)([^?#]*)([?][^#]*)?' AS pat FROM p),
c AS (
  SELECT page_id, tag, n, ts, back, CASE WHEN regexp_matches(u, pat) THEN
      regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(u, pat, 2)), '^.*@', ''), '^www[.]', ''), ':(80|443)?$', '')
      || regexp_replace(regexp_extract(u, pat, 3), '/+$', '')
      || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(substr(regexp_extract(u, pat, 4), 2), '&'),
           lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)'))), '&'), ''), '')
    ELSE u END AS canonical_url FROM q),
r AS (SELECT c.page_id, c.canonical_url, c.back, c.tag, f.page_id AS rp, f.tag AS rtag, f.n AS rn, f.ts AS rts
      FROM c ASOF LEFT JOIN (SELECT * FROM c) f ON c.canonical_url = f.canonical_url AND c.back > f.ts),
s AS (SELECT *, CASE WHEN rp IS NULL THEN 'none' WHEN page_id % 11 <> 0 AND tag = rtag THEN 'resolved' ELSE 'mismatch' END AS status FROM r)
SELECT page_id * 2 + 1 AS revisit_id, canonical_url, rp * 2 AS response_id, status,
  CASE WHEN status = 'resolved'
    THEN 'Cache-Control: max-age=60' || chr(10) || 'Content-Length: ' || rn || chr(10) || 'Content-Type: text/html' || chr(10) || 'Date: ' || back || chr(10) || 'ETag: W/"' || tag || '"'
    ELSE 'Cache-Control: max-age=60' || chr(10) || 'Content-Length: 0' || chr(10) || 'Date: ' || back || chr(10) || 'ETag: W/"' || CASE WHEN page_id % 11 = 0 THEN 'other' ELSE tag END || '"' END AS headers
FROM s
"""


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gam.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
g AS (SELECT lang, ws, unnest([1, 2, 3, 4]) AS k FROM w),
f AS (SELECT lang, k, phrase, count(*) AS f FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM g WHERE len(ws) >= k) GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 30),
u AS (SELECT *, unnest(range(1, k)) AS cut FROM c),
s AS (SELECT u.lang, u.phrase, u.f AS a, l.f AS l, r.f AS r, ((2000000::HUGEINT * u.f) // (l.f::HUGEINT + r.f))::BIGINT AS score
      FROM u JOIN f l ON l.lang = u.lang AND l.phrase = array_to_string(ws[1:cut], ' ') JOIN f r ON r.lang = u.lang AND r.phrase = array_to_string(ws[cut + 1:], ' ')
      QUALIFY row_number() OVER (PARTITION BY u.lang, u.phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, f, unnest(flatten(list_transform(range(2, k), lambda m: list_transform(range(1, k - m + 2), lambda b: array_to_string(ws[b:b + m - 1], ' '))))) AS phrase FROM c WHERE k > 2),
m AS (SELECT lang, phrase, max(f) AS f FROM i GROUP BY lang, phrase)
SELECT lang, row_number() OVER x AS rank, phrase, a, l, r, n, score FROM s JOIN t USING (lang) LEFT JOIN m USING (lang, phrase)
WHERE m.f IS NULL OR 100 * m.f::HUGEINT < 80 * a::HUGEINT
WINDOW x AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) QUALIFY rank <= 2000
"""


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("long") + 1) % 10).otherwise(F.col("label").cast("long"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label)


INTEGERS = """SELECT {columns}, list_transform(embedding, lambda x: floor({factor} * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0"""

OP12_SQL = f"""
WITH v AS ({INTEGERS.format(columns="vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label", factor=256)} AND label IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS own, list_inner_product(a.e, v.e)::BIGINT AS score
      FROM v a JOIN v ON a.vec_id % 50 = 0 AND a.vec_id <> v.vec_id AND len(a.e) = len(v.e)),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE own
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INT AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT own AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 3
"""


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return exact_topk.search(rows, rows.filter(F.col("vec_id") % 100 == 0))


OP13_SQL = f"""
WITH v AS ({INTEGERS.format(columns="vec_id", factor=1024)}),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
      FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, row_number() OVER w::INT AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_embedding_dedup": op1_embedding_dedup,
        "op2_simhash": op2_simhash,
        "op3_language_id": op3_language_id,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_nearest": op5_nearest,
        "op6_sharding": op6_sharding,
        "op7_packing": op7_packing,
        "op8_sentencepiece": op8_sentencepiece,
        "op9_revisits": op9_revisits,
        "op10_quality": op10_quality,
        "op11_collocations": op11_collocations,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_exact_topk": op13_exact_topk,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_revisits": OP9_SQL, "op11_collocations": OP11_SQL, "op12_hard_negatives": OP12_SQL, "op13_exact_topk": OP13_SQL}
