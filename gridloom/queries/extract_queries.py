"""Queries on packing pages and on the cache of replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import extract
from gridloom.session import table

BUDGET, PROMPT = 2_000, 100


def token_packing(spark, d):
    pages = table(spark, d, "rapidocr_pages")
    return extract.pack_pages(extract.page_tokens(pages), BUDGET, PROMPT)


def document_pages(spark, d):
    """Page decision per document: a text layer counts when one of the first three pages has more than 100 characters."""
    p = table(spark, d, "rapidocr_pages")
    early = (F.col("page_number") <= 3) & (F.length(F.trim("text")) > 100) & F.col("has_text_layer")
    return p.groupBy("doc_name").agg(F.bool_or(early).alias("has_layer"), F.count("*").alias("n_pages"), F.round(F.avg("ocr_confidence"), 6).alias("mean_confidence"))


QUERIES = {f.__name__: f for f in (token_packing, document_pages)}
SQL = {
    "token_packing": f"""WITH RECURSIVE p AS (SELECT doc_name, page_number, (length(text) // 4)::BIGINT AS n, row_number() OVER (PARTITION BY doc_name ORDER BY page_number) AS k FROM rapidocr_pages),
      r AS (SELECT doc_name, page_number, n, k, 1 AS chunk, {PROMPT} + n AS used FROM p WHERE k = 1
        UNION ALL SELECT p.doc_name, p.page_number, p.n, p.k, CASE WHEN used + p.n > {BUDGET} AND used > {PROMPT} THEN chunk + 1 ELSE chunk END, CASE WHEN used + p.n > {BUDGET} AND used > {PROMPT} THEN {PROMPT} + p.n ELSE used + p.n END
        FROM r JOIN p ON p.doc_name = r.doc_name AND p.k = r.k + 1)
      SELECT doc_name, page_number, n AS n_tokens, chunk FROM r""",
    "document_pages": """SELECT doc_name, bool_or(page_number <= 3 AND length(trim(text)) > 100 AND has_text_layer) AS has_layer, count(*) AS n_pages, round(avg(ocr_confidence), 6) AS mean_confidence FROM rapidocr_pages GROUP BY doc_name""",
}
