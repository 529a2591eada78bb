"""Queries on BM25 and vector retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.text import normalize_name, words
from gridloom.operators import retrieve, store
from gridloom.plans.traverse import allowed_documents
from gridloom.queries.text_queries import norm_sql
from gridloom.session import table

QUESTIONS = [(1, "audit committee revised the goodwill"), (2, "working capital limit working capital"), (3, "loan agreement for 41 units at Marupalli")]


def _questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id int, query string")


def _docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def bm25_scores(spark, d):
    s = retrieve.bm25(_docs(spark, d), ["doc_id"], _questions(spark))
    return s.select("query_id", "doc_id", F.round("score", 4).alias("score"))


def bm25_topk(spark, d):
    s = retrieve.top_k(retrieve.bm25(_docs(spark, d), ["doc_id"], _questions(spark)), 5, ["query_id"], ["doc_id"])
    return s.select("query_id", "doc_id", "rank", F.round("score", 4).alias("score"))


def bm25_all_ranked(spark, d):
    """The variant over normalised words that also ranks what scores nothing."""
    terms = lambda c: words(normalize_name(c))
    s = retrieve.bm25(_docs(spark, d), ["doc_id"], _questions(spark), terms=terms, keep_zero=True)
    return s.groupBy("query_id").agg(F.count("*").alias("n_docs"), F.sum((F.col("score") == 0).cast("bigint")).alias("n_zero"))


def bm25_terms(spark, d):
    p = retrieve.postings(_docs(spark, d), ["doc_id"])
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def rag_chunks(spark, d):
    c = retrieve.chunks(table(spark, d, "documents"), "doc_id", F.col("text"), 100, 0)
    return c.groupBy("document").agg(F.count("*").alias("n_chunks")).withColumnRenamed("document", "doc_id")


def passage_search(spark, d):
    """Best passages of scanned documents that a user with the tag AUDIT may see."""
    s = store.open_store(spark, d)
    pages = table(spark, d, "rapidocr_pages").select(F.col("doc_name").alias("document"), F.col("page_number").alias("chunk"), "text")
    named = s.documents.withColumn("document_name", F.col("document_name"))
    return retrieve.passages(pages, "audit committee revised the goodwill", 5, allowed_documents(named, ["AUDIT"])).select("document", "chunk", "score")


def vector_topk(spark, d):
    """The nearest of all embeddings to the first one."""
    v = table(spark, d, "embeddings")
    q = v.orderBy("vec_id").select("embedding").first()
    return retrieve.vector_top_k(v, "vec_id", "embedding", q[0], 20, 0.1)


def entity_vector_topk(spark, d):
    v = table(spark, d, "entity_vectors").where(F.size("vector") == 64).groupBy("sql_id").agg(F.min("vector").alias("vector"))
    q = v.orderBy("sql_id").select("vector").first()
    return retrieve.vector_top_k(v, "sql_id", "vector", q[0], 10, 0.5)


_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+(?:[.&''-][a-z0-9]+)*')"
_BM = f"""WITH q0 AS (SELECT query_id, unnest(regexp_extract_all(lower(query), '[a-z0-9]+(?:[.&''-][a-z0-9]+)*')) AS term FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in QUESTIONS)}) v(query_id, query)),
 q AS (SELECT query_id, term, count(*) AS qtf FROM q0 GROUP BY ALL),
 t AS (SELECT doc_id, {_TOK} AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM t),
 p AS (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM t), tf AS (SELECT doc_id, len, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM q) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
 s AS (SELECT query_id, doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean))) AS score FROM tf JOIN df USING (term) JOIN q USING (term), st GROUP BY ALL)
"""

QUERIES = {f.__name__: f for f in (bm25_scores, bm25_topk, bm25_all_ranked, bm25_terms, rag_chunks, passage_search, vector_topk, entity_vector_topk)}
SQL = {
    "bm25_scores": _BM + "SELECT query_id::INT AS query_id, doc_id, round(score, 4) AS score FROM s WHERE score > 0",
    "bm25_topk": _BM + "SELECT query_id::INT AS query_id, doc_id, rank::INT AS rank, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= 5",
    "bm25_terms": f"WITH p AS (SELECT doc_id, unnest({_TOK}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM p GROUP BY term",
    "bm25_all_ranked": f"""WITH q AS (SELECT DISTINCT query_id, unnest(list_filter(string_split({norm_sql('query')}, ' '), lambda t: t <> '')) AS term FROM (VALUES {', '.join(f"({i}, '{t}')" for i, t in QUESTIONS)}) v(query_id, query)),
        t AS (SELECT doc_id, list_distinct(string_split({norm_sql('text')}, ' ')) AS ts FROM documents), h AS (SELECT query_id, count(*) AS n FROM (SELECT DISTINCT query_id, doc_id FROM (SELECT doc_id, unnest(ts) AS term FROM t) JOIN q USING (term)) GROUP BY query_id),
        k AS (SELECT DISTINCT query_id FROM q), c AS (SELECT count(*) AS n FROM documents)
        SELECT query_id::INT AS query_id, c.n AS n_docs, (c.n - coalesce(h.n, 0))::BIGINT AS n_zero FROM k LEFT JOIN h USING (query_id), c""",
    "rag_chunks": r"SELECT doc_id, greatest(1, ceil(n / 100))::BIGINT AS n_chunks FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\s+'), lambda t: t <> '')) AS n FROM documents) WHERE n > 0",
    "vector_topk": """WITH q AS (SELECT embedding::DOUBLE[] AS x FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], x) AS c FROM embeddings, q ORDER BY c DESC, vec_id LIMIT 20)
        SELECT vec_id, round(c, 4) AS score FROM s WHERE c >= 0.1""",
    "entity_vector_topk": """WITH v AS (SELECT sql_id, any_value(vector::DOUBLE[]) AS x FROM entity_vectors WHERE len(vector) = 64 GROUP BY sql_id), q AS (SELECT x AS y FROM v ORDER BY sql_id LIMIT 1),
        s AS (SELECT sql_id, list_cosine_similarity(x, y) AS c FROM v, q WHERE list_dot_product(x, x) > 0 ORDER BY c DESC, sql_id LIMIT 10) SELECT sql_id, round(c, 4) AS score FROM s WHERE c >= 0.5""",
}
