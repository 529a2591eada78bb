"""Retrieval: BM25 over word windows, and exact top-k by cosine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.similarity import cosine
from gridloom.functions.text import tokens, word_windows

K1, B = 1.5, 0.75


def chunks(docs: DataFrame, id_col: str, text: Column, size: int = 100, overlap: int = 20) -> DataFrame:
    """(document, chunk, text): overlapping word windows of every document."""
    return docs.select(F.col(id_col).alias("document"), F.posexplode(word_windows(text, size, overlap)).alias("chunk", "text"))


def postings(parts: DataFrame, key: list[str], terms: Column | None = None) -> DataFrame:
    """(key..., term, tf, len): term counts per chunk; a chunk without terms has none."""
    toks = tokens(F.col("text")) if terms is None else terms
    each = parts.select(*key, toks.alias("ts")).select(*key, F.size("ts").alias("len"), F.explode("ts").alias("term"))
    return each.groupBy(*key, "len", "term").agg(F.count("*").alias("tf"))


def bm25(parts: DataFrame, key: list[str], queries: DataFrame, terms=tokens, keep_zero: bool = False) -> DataFrame:
    """(query_id, key..., score) with ln(1 + (N - df + 0.5) / (df + 0.5)); a term that a query repeats counts as often.

    Only the terms asked for are gathered: their postings are joined with document frequencies and summed per chunk.
    keep_zero adds the chunks that score nothing, for ranking all of them.
    """
    toks = parts.select(*key, terms(F.col("text")).alias("ts"))
    stats = toks.agg(F.count("*").alias("n_chunks"), F.avg(F.size("ts")).alias("mean"))
    q = queries.select("query_id", F.explode(terms(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = q.select("term").distinct()
    tf = toks.select(*key, F.size("ts").alias("len"), F.explode("ts").alias("term")).join(asked, "term", "left_semi").groupBy(*key, "len", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n_chunks") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = F.when(F.col("mean") > 0, F.col("mean")).otherwise(1.0)
    part = F.col("qtf") * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / mean))
    weights = q.join(df, "term").join(F.broadcast(stats))  # one row of statistics
    scored = tf.join(weights, ["term", "df"] if "df" in tf.columns else "term").groupBy("query_id", *key).agg(F.sum(part).alias("score"))
    if not keep_zero:
        return scored.where("score > 0")
    every = toks.select(*key).join(queries.select("query_id"))
    return every.join(scored, ["query_id", *key], "left").na.fill(0.0, ["score"])


def top_k(scored: DataFrame, k: int, group: list[str], ties: list[str], score: str = "score") -> DataFrame:
    """The k best per group, ties by the given columns; Spark limits groups before their shuffle."""
    from pyspark.sql import Window

    w = Window.partitionBy(*group).orderBy(F.desc(score), *ties)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_top_k(vectors: DataFrame, id_col: str, vector_col: str, query: list[float], k: int = 20, threshold: float = 0.5) -> DataFrame:
    """(id, score): the k best by cosine, then those at or above the threshold."""
    q = F.array(*[F.lit(float(x)) for x in query])
    hits = vectors.where(F.size(vector_col) == len(query)).select(F.col(id_col), cosine(F.col(vector_col), q).alias("score")).where("score is not null")
    return hits.orderBy(F.desc("score"), id_col).limit(k).where(F.col("score") >= threshold).withColumn("score", F.round("score", 4))


def passages(parts: DataFrame, question: str, k: int, allowed: DataFrame) -> DataFrame:
    """(document, chunk, text, score): the best passages of documents the user may see."""
    seen = parts.join(allowed.select(F.col("document_name").alias("document")).distinct(), "document", "left_semi")
    ask = parts.sparkSession.createDataFrame([(0, question)], "query_id int, query string")
    best = bm25(seen, ["document", "chunk"], ask).orderBy(F.desc("score"), "document", "chunk").limit(k)
    return best.join(seen, ["document", "chunk"]).select("document", "chunk", "text", F.round("score", 3).alias("score"))
