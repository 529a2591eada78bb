"""Queries on nearest vectors (p4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.llm.neighbours import nearest, usable_vectors
from gridloom.session import table

K, DIM = 5, 64


def p4_found(spark, d):
    vectors = usable_vectors(table(spark, d, "entity_vectors"), "sql_id", "vector", F.coalesce("is_probe", F.lit(False)), DIM)
    near = nearest(vectors, K, DIM)
    return near.select(F.least("id", "neighbour").alias("sql_id_a"), F.greatest("id", "neighbour").alias("sql_id_b")).distinct()


QUERIES = {"p4_found": p4_found}
SQL: dict[str, str] = {
    "p4_found": """
WITH v AS (SELECT sql_id, any_value(vector::DOUBLE[]) AS x, bool_or(is_probe) AS p FROM entity_vectors
  WHERE len(vector) = 64 AND list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) > 0 GROUP BY sql_id),
n AS (SELECT a.sql_id AS q, b.sql_id AS r, row_number() OVER (PARTITION BY a.sql_id ORDER BY list_cosine_similarity(a.x, b.x) DESC, b.sql_id) AS k
  FROM v a JOIN v b ON a.p AND a.sql_id <> b.sql_id)
SELECT DISTINCT least(q, r) AS sql_id_a, greatest(q, r) AS sql_id_b FROM n WHERE k <= 5"""
}
