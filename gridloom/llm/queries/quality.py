"""Queries on groups and repetition (p5, p10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.llm.components import match_groups
from gridloom.llm.repetition import repetition, repetitive_documents
from gridloom.session import table


def p5_found(spark, d):
    return match_groups(table(spark, d, "match_pairs"), "node_id_l", "node_id_r", "match_probability", 0.8)


def p5_sizes(spark, d):
    """Groups by size, to be set against entities.cluster_size by the resolved mentions in them."""
    groups = p5_found(spark, d)
    known = table(spark, d, "occurrences").where("entity_id is not null").select("node_id", "entity_id")
    size = table(spark, d, "entities").groupBy(F.col("unique_entity_id").alias("entity_id")).agg(F.max("cluster_size").alias("cluster_size"))
    each = groups.join(known, "node_id", "left").groupBy("group_id").agg(F.count("*").alias("n_mentions"), F.min("entity_id").alias("entity_id"))
    return each.join(size, "entity_id", "left").select("group_id", "n_mentions", "entity_id", "cluster_size")


def p10_found(spark, d):
    return repetitive_documents(table(spark, d, "documents")).select("doc_id")


def p10_shares(spark, d):
    return repetition(table(spark, d, "documents"))


_GROUPS = """
WITH RECURSIVE e AS (
  SELECT DISTINCT node_id_l AS a, node_id_r AS b FROM match_pairs WHERE match_probability >= 0.8 AND node_id_l <> node_id_r),
s AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
r AS (SELECT a AS node_id, a AS x FROM s UNION SELECT r.node_id, s.b FROM r JOIN s ON s.a = r.x),
g AS (SELECT node_id, min(x) AS group_id FROM r GROUP BY node_id)
"""

QUERIES = {"p5_found": p5_found, "p5_sizes": p5_sizes, "p10_found": p10_found, "p10_shares": p10_shares}
SQL = {
    "p5_found": _GROUPS + "SELECT node_id, group_id FROM g",
    "p5_sizes": _GROUPS
    + """, n AS (SELECT group_id, count(*) AS n_mentions, min(o.entity_id) AS entity_id FROM g LEFT JOIN
       (SELECT node_id, entity_id FROM occurrences WHERE entity_id IS NOT NULL) o USING (node_id) GROUP BY group_id),
     z AS (SELECT unique_entity_id AS entity_id, max(cluster_size) AS cluster_size FROM entities GROUP BY ALL)
     SELECT group_id, n_mentions, n.entity_id, cluster_size FROM n LEFT JOIN z USING (entity_id)""",
}
