"""Queries on rights, traversal, paths and citations."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from gridloom.operators import store
from gridloom.plans.traverse import SecureTraversal
from gridloom.queries.store_queries import STORE_SQL

TAGS = ["AUDIT"]


def _walk(spark, d, tags=TAGS):
    return SecureTraversal(store.open_store(spark, d), tags)


def _starts(w, n=3):
    """The grounded entities of smallest key: the feature is a question about a few named entities."""
    return w.grounded.orderBy("entity_id").limit(n)


def acl_allowed_docs(spark, d):
    return _walk(spark, d).allowed.select("document_id", "document_name")


def acl_unclassified_docs(spark, d):
    return _walk(spark, d, []).allowed.select("document_id")


def acl_grounded(spark, d):
    return _walk(spark, d).grounded


def acl_candidates(spark, d):
    """Entities of one type that the user may see."""
    w = _walk(spark, d)
    return w.store.entities.where("entity_type = 'Organization'").join(w.grounded.withColumnRenamed("entity_id", "unique_entity_id"), "unique_entity_id", "left_semi").select("unique_entity_id", "canonical_name")


def context_nodes(spark, d):
    w = _walk(spark, d)
    return w.details(w.reached(_starts(w), 2)).select("unique_entity_id", "entity_type", "canonical_name")


def context_depths(spark, d):
    w = _walk(spark, d)
    return w.reached(_starts(w), 3)


def context_edges(spark, d):
    w = _walk(spark, d)
    return w.subgraph(w.reached(_starts(w), 2))


def context_citations(spark, d):
    w = _walk(spark, d)
    return w.citations(w.reached(_starts(w), 1)).select("document_name", F.array_join("pages", ",").alias("pages"))


def context_depth0(spark, d):
    w = _walk(spark, d)
    return w.details(w.reached(_starts(w), 0)).select("unique_entity_id", "canonical_name")


def context_restricted(spark, d):
    """How many entities are reached with the tag, and how many of them cannot be seen without it."""
    w, u = _walk(spark, d), _walk(spark, d, [])
    seen = w.reached(_starts(w), 2).select("entity_id").join(u.grounded.withColumn("free", F.lit(1)), "entity_id", "left")
    return seen.agg(F.count("*").alias("n_reached"), (F.count("*") - F.count("free")).alias("n_restricted"))


def _cited(s):
    """The store with relationships cited where their first end is mentioned."""
    r = s.relationships.select("relationship_id", F.col("from_entity_id").alias("entity_id"))
    return replace(s, relationship_occurrences=r.join(s.occurrences, "entity_id").select("relationship_id", "document_id", "page_numbers"))


def context_relationship_citations(spark, d):
    """Citations of a context with those of the relationships that touch it."""
    w = SecureTraversal(_cited(store.open_store(spark, d)), TAGS)
    c = w.citations(w.reached(_starts(w), 1), w.store.relationship_occurrences)
    return c.select("document_name", F.array_join("pages", ",").alias("pages"))


def relationship_documents(spark, d):
    """Relationships with the documents that state them."""
    return store.relationship_details(_cited(store.open_store(spark, d))).select("relationship_id", "from_name", "to_name", "documents")


def shortest_path_edges(spark, d):
    """The path between the grounded entities of smallest and greatest key."""
    w = _walk(spark, d)
    a, b = w.grounded.agg(F.min("entity_id"), F.max("entity_id")).first()
    path = w.shortest_path(a, b) if a else None
    return w.path_edges(path or [])


def shortest_path_len(spark, d):
    w = _walk(spark, d)
    a, b = w.grounded.agg(F.min("entity_id"), F.max("entity_id")).first()
    path = w.shortest_path(a, b) if a else None
    return spark.createDataFrame([(a, b, len(path) - 1 if path else None)], "source string, target string, steps bigint")


def schema_types(spark, d):
    return store.open_store(spark, d).entities.select("entity_type").distinct()


_ACL = STORE_SQL.replace("WITH docs", "WITH RECURSIVE docs", 1) + """, al AS (SELECT * FROM docs WHERE list_contains(list_transform(access_tags, lambda t: upper(t)), 'UNCLASSIFIED') OR list_contains(access_tags, 'AUDIT')),
 gr AS (SELECT DISTINCT entity_id FROM occs WHERE document_id IN (SELECT document_id FROM al)),
 op AS (SELECT * FROM rels WHERE access_policy = 'OPEN' AND from_entity_id IN (SELECT entity_id FROM gr) AND to_entity_id IN (SELECT entity_id FROM gr)),
 sy AS (SELECT from_entity_id AS x, to_entity_id AS y FROM op UNION SELECT to_entity_id, from_entity_id FROM op),
 st AS (SELECT entity_id FROM gr ORDER BY entity_id LIMIT 3)
"""


def _reach(depth: int) -> str:
    out = _ACL + ", r0 AS (SELECT entity_id, 0 AS depth FROM st)"
    for i in range(1, depth + 1):
        out += f", r{i} AS (SELECT * FROM r{i - 1} UNION ALL SELECT DISTINCT y, {i} FROM sy JOIN r{i - 1} ON x = entity_id WHERE y NOT IN (SELECT entity_id FROM r{i - 1}))"
    return out + "\n"


QUERIES = {f.__name__: f for f in (
    acl_allowed_docs, acl_unclassified_docs, acl_grounded, acl_candidates, context_nodes, context_depths, context_edges, context_citations, context_depth0, context_restricted, context_relationship_citations, relationship_documents,
    shortest_path_edges, shortest_path_len, schema_types)}
SQL = {
    "acl_allowed_docs": _ACL + "SELECT document_id, document_name FROM al",
    "acl_unclassified_docs": STORE_SQL + "SELECT document_id FROM docs WHERE list_contains(list_transform(access_tags, lambda t: upper(t)), 'UNCLASSIFIED')",
    "acl_grounded": _ACL + "SELECT entity_id FROM gr",
    "acl_candidates": _ACL + "SELECT unique_entity_id, canonical_name FROM ents WHERE entity_type = 'Organization' AND unique_entity_id IN (SELECT entity_id FROM gr)",
    "context_nodes": _reach(2) + "SELECT unique_entity_id, entity_type, canonical_name FROM ents WHERE unique_entity_id IN (SELECT entity_id FROM r2)",
    "context_depths": _reach(3) + "SELECT entity_id, depth FROM r3",
    "context_edges": _reach(2) + """SELECT DISTINCT relationship_id, relationship_type, from_entity_id, to_entity_id, a.canonical_name AS from_name, b.canonical_name AS to_name FROM op
        JOIN ents a ON a.unique_entity_id = from_entity_id JOIN ents b ON b.unique_entity_id = to_entity_id WHERE from_entity_id IN (SELECT entity_id FROM r2) AND to_entity_id IN (SELECT entity_id FROM r2)""",
    "context_citations": _reach(1) + """, p AS (SELECT DISTINCT document_name, unnest(CASE WHEN len(page_numbers) = 0 THEN [NULL] ELSE page_numbers END) AS page FROM occs JOIN al USING (document_id) WHERE page_numbers IS NOT NULL AND entity_id IN (SELECT entity_id FROM r1))
        SELECT document_name, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page), '') AS pages FROM p GROUP BY document_name""",
    "context_depth0": _reach(0) + "SELECT unique_entity_id, canonical_name FROM ents WHERE unique_entity_id IN (SELECT entity_id FROM r0)",
    "relationship_documents": STORE_SQL + """SELECT relationship_id, a.canonical_name AS from_name, b.canonical_name AS to_name, string_agg(DISTINCT document_name, ',' ORDER BY document_name) AS documents
        FROM rels JOIN ents a ON a.unique_entity_id = from_entity_id JOIN ents b ON b.unique_entity_id = to_entity_id LEFT JOIN occs o ON o.entity_id = from_entity_id LEFT JOIN docs d ON d.document_id = o.document_id GROUP BY ALL""",
    "context_relationship_citations": _reach(1) + """, c AS (SELECT document_id, page_numbers FROM occs WHERE entity_id IN (SELECT entity_id FROM r1)
          UNION ALL SELECT document_id, page_numbers FROM op JOIN occs ON entity_id = from_entity_id WHERE from_entity_id IN (SELECT entity_id FROM r1) OR to_entity_id IN (SELECT entity_id FROM r1)),
        p AS (SELECT DISTINCT document_name, unnest(CASE WHEN len(page_numbers) = 0 THEN [NULL] ELSE page_numbers END) AS page FROM c JOIN al USING (document_id) WHERE page_numbers IS NOT NULL)
        SELECT document_name, coalesce(string_agg(page::VARCHAR, ',' ORDER BY page), '') AS pages FROM p GROUP BY document_name""",
    "context_restricted": _reach(2) + """SELECT count(*) AS n_reached, count(*) FILTER (entity_id NOT IN (SELECT entity_id FROM occs WHERE document_id IN
        (SELECT document_id FROM docs WHERE list_contains(list_transform(access_tags, lambda t: upper(t)), 'UNCLASSIFIED'))))::BIGINT AS n_restricted FROM r2""",
    "shortest_path_len": _ACL.replace("SELECT entity_id FROM gr ORDER BY entity_id LIMIT 3", "SELECT min(entity_id) AS entity_id FROM gr") + ", r0 AS (SELECT entity_id, 0 AS depth FROM st)"
    + "".join(f", r{i} AS (SELECT * FROM r{i - 1} UNION ALL SELECT DISTINCT y, {i} FROM sy JOIN r{i - 1} ON x = entity_id AND depth = {i - 1} WHERE y NOT IN (SELECT entity_id FROM r{i - 1}))" for i in range(1, 9))
    + " SELECT (SELECT entity_id FROM st) AS source, (SELECT max(entity_id) FROM gr) AS target, (SELECT depth::BIGINT FROM r8 WHERE entity_id = (SELECT max(entity_id) FROM gr)) AS steps",
    "schema_types": STORE_SQL + "SELECT DISTINCT entity_type FROM ents",
}
