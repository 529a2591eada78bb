"""Queries on the store: scans, upserts, keys, conversion and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import keys
from gridloom.operators import store
from gridloom.session import table

#: The same store in SQL, as the beginning of other queries.
STORE_SQL = r"""
WITH docs AS (
  SELECT lower(trim(document_id)) AS document_id, document_name, file_path,
    CASE WHEN trim(access_tags) LIKE '[%' THEN regexp_extract_all(access_tags, '[A-Za-z_]+') ELSE [] END AS access_tags
  FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at, document_name) AS rn FROM source_documents WHERE document_id IS NOT NULL)
  WHERE rn = 1 AND deleted_at IS NULL),
ents AS (
  SELECT unique_entity_id, upper(trim(entity_type))[1] || lower(trim(entity_type))[2:] AS entity_type, trim(canonical_name) AS canonical_name, cluster_size, attributes
  FROM (SELECT *, row_number() OVER (PARTITION BY unique_entity_id ORDER BY load_seq DESC) AS rn FROM entities WHERE unique_entity_id IS NOT NULL)
  WHERE rn = 1 AND deleted_at IS NULL),
rels AS (
  SELECT relationship_id, relationship_type, lower(trim(from_entity_id)) AS from_entity_id, lower(trim(to_entity_id)) AS to_entity_id, attributes, access_policy
  FROM (SELECT * REPLACE (lower(trim(relationship_id)) AS relationship_id), row_number() OVER (PARTITION BY lower(trim(relationship_id)) ORDER BY load_seq DESC) AS rn
        FROM relationships WHERE trim(relationship_id) <> '')
  WHERE rn = 1 AND lower(trim(from_entity_id)) IN (SELECT unique_entity_id FROM ents) AND lower(trim(to_entity_id)) IN (SELECT unique_entity_id FROM ents)),
occs AS (
  SELECT entity_id, document_id, list_transform(regexp_extract_all(page_numbers, '\d+'), lambda x: x::INT) AS page_numbers
  FROM (SELECT lower(trim(entity_id)) AS entity_id, lower(trim(document_id)) AS document_id, page_numbers,
          row_number() OVER (PARTITION BY lower(trim(entity_id)), lower(trim(document_id)) ORDER BY load_seq DESC) AS rn
        FROM entity_occurrences WHERE trim(entity_id) <> '' AND trim(document_id) <> '')
  WHERE rn = 1)
"""


def kg_entities(spark, d):
    return store.open_store(spark, d).entities.select("unique_entity_id", "entity_type", "canonical_name", "cluster_size")


def kg_relationships(spark, d):
    return store.open_store(spark, d).relationships.select("relationship_id", "relationship_type", "from_entity_id", "to_entity_id", "access_policy")


def kg_documents(spark, d):
    return store.open_store(spark, d).documents.select("document_id", "document_name", F.array_join("access_tags", ",").alias("tags"))


def kg_occurrences(spark, d):
    return store.open_store(spark, d).occurrences.select("entity_id", "document_id", F.array_join(F.array_sort(F.array_distinct("page_numbers")), ",").alias("pages"))


def table_counts(spark, d):
    return store.open_store(spark, d).counts()


def entity_keys(spark, d):
    s = table(spark, d, "supplier")
    name = F.concat(F.lit(" "), F.col("s_name"))
    ek = keys.entity_key(name, F.lit("Company"))
    return s.select("s_suppkey", ek.alias("entity_key"), keys.document_key(name).alias("document_key"), keys.relationship_key(ek, ek, F.lit("owns ")).alias("relationship_key"))


def upsert_last_wins(spark, d):
    e = table(spark, d, "entities").select("unique_entity_id", "load_seq", "cluster_size")
    return store.upsert_last(e, ["unique_entity_id"], ["load_seq"])


def insert_ignore(spark, d):
    t = table(spark, d, "source_documents").select("document_id", "document_name", "created_at")
    old = t.where(F.col("document_name") < "m")
    return store.insert_or_ignore(t, ["document_id"], ["created_at", "document_name"], old).select("document_id", "document_name")


def v_entity_details(spark, d):
    return store.entity_details(store.open_store(spark, d))


def v_relationship_details(spark, d):
    return store.relationship_details(store.open_store(spark, d))


def rule_members(entities):
    """Communities by a plain rule on the key, so that SQL can state them."""
    n = lambda i, k: (F.conv(F.substring("unique_entity_id", i, 4), 16, 10).cast("int") % k).alias("community_id")
    out = None
    for level, i, k in (("micro", 1, 40), ("meso", 2, 12), ("macro", 3, 4)):
        part = entities.select(F.col("unique_entity_id").alias("entity_id"), F.lit(level).alias("level"), n(i, k))
        out = part if out is None else out.unionByName(part)
    return out


MEMBERS_SQL = STORE_SQL + """, members AS (
  SELECT unique_entity_id AS entity_id, level, (('0x' || substr(unique_entity_id, i, 4))::INT % k)::INT AS community_id
  FROM ents, (VALUES ('micro', 1, 40), ('meso', 2, 12), ('macro', 3, 4)) v(level, i, k))
"""


def v_entity_communities(spark, d):
    s = store.open_store(spark, d)
    return store.entity_communities(s.entities.select("unique_entity_id", "canonical_name", "entity_type"), rule_members(s.entities))


def v_community_details(spark, d):
    s = store.open_store(spark, d)
    return store.community_members(rule_members(s.entities))


def community_peers(spark, d):
    """Peers of the entities with the smallest key of each macro community, by community and not by pair."""
    s = store.open_store(spark, d)
    m = rule_members(s.entities).where("level = 'macro'")
    first = m.groupBy("community_id").agg(F.min("entity_id").alias("target"))
    return m.join(first, "community_id").where("entity_id <> target").select("target", F.col("entity_id").alias("peer"))


def cross_community_edges(spark, d):
    s = store.open_store(spark, d)
    return store.cross_community(s.relationships, rule_members(s.entities), "meso")


def community_internal_edges(spark, d):
    s = store.open_store(spark, d)
    return store.community_relationships(s.relationships, rule_members(s.entities)).groupBy("level", "community_id").agg(F.count("*").alias("n_relationships"))


QUERIES = {f.__name__: f for f in (
    kg_entities, kg_relationships, kg_documents, kg_occurrences, table_counts, entity_keys, upsert_last_wins, insert_ignore, v_entity_details,
    v_relationship_details, v_entity_communities, v_community_details, community_peers, cross_community_edges, community_internal_edges)}
SQL = {
    "kg_entities": STORE_SQL + "SELECT unique_entity_id, entity_type, canonical_name, cluster_size FROM ents",
    "kg_relationships": STORE_SQL + "SELECT relationship_id, relationship_type, from_entity_id, to_entity_id, access_policy FROM rels",
    "kg_documents": STORE_SQL + "SELECT document_id, document_name, array_to_string(access_tags, ',') AS tags FROM docs",
    "kg_occurrences": STORE_SQL + "SELECT entity_id, document_id, array_to_string(list_sort(list_distinct(page_numbers)), ',') AS pages FROM occs",
    "table_counts": STORE_SQL + """SELECT 'documents' AS table_name, count(*) AS n_rows FROM docs UNION ALL SELECT 'entities', count(*) FROM ents
        UNION ALL SELECT 'relationships', count(*) FROM rels UNION ALL SELECT 'occurrences', count(*) FROM occs""",
    "entity_keys": """SELECT s_suppkey, substr(md5(upper(s_name) || '|COMPANY'), 1, 16) AS entity_key, substr(md5(s_name), 1, 16) AS document_key,
        substr(md5(substr(md5(upper(s_name) || '|COMPANY'), 1, 16) || '|' || substr(md5(upper(s_name) || '|COMPANY'), 1, 16) || '|OWNS'), 1, 16) AS relationship_key FROM supplier""",
    "upsert_last_wins": "SELECT unique_entity_id, max(load_seq) AS load_seq, arg_max({'c': cluster_size}, load_seq).c AS cluster_size FROM entities GROUP BY 1",
    "insert_ignore": """SELECT document_id, document_name FROM (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY created_at, document_name) AS rn FROM source_documents)
        WHERE rn = 1 AND document_id NOT IN (SELECT document_id FROM source_documents WHERE document_name < 'm')""",
    "v_entity_details": STORE_SQL + """SELECT unique_entity_id, entity_type, canonical_name, string_agg(DISTINCT d.document_name, ',' ORDER BY d.document_name) AS documents,
        count(DISTINCT d.document_id) AS document_count FROM ents e LEFT JOIN occs o ON o.entity_id = e.unique_entity_id LEFT JOIN docs d ON d.document_id = o.document_id GROUP BY ALL""",
    "v_relationship_details": STORE_SQL + """SELECT relationship_id, relationship_type, a.canonical_name AS from_name, a.entity_type AS from_type, b.canonical_name AS to_name, b.entity_type AS to_type, access_policy, NULL::VARCHAR AS documents
        FROM rels JOIN ents a ON a.unique_entity_id = from_entity_id JOIN ents b ON b.unique_entity_id = to_entity_id""",
    "v_entity_communities": MEMBERS_SQL + """SELECT unique_entity_id, canonical_name, entity_type, a.community_id AS community_micro, b.community_id AS community_meso, c.community_id AS community_macro
        FROM ents e LEFT JOIN members a ON a.entity_id = e.unique_entity_id AND a.level = 'micro' LEFT JOIN members b ON b.entity_id = e.unique_entity_id AND b.level = 'meso'
        LEFT JOIN members c ON c.entity_id = e.unique_entity_id AND c.level = 'macro'""",
    "v_community_details": MEMBERS_SQL + "SELECT level, community_id, count(*) AS actual_member_count FROM members GROUP BY ALL",
    "community_peers": MEMBERS_SQL + """SELECT target, entity_id AS peer FROM members JOIN (SELECT community_id, min(entity_id) AS target FROM members WHERE level = 'macro' GROUP BY 1) USING (community_id)
        WHERE level = 'macro' AND entity_id <> target""",
    "cross_community_edges": MEMBERS_SQL + """SELECT relationship_id, relationship_type, a.community_id AS from_community, b.community_id AS to_community FROM rels
        JOIN members a ON a.entity_id = from_entity_id AND a.level = 'meso' JOIN members b ON b.entity_id = to_entity_id AND b.level = 'meso' WHERE a.community_id <> b.community_id""",
    "community_internal_edges": MEMBERS_SQL + """SELECT a.level, a.community_id, count(*) AS n_relationships FROM rels
        JOIN members a ON a.entity_id = from_entity_id JOIN members b ON b.entity_id = to_entity_id AND a.level = b.level AND a.community_id = b.community_id GROUP BY ALL""",
}
