"""Queries on mention graphs and their merge. The extraction results are the resolved mentions of occurrences by document."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import mentions as M
from gridloom.operators import store
from gridloom.session import table


def extractions(spark, d):
    """One result per document: its mentions in order, and a NEXT relationship between neighbours."""
    o = table(spark, d, "occurrences")
    attrs = F.map_from_arrays(F.array(F.lit("name"), F.lit("type"), F.lit("page_number")), F.array(F.trim("surface"), F.lit("mention"), F.col("page").cast("string")))
    e = F.struct("occurrence_id", F.regexp_extract("node_id", r"^node_\d+_(.*)$", 1).alias("id"), F.regexp_extract("node_id", r"_([A-Z]+)_\d+$", 1).alias("type"), attrs.alias("attributes"))
    # maps cannot be ordered, so mentions are gathered by id and looked up again
    rows = o.groupBy("document").agg(F.collect_list(e).alias("es"))
    es = F.array_sort("es", lambda a, b: F.when(a["occurrence_id"] < b["occurrence_id"], -1).otherwise(1))
    rows = rows.select(F.col("document").alias("source_doc"), F.col("document").alias("doc_ord"), es.alias("es"))
    ids = F.transform("es", lambda x: x["id"])
    rel = F.transform(F.sequence(F.lit(1), F.greatest(F.size("es") - 1, F.lit(1))), lambda i: F.struct(
        F.element_at(ids, i).alias("from_id"), F.try_element_at(ids, i + 1).alias("to_id"), F.lit("NEXT").alias("type"), F.create_map(F.lit("source_doc"), F.lit("x")).alias("attributes")))
    return rows.select("source_doc", "doc_ord", F.lit(None).cast("array<int>").alias("pages"), F.transform("es", lambda x: F.struct(x["id"].alias("id"), x["type"].alias("type"), x["attributes"].alias("attributes"))).alias("entities"), rel.alias("relationships"))


def _graph(spark, d):
    x = extractions(spark, d)
    nodes = M.mentions(x)
    return nodes, M.mention_edges(x, nodes)


def mention_build(spark, d):
    nodes, _ = _graph(spark, d)
    return nodes.select("node_id", "type", "source_doc", F.array_join("page_numbers", ",").alias("pages"), F.col("attrs")["attr_type"].alias("attr_type"))


def edge_collapse(spark, d):
    _, edges = _graph(spark, d)
    return edges.select("src", "dst", "relationship_type", F.col("attrs")["attr_source_doc"].alias("attr_source_doc"))


def _clusters(nodes):
    """Mentions of one exact name and type."""
    named = nodes.select("node_id", "type", F.lower(F.col("attrs")["name"]).alias("k")).where("k <> ''")
    low = named.groupBy("type", "k").agg(F.min("node_id").alias("cluster_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    return named.join(low, ["type", "k"]).select("node_id", "cluster_id")


def cluster_merge_nodes(spark, d):
    nodes, _ = _graph(spark, d)
    merged = M.merge_nodes(nodes, M.representatives(nodes, _clusters(nodes)))
    return merged.select("node_id", F.col("attrs")["name"].alias("name"), "cluster_size", F.array_join("page_numbers", ",").alias("pages"), F.size("source_docs").cast("bigint").alias("n_docs"))


def cluster_merge_edges(spark, d):
    nodes, edges = _graph(spark, d)
    merged = M.merge_edges(edges, M.representatives(nodes, _clusters(nodes)))
    return merged.select("src", "dst", "relationship_type", F.size("source_docs").cast("bigint").alias("n_docs"))


def method_report(spark, d):
    nodes, _ = _graph(spark, d)
    return M.reduction(nodes, _clusters(nodes))


def graph_stats(spark, d):
    nodes, edges = _graph(spark, d)
    return M.statistics(nodes, edges).select("metric", "key", F.round("value", 6).alias("value"))


def graph_filter(spark, d):
    """Edges and nodes of the part of the graph whose mentions are of one type."""
    nodes, edges = _graph(spark, d)
    first = nodes.agg(F.min("type")).first()[0]
    n, e = M.filtered(nodes, edges, types=[first])
    return n.select(F.col("node_id").alias("a"), F.lit("").alias("b")).unionByName(e.select(F.col("src").alias("a"), F.col("dst").alias("b")))


def graph_convert(spark, d):
    """Row counts of the five tables that the merged graph becomes."""
    nodes, edges = _graph(spark, d)
    reps = M.representatives(nodes, _clusters(nodes))
    tables = store.convert_graph(M.merge_nodes(nodes, reps), M.merge_edges(edges, reps))
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = n if out is None else out.unionByName(n)
    return out


def page_fallback(spark, d):
    o = table(spark, d, "entity_occurrences")
    pages = M.page_list(F.col("page_numbers"), F.array(F.lit(1)))
    return o.select("load_seq", F.array_join(pages, ",").alias("pages"))


def reserved_keys(spark, d):
    from gridloom.functions.parsing import parse_json_object

    r = table(spark, d, "relationships").select("load_seq", M.protect(parse_json_object(F.col("attributes")), ("remarks", "rate")).alias("a"))
    return r.select(F.explode(F.map_keys("a")).alias("attr_name")).groupBy("attr_name").agg(F.count("*").alias("n"))


def chunk_remap(spark, d):
    """Mentions of a document in chunks of ten; every relationship leads to the id of the mention before it."""
    o = table(spark, d, "occurrences").select("document", "occurrence_id", F.regexp_extract("node_id", r"^node_\d+_(.*)$", 1).alias("id"))
    ents = o.select(F.col("document").alias("doc"), (F.col("occurrence_id") % 10).alias("chunk"), "id").distinct()
    rels = o.select(F.col("document").alias("doc"), (F.col("occurrence_id") % 10).alias("chunk"), F.col("id").alias("from_id"), F.col("id").alias("to_id")).unionByName(
        o.select(F.col("document").alias("doc"), F.lit(9).cast("bigint").alias("chunk"), F.col("id").alias("from_id"), F.col("id").alias("to_id"))
    )
    _, out = M.remap_chunks(ents, rels.distinct())
    return out.select("doc", "chunk", "from_id_new", "to_id_new")


def fact_support(spark, d):
    """The documents behind every pair of neighbouring mentions of one name and type."""
    from gridloom.operators.evaluate import relation_facts

    nodes, edges = _graph(spark, d)
    reps = M.representatives(nodes, _clusters(nodes))
    facts = relation_facts(M.merge_edges(edges, reps).select("src", "dst", "relationship_type", F.explode("source_docs").alias("source_doc")))
    return facts.select("a", "b", F.size("documents").cast("bigint").alias("n_docs"))


_NODES = r"""
WITH o AS (SELECT *, regexp_extract(node_id, '^node_\d+_(.*)$', 1) AS id, regexp_extract(node_id, '_([A-Z]+)_\d+$', 1) AS type, row_number() OVER (ORDER BY document, occurrence_id) AS ord FROM occurrences),
n AS (SELECT 'node_' || ord || '_' || id AS node_id, ord, id, type, document, occurrence_id, trim(surface) AS name, page FROM o),
last AS (SELECT document, id, arg_max(node_id, ord) AS node_id FROM n GROUP BY ALL),
nxt AS (SELECT document, occurrence_id, id, lead(id) OVER (PARTITION BY document ORDER BY occurrence_id) AS to_id FROM o),
r AS (SELECT a.node_id AS src, b.node_id AS dst, x.document, x.occurrence_id FROM nxt x JOIN last a ON a.document = x.document AND a.id = x.id JOIN last b ON b.document = x.document AND b.id = x.to_id),
e AS (SELECT src, dst, min(document) AS document, min(occurrence_id) AS oid FROM r GROUP BY ALL),
g AS (SELECT type, lower(name) AS k, min(node_id) AS cluster_id, count(*) AS c FROM n WHERE name <> '' GROUP BY ALL HAVING count(*) > 1),
m AS (SELECT n.*, coalesce(g.cluster_id, n.node_id) AS cluster FROM n LEFT JOIN g ON g.type = n.type AND g.k = lower(n.name)),
rep AS (SELECT *, first_value(node_id) OVER (PARTITION BY cluster ORDER BY ord) AS rep FROM m)
"""

QUERIES = {f.__name__: f for f in (mention_build, edge_collapse, cluster_merge_nodes, cluster_merge_edges, method_report, graph_stats, graph_filter, graph_convert, page_fallback, reserved_keys, chunk_remap, fact_support)}
SQL = {
    "mention_build": _NODES + "SELECT node_id, type, document AS source_doc, coalesce(page::VARCHAR, '') AS pages, 'mention' AS attr_type FROM n",
    "edge_collapse": _NODES + "SELECT src, dst, 'NEXT' AS relationship_type, 'x' AS attr_source_doc FROM e",
    "cluster_merge_nodes": _NODES + """SELECT rep AS node_id, arg_min({'n': name}, ord).n AS name, count(*)::INT AS cluster_size,
       coalesce(string_agg(DISTINCT page::VARCHAR, ',' ORDER BY page::VARCHAR) FILTER (page IS NOT NULL AND false), array_to_string(list_sort(list_distinct(list(page) FILTER (page IS NOT NULL))), ','), '') AS pages,
       count(DISTINCT document) AS n_docs FROM rep GROUP BY rep""",
    "cluster_merge_edges": _NODES + """SELECT a.rep AS src, b.rep AS dst, 'NEXT' AS relationship_type, count(DISTINCT e.document) AS n_docs
       FROM e JOIN rep a ON a.node_id = e.src JOIN rep b ON b.node_id = e.dst WHERE a.rep <> b.rep GROUP BY ALL""",
    "fact_support": _NODES + """SELECT least(a.rep, b.rep) AS a, greatest(a.rep, b.rep) AS b, count(DISTINCT e.document) AS n_docs
       FROM e JOIN rep a ON a.node_id = e.src JOIN rep b ON b.node_id = e.dst WHERE a.rep <> b.rep GROUP BY ALL""",
    "graph_stats": _NODES.replace("WITH o AS", "WITH RECURSIVE o AS", 1) + """, s AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), reach AS (SELECT DISTINCT a AS n, a AS x FROM s UNION SELECT reach.n, s.b FROM reach JOIN s ON s.a = reach.x),
       parts AS (SELECT count(DISTINCT c) AS c, count(*) AS l FROM (SELECT n, min(x) AS c FROM reach GROUP BY n)), k AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges)
       SELECT 'nodes' AS metric, '' AS key, nodes::DOUBLE AS value FROM k UNION ALL SELECT 'edges', '', edges FROM k UNION ALL SELECT 'components', '', c + nodes - l FROM parts, k
       UNION ALL SELECT 'avg_degree', '', round(2 * edges / nodes, 6) FROM k UNION ALL SELECT 'max_degree', '', max(d) FROM (SELECT count(*) AS d FROM (SELECT src AS x FROM e UNION ALL SELECT dst FROM e) GROUP BY x)
       UNION ALL SELECT 'type', type, count(*) FROM n GROUP BY type UNION ALL SELECT 'document', document, count(*) FROM n GROUP BY document UNION ALL SELECT 'relationship', 'NEXT', edges FROM k""",
    "graph_filter": _NODES + """, k AS (SELECT node_id FROM n WHERE type = (SELECT min(type) FROM n)) SELECT node_id AS a, '' AS b FROM k UNION ALL SELECT src, dst FROM e WHERE src IN (SELECT node_id FROM k) AND dst IN (SELECT node_id FROM k)""",
    "graph_convert": _NODES + """, mn AS (SELECT rep, arg_min(coalesce(nullif(name, ''), nullif(id, ''), 'UNKNOWN_ENTITY'), ord) AS name, arg_min(type, ord) AS type, count(*) AS size FROM rep GROUP BY rep),
       mk AS (SELECT rep, upper(trim(name)) || '|' || upper(trim(coalesce(type, 'Unknown'))) AS key FROM mn),
       me AS (SELECT a.rep AS u, b.rep AS v, e.document FROM e JOIN rep a ON a.node_id = e.src JOIN rep b ON b.node_id = e.dst WHERE a.rep <> b.rep),
       dn AS (SELECT DISTINCT document FROM n WHERE trim(document) <> ''), oc AS (SELECT DISTINCT key, trim(document) FROM mk JOIN rep USING (rep) WHERE trim(document) <> ''),
       rl AS (SELECT DISTINCT x.key, y.key AS k2, me.document FROM me JOIN mk x ON x.rep = u JOIN mk y ON y.rep = v)
       SELECT 'documents' AS table_name, count(*) AS n_rows FROM dn UNION ALL SELECT 'entities', count(DISTINCT key) FROM mk UNION ALL SELECT 'relationships', count(DISTINCT (key, k2)) FROM rl
       UNION ALL SELECT 'entity_occurrences', count(*) FROM oc UNION ALL SELECT 'relationship_occurrences', count(*) FROM rl""",
    "method_report": _NODES + """SELECT count(DISTINCT cluster) FILTER (cluster_n > 1) AS clusters_found, count(*) AS nodes_before, count(DISTINCT rep) AS nodes_after,
       round(100.0 * (count(*) - count(DISTINCT rep)) / count(*), 4) AS reduction_pct FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS cluster_n FROM rep)""",
    "page_fallback": r"""SELECT load_seq, CASE WHEN regexp_full_match(trim(page_numbers), '\d+') THEN trim(page_numbers) WHEN regexp_full_match(page_numbers, '\[\d+(, \d+)*\]') THEN replace(trim(page_numbers, '[]'), ' ', '') ELSE '1' END AS pages FROM entity_occurrences""",
    "reserved_keys": """WITH k AS (SELECT unnest(json_keys(attributes)) AS k FROM relationships WHERE json_valid(attributes) AND json_type(attributes) = 'OBJECT')
       SELECT CASE WHEN k IN ('remarks', 'rate') THEN 'attr_' || k ELSE k END AS attr_name, count(*) AS n FROM k GROUP BY 1""",
    "chunk_remap": r"""WITH o AS (SELECT document AS doc, occurrence_id % 10 AS chunk, regexp_extract(node_id, '^node_\d+_(.*)$', 1) AS id FROM occurrences),
       e AS (SELECT DISTINCT doc, chunk, id FROM o), r AS (SELECT DISTINCT doc, chunk, id FROM o UNION SELECT DISTINCT doc, 9, id FROM o),
       x AS (SELECT r.doc, r.chunk, r.id || '_chunk' || max(e.chunk) AS n FROM r JOIN e ON e.doc = r.doc AND e.id = r.id AND e.chunk <= r.chunk GROUP BY r.doc, r.chunk, r.id)
       SELECT doc, chunk, n AS from_id_new, n AS to_id_new FROM x""",
}
