"""Queries on entity resolution. Mentions are the entities of the store, or the surfaces of occurrences by type."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions.similarity import cosine, jaro_winkler_similarity, ratio
from gridloom.operators import resolve, store
from gridloom.queries.store_queries import STORE_SQL
from gridloom.queries.text_queries import norm_sql
from gridloom.session import table


def surfaces(spark, d):
    """(node_id, type, name): one mention per occurrence."""
    o = table(spark, d, "occurrences")
    return o.select("node_id", F.regexp_extract("node_id", r"_([A-Z]+)_\d+$", 1).alias("type"), F.trim("surface").alias("name"))


def entity_records(spark, d):
    """(node_id, type, name and every attribute that a resolver compares) of the entities of the store."""
    e = store.open_store(spark, d).entities
    fields = [f for f in dict.fromkeys((*resolve.TEXT_ATTRIBUTES, *resolve.EXACT_ATTRIBUTES, "address"))]
    return e.select(F.col("unique_entity_id").alias("node_id"), F.col("entity_type").alias("type"), F.col("canonical_name").alias("name"), *[F.get_json_object("attributes", f"$.{f}").alias(f) for f in fields])


def entity_edges(spark, d):
    r = store.open_store(spark, d).relationships
    return r.select(F.col("from_entity_id").alias("src"), F.col("to_entity_id").alias("dst"))


def exact_clusters(spark, d):
    return resolve.exact_clusters(surfaces(spark, d))


def exact_clusters_by_type(spark, d):
    return resolve.exact_clusters(surfaces(spark, d), keys=("type",))


def fuzzy_pairs(spark, d):
    """Links of different spellings, and every spelling's members to one of them."""
    return resolve.fuzzy_links(surfaces(spark, d)).select("a", "b").distinct()


def fuzzy_clusters(spark, d):
    return resolve.fuzzy_clusters(surfaces(spark, d))


def fuzzy_baseline(spark, d):
    return resolve.fuzzy_clusters(surfaces(spark, d), by_type=False)


def closure_pairs(spark, d):
    out = resolve.closure_links(entity_records(spark, d), text=resolve.TEXT_ATTRIBUTES, exact=resolve.EXACT_ATTRIBUTES)
    return out.select("a", "b", F.round("score", 6).alias("score"))


def closure_clusters(spark, d):
    return resolve.closure_clusters(entity_records(spark, d), text=resolve.TEXT_ATTRIBUTES, exact=resolve.EXACT_ATTRIBUTES)


def topological_clusters(spark, d):
    """Entities by the documents that mention them and the words of their names."""
    nodes = entity_records(spark, d).select("node_id", "type", "name")
    cited = store.open_store(spark, d).occurrences.select(F.col("entity_id").alias("src"), F.col("document_id").alias("dst"))
    return resolve.topological_clusters(nodes, cited)


def name_jaccard_clusters(spark, d):
    nodes = surfaces(spark, d).select("node_id", F.col("type").alias("kind"), "name").where("name is not null")
    return resolve.clusters_of(resolve.name_links(nodes, 0.7).select("a", "b"))


def jaro_winkler_pairs(spark, d):
    """Names of persons and companies that share their type and first letters, by Jaro-Winkler."""
    e = entity_records(spark, d).select("node_id", "type", F.lower("name").alias("name"), F.substring(F.lower("name"), 1, 3).alias("k"))
    p = e.withColumnRenamed("node_id", "a").withColumnRenamed("name", "x").join(e.withColumnRenamed("node_id", "b").withColumnRenamed("name", "y"), ["type", "k"]).where("a < b")
    return p.select("a", "b", F.round(jaro_winkler_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


def indel_ratios(spark, d):
    """Every resolved surface against the name of its entity."""
    e = entity_records(spark, d).select(F.col("node_id").alias("entity_id"), F.col("name").alias("known"))
    o = table(spark, d, "occurrences").where("surface is not null").join(e, "entity_id")
    return o.select("occurrence_id", F.round(ratio(F.lower("surface"), F.lower("known")), 6).alias("ratio"))


#: The columns compared where the records have them.
_FUZZY = {"name": (0.7, 0.9), "role": (0.7, 0.9), "company": (0.7, 0.9), "address": (0.7, 0.85)}
_EXACT = ("email", "phone", "din", "pan")


def _blocked(spark, d):
    r = entity_records(spark, d).withColumn("name", F.lower("name"))
    there = r.agg(*[F.count(c).alias(c) for c in (*_FUZZY, *_EXACT)]).first().asDict()
    fuzzy, exact = {c: t for c, t in _FUZZY.items() if there[c]}, tuple(c for c in _EXACT if there[c])
    rules = [[F.col("type"), F.nullif(F.substring("name", 1, 4), F.lit(""))], [F.col("din")]]
    return r, rules, fuzzy, exact


def fs_pattern_counts(spark, d):
    r, rules, fuzzy, exact = _blocked(spark, d)
    pairs = resolve.blocked_pairs(r, rules, [*fuzzy, *exact])
    return resolve.pattern_counts(pairs, resolve.comparison_levels("l", "r", fuzzy, exact))


def fs_matches(spark, d):
    """Every pair of one type, and the pairs of one din across types."""
    r, rules, fuzzy, exact = _blocked(spark, d)
    return resolve.linked_by_type(r, fuzzy, exact, F.col("type"), 0.8, rules=rules[1:]).select("l_id", "r_id", F.round("match_probability", 4).alias("match_probability"))


def _vectors(spark, d):
    """One usable vector per entity."""
    v = table(spark, d, "entity_vectors").where((F.size("vector") == 64) & F.exists("vector", lambda x: x != 0))
    return v.groupBy(F.col("sql_id").alias("node_id")).agg(F.min("vector").alias("vector"))


def semantic_pairs(spark, d):
    p = resolve.semantic_pairs(_vectors(spark, d), threshold=0.9, top_k=20)
    return p.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.round("score", 4).alias("score")).distinct()


def semantic_clusters(spark, d):
    return resolve.semantic_clusters(_vectors(spark, d), threshold=0.9)


def connected_components(spark, d):
    from gridloom.operators.components import connected_components as cc

    p = table(spark, d, "match_pairs").where("match_probability >= 0.9")
    return cc(p, "node_id_l", "node_id_r")


def merge_groups(spark, d):
    """Match pairs as overlapping groups of two."""
    p = table(spark, d, "match_pairs").where("match_probability >= 0.9")
    g = p.select(F.format_string("%08d", "pair_id").alias("group_id"), F.explode(F.array("node_id_l", "node_id_r")).alias("node_id"), F.concat(F.lit("pair "), F.col("pair_id").cast("string")).alias("reasoning"))
    return resolve.merge_groups(g)


def _closure(edges: str, nodes: str) -> str:
    """Components of a links CTE (a, b) as further CTEs; ends in (node_id, cluster_id)."""
    return f""", s AS (SELECT a, b FROM {edges} UNION SELECT b, a FROM {edges}),
 reach AS (SELECT DISTINCT a AS node_id, a AS x FROM s UNION SELECT reach.node_id, s.b FROM reach JOIN s ON s.a = reach.x)
 SELECT node_id, min(x) AS {nodes} FROM reach GROUP BY node_id HAVING count(*) > 1"""


_SURF = rf"WITH RECURSIVE m AS (SELECT node_id, regexp_extract(node_id, '_([A-Z]+)_\d+$', 1) AS type, {norm_sql('surface')} AS norm, trim(surface) AS name FROM occurrences)"
_SEM = """v AS (SELECT sql_id AS id, any_value(vector::DOUBLE[]) AS x FROM entity_vectors WHERE len(vector) = 64 AND list_dot_product(vector::DOUBLE[], vector::DOUBLE[]) > 0 GROUP BY sql_id),
 n AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.x, b.x) AS s, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.x, b.x) DESC, b.id) AS k FROM v a CROSS JOIN v b)"""
_RECURSIVE_STORE = STORE_SQL.replace("WITH docs", "WITH RECURSIVE docs", 1)
_REC = _RECURSIVE_STORE + """, e AS (SELECT unique_entity_id AS node_id, entity_type AS type, lower(canonical_name) AS name FROM ents)
"""

QUERIES = {f.__name__: f for f in (
    exact_clusters, exact_clusters_by_type, fuzzy_pairs, fuzzy_clusters, fuzzy_baseline, closure_pairs, closure_clusters, topological_clusters, name_jaccard_clusters,
    jaro_winkler_pairs, indel_ratios, fs_pattern_counts, fs_matches, semantic_pairs, semantic_clusters, connected_components, merge_groups)}
SQL = {
    "exact_clusters": _SURF + " SELECT node_id, min(node_id) OVER (PARTITION BY norm) AS cluster_id FROM m WHERE norm <> '' QUALIFY count(*) OVER (PARTITION BY norm) > 1",
    "exact_clusters_by_type": _SURF + " SELECT node_id, min(node_id) OVER (PARTITION BY norm, type) AS cluster_id FROM m WHERE norm <> '' QUALIFY count(*) OVER (PARTITION BY norm, type) > 1",
    "topological_clusters": _REC + """, w AS (SELECT *, list_distinct(list_filter(regexp_split_to_array(name, '\\s+'), lambda t: t <> '')) AS ws FROM e),
 n0 AS (SELECT DISTINCT entity_id AS i, document_id AS j FROM occs), n AS (SELECT i, list(j) AS ns FROM n0 GROUP BY i),
 x AS (SELECT w.*, coalesce(ns, []) AS ns FROM w LEFT JOIN n ON n.i = w.node_id),
 p AS (SELECT a.node_id AS a, b.node_id AS b, len(a.ns) + len(b.ns) AS deg, len(list_intersect(a.ns, b.ns)) AS ni, len(list_distinct(list_concat(a.ns, b.ns))) AS nu,
   CASE WHEN len(a.ws) > 0 AND len(b.ws) > 0 THEN len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) ELSE 0 END AS tj FROM x a JOIN x b ON a.type = b.type AND a.node_id < b.node_id),
 l AS (SELECT a, b FROM p WHERE (deg = 0 AND tj >= 0.7 - 1e-9) OR (deg > 0 AND 0.7 * ni / nu + 0.3 * tj >= 0.7 - 1e-9))""".replace("\\\\s", "\\s") + _closure("l", "cluster_id"),
    "jaro_winkler_pairs": _REC + """SELECT a.node_id AS a, b.node_id AS b, round(jaro_winkler_similarity(a.name, b.name), 6) AS similarity FROM e a JOIN e b ON a.type = b.type AND a.name[1:3] = b.name[1:3] AND a.node_id < b.node_id""",
    "semantic_pairs": "WITH " + _SEM + """
 SELECT DISTINCT least(a, b) AS a, greatest(a, b) AS b, round(s, 4) AS score FROM n WHERE k <= 20 AND s >= 0.9 AND a <> b""",
    "semantic_clusters": "WITH RECURSIVE " + _SEM + ", l AS (SELECT a, b FROM n WHERE k <= 20 AND s >= 0.9 AND a <> b)" + _closure("l", "cluster_id"),
    "name_jaccard_clusters": _SURF + """, w AS (SELECT type, node_id, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(name), '\\s+'), lambda t: t <> ''))) AS ws FROM m WHERE name IS NOT NULL),
 g AS (SELECT type, ws, min(node_id) AS low, list(node_id) AS ids FROM w WHERE len(ws) > 0 GROUP BY ALL),
 l AS (SELECT low AS a, unnest(ids) AS b FROM g UNION SELECT x.low, y.low FROM g x JOIN g y ON x.type = y.type AND x.low < y.low AND len(list_intersect(x.ws, y.ws)) >= (0.7 - 1e-9) * len(list_distinct(list_concat(x.ws, y.ws))))""" + _closure("(SELECT * FROM l WHERE a <> b)", "cluster_id"),
    "connected_components": "WITH RECURSIVE l AS (SELECT DISTINCT node_id_l AS a, node_id_r AS b FROM match_pairs WHERE match_probability >= 0.9 AND node_id_l <> node_id_r)" + _closure("l", "component").replace("SELECT node_id,", "SELECT node_id AS node,"),
    "merge_groups": "WITH RECURSIVE l AS (SELECT DISTINCT node_id_l AS a, node_id_r AS b FROM match_pairs WHERE match_probability >= 0.9 AND node_id_l <> node_id_r)"
    + _closure("l", "c").replace(" SELECT node_id, min(x) AS c FROM reach GROUP BY node_id HAVING count(*) > 1", """, c AS (SELECT node_id, min(x) AS c FROM reach GROUP BY node_id),
      w AS (SELECT c, min(pair_id) AS p FROM match_pairs JOIN c ON node_id = node_id_l WHERE match_probability >= 0.9 AND node_id_l <> node_id_r GROUP BY c)
      SELECT dense_rank() OVER (ORDER BY c) AS group_no, node_id, 'pair ' || p AS reasoning FROM c JOIN w USING (c)"""),
    "fs_pattern_counts": _RECURSIVE_STORE + """, e AS (SELECT unique_entity_id AS node_id, entity_type AS type, lower(coalesce(canonical_name, '')) AS name,
   CASE WHEN json_valid(attributes) THEN coalesce(json_extract_string(attributes, '$.role'), '') ELSE '' END AS role, CASE WHEN json_valid(attributes) THEN coalesce(json_extract_string(attributes, '$.address'), '') ELSE '' END AS address, CASE WHEN json_valid(attributes) THEN json_extract_string(attributes, '$.din') END AS din FROM ents),
 p AS (SELECT a.name AS x, b.name AS y, a.role AS p, b.role AS q, a.address AS v, b.address AS w, coalesce(a.din, '') AS d, coalesce(b.din, '') AS f FROM e a JOIN e b ON a.node_id < b.node_id AND ((a.type = b.type AND a.name[1:4] = b.name[1:4]) OR a.din = b.din)),
 g AS (SELECT CASE WHEN x = '' OR y = '' THEN -1 WHEN x = y THEN 3 WHEN jaro_winkler_similarity(x, y) >= 0.9 THEN 2 WHEN jaro_winkler_similarity(x, y) >= 0.7 THEN 1 ELSE 0 END AS g0,
   CASE WHEN p = '' OR q = '' THEN -1 WHEN p = q THEN 3 WHEN jaro_winkler_similarity(p, q) >= 0.9 THEN 2 WHEN jaro_winkler_similarity(p, q) >= 0.7 THEN 1 ELSE 0 END AS g1,
   CASE WHEN v = '' OR w = '' THEN -1 WHEN v = w THEN 3 WHEN jaro_winkler_similarity(v, w) >= 0.85 THEN 2 WHEN jaro_winkler_similarity(v, w) >= 0.7 THEN 1 ELSE 0 END AS g2,
   CASE WHEN d = '' OR f = '' THEN -1 WHEN d = f THEN 1 ELSE 0 END AS g3 FROM p)
 SELECT g0, g1, g2, g3, count(*) AS n_pairs FROM g GROUP BY ALL""",
}
