"""Queries on graph metrics and communities, over the relationships of the store."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from gridloom.operators import communities, graph, store
from gridloom.plans import pipeline
from gridloom.queries.store_queries import MEMBERS_SQL, STORE_SQL, rule_members
from gridloom.session import Stage, shared_dir


def _graph(spark, d):
    s = store.open_store(spark, d)
    nodes = s.entities.select(F.col("unique_entity_id").alias("node_id"))
    edges = s.relationships.select(F.col("from_entity_id").alias("src"), F.col("to_entity_id").alias("dst"))
    return s, nodes, edges


def density_degree(spark, d):
    _, nodes, edges = _graph(spark, d)
    return graph.sizes(nodes, edges)


def avg_clustering(spark, d):
    _, nodes, edges = _graph(spark, d)
    return graph.metrics(nodes, edges).select("avg_clustering", "components")


def triangle_counts(spark, d):
    _, _, edges = _graph(spark, d)
    return graph.triangles(edges)


def resolution_tuning(spark, d):
    _, nodes, edges = _graph(spark, d)
    return graph.resolutions(graph.sizes(nodes, edges).join(graph.clustering(nodes, edges)))


def recompute_decision(spark, d):
    """The graph now against itself with a tenth and a twelfth less."""
    _, nodes, edges = _graph(spark, d)
    now = graph.sizes(nodes, edges).select("n_nodes", "n_edges")
    out = None
    for name, k in (("same", 1.0), ("smaller", 0.8), ("none", None)):
        last = now.select((F.col("n_nodes") * F.lit(k)).alias("n_nodes"), (F.col("n_edges") * F.lit(k)).alias("n_edges"))
        r = graph.must_recompute(now, last).select(F.lit(name).alias("last_run"), "recompute")
        out = r if out is None else out.unionByName(r)
    return out


def graph_summary(spark, d):
    _, nodes, edges = _graph(spark, d)
    return graph.summary_text(graph.sizes(nodes, edges).join(graph.component_count(nodes, edges)))


def modularity(spark, d):
    s, _, edges = _graph(spark, d)
    m = rule_members(s.entities).where("level = 'macro'").select(F.col("entity_id").alias("node_id"), F.col("community_id").alias("community"))
    return graph.modularity(edges, m)


def pagerank(spark, d):
    _, nodes, edges = _graph(spark, d)
    return graph.page_rank(nodes, edges).select("node_id", F.round("rank", 6).alias("rank"))


def leiden_communities(spark, d):
    _, nodes, edges = _graph(spark, d)
    return communities.detect(nodes, edges, 1.0)


def leiden_quality(spark, d):
    """Entities, those that are in exactly one community, and whether the partition found is better than the rule's."""
    s, nodes, edges = _graph(spark, d)
    found = Stage(communities.detect(nodes, edges, 1.0), "found").df
    rule = rule_members(s.entities).where("level = 'macro'").select(F.col("entity_id").alias("node_id"), F.col("community_id").alias("community"))
    each = found.groupBy("node_id").agg(F.countDistinct("community").alias("k")).agg(F.count("*").alias("n_entities"), F.sum((F.col("k") == 1).cast("bigint")).alias("n_in_one"))
    return each.join(graph.modularity(edges, found).withColumnRenamed("modularity", "q")).join(graph.modularity(edges, rule)).select("n_entities", "n_in_one", (F.col("q") > F.col("modularity")).alias("better"))


def _led_by(pdf):
    """A stand-in for a language model: the sentence it is asked for."""
    return [p.replace("Summarise", "This is") for p in pdf["prompt"]]


def community_run(spark, d):
    """The whole run on the store: what each level holds, whether every community has its summary, and that a second run is not needed."""
    s, nodes, edges = _graph(spark, d)
    path = f"{shared_dir(spark)}/gridloom/run-{uuid.uuid4().hex}"
    names = s.entities.select(F.col("unique_entity_id").alias("entity_id"), "canonical_name")
    nodes, edges = Stage(nodes, "nodes").df, Stage(edges, "edges").df
    out = pipeline.community_run(nodes, edges, names, path, _led_by)
    again = pipeline.community_run(nodes, edges, names, path, _led_by)
    m = out["communities"].withColumn("community_key", F.concat_ws("_", "level", "community"))
    told = m.join(out["community_summaries"].withColumn("told", F.lit(1)), "community_key", "left")
    return told.groupBy("level").agg(F.count("*").alias("n_members"), F.count("told").alias("n_told"), F.countDistinct("entity_id").alias("n_entities")).withColumn("again", F.lit(again is not None))


def community_stats(spark, d):
    s, _, edges = _graph(spark, d)
    names = s.entities.select(F.col("unique_entity_id").alias("entity_id"), "canonical_name")
    return graph.community_stats(edges, rule_members(s.entities), names).drop("top_entities")


def community_top(spark, d):
    s, _, edges = _graph(spark, d)
    names = s.entities.select(F.col("unique_entity_id").alias("entity_id"), "canonical_name")
    return graph.community_stats(edges, rule_members(s.entities), names).select("level", "community_id", "top_entities")


def community_levels(spark, d):
    s, _, _ = _graph(spark, d)
    return rule_members(s.entities).groupBy("level").agg(F.countDistinct("community_id").alias("n_communities"))


def summary_batches(spark, d):
    s, _, _ = _graph(spark, d)
    total = rule_members(s.entities).agg(F.countDistinct(F.concat_ws("|", "level", F.col("community_id").cast("string"))).alias("n"))
    n = total.first()[0]
    return spark.createDataFrame([(n, graph.batch_size(n))], "communities bigint, batch_size bigint")


_SIMPLE = STORE_SQL + """, u AS (SELECT DISTINCT least(from_entity_id, to_entity_id) AS a, greatest(from_entity_id, to_entity_id) AS b FROM rels WHERE from_entity_id <> to_entity_id),
 dg AS (SELECT n, count(*) AS degree FROM (SELECT a AS n FROM u UNION ALL SELECT b FROM u) GROUP BY n),
 tri AS (SELECT x.a AS p, x.b AS q, y.b AS r FROM u x JOIN u y ON x.b = y.a JOIN u z ON z.a = x.a AND z.b = y.b),
 tc AS (SELECT n, count(*) AS t FROM (SELECT p AS n FROM tri UNION ALL SELECT q FROM tri UNION ALL SELECT r FROM tri) GROUP BY n)
"""
_RECURSIVE = _SIMPLE.replace("WITH docs", "WITH RECURSIVE docs", 1) + """, s AS (SELECT a, b FROM u UNION ALL SELECT b, a FROM u),
 reach AS (SELECT unique_entity_id AS n, unique_entity_id AS x FROM ents UNION SELECT reach.n, s.b FROM reach JOIN s ON s.a = reach.x)
"""
#: Rounds of the plain recursion in SQL, by which ranks stand still at the digits compared.
ROUNDS = 80
_ONE = "(SELECT count(*) FROM ents) AS n_nodes, (SELECT count(*) FROM rels) AS n_edges"

QUERIES = {f.__name__: f for f in (
    density_degree, avg_clustering, triangle_counts, resolution_tuning, recompute_decision, graph_summary, modularity, pagerank, leiden_communities, leiden_quality, community_run, community_stats,
    community_top, community_levels, summary_batches)}
SQL = {
    "density_degree": STORE_SQL + f"SELECT n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1)), 8) AS density, round(n_edges / n_nodes, 6) AS avg_degree, round(n_nodes / n_edges, 6) AS entity_relationship_ratio FROM (SELECT {_ONE})",
    "triangle_counts": _SIMPLE + "SELECT dg.n AS node_id, degree, coalesce(t, 0) AS triangles FROM dg LEFT JOIN tc ON tc.n = dg.n",
    "avg_clustering": _RECURSIVE + """SELECT round((SELECT sum(CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END) FROM dg LEFT JOIN tc ON tc.n = dg.n) / (SELECT count(*) FROM ents), 6) AS avg_clustering,
       (SELECT count(DISTINCT m) FROM (SELECT n, min(x) AS m FROM reach GROUP BY n)) AS components""",
    "resolution_tuning": _SIMPLE + f""", g AS (SELECT n_edges / (n_nodes * (n_nodes - 1)) AS den, n_edges / n_nodes AS deg FROM (SELECT {_ONE})),
       c AS (SELECT (SELECT sum(CASE WHEN degree > 1 THEN 2.0 * coalesce(t, 0) / (degree * (degree - 1)) ELSE 0 END) FROM dg LEFT JOIN tc ON tc.n = dg.n) / (SELECT count(*) FROM ents) AS cl)
       SELECT round(CASE WHEN den > 0.1 OR deg > 20 THEN 2.0 WHEN den > 0.01 OR deg > 5 THEN 1.5 ELSE 1.0 END * CASE WHEN cl > 0.5 THEN 1.2 ELSE 1 END, 4)::DOUBLE AS micro,
         round(CASE WHEN den > 0.1 OR deg > 20 THEN 1.2 WHEN den > 0.01 OR deg > 5 THEN 1.0 ELSE 0.7 END * CASE WHEN cl > 0.5 THEN 1.1 ELSE 1 END, 4)::DOUBLE AS meso,
         (CASE WHEN den > 0.1 OR deg > 20 THEN 0.5 WHEN den > 0.01 OR deg > 5 THEN 0.3 ELSE 0.1 END)::DOUBLE AS macro FROM g, c""",
    "graph_summary": _RECURSIVE + f"""SELECT printf('entities %d, relationships %d, density %.6f, average degree %.2f, components %d', n_nodes, n_edges, round(n_edges / (n_nodes * (n_nodes - 1)), 8), round(n_edges / n_nodes, 6),
       (SELECT count(DISTINCT m) FROM (SELECT n, min(x) AS m FROM reach GROUP BY n))) AS summary FROM (SELECT {_ONE})""",
    "recompute_decision": "SELECT * FROM (VALUES ('same', false), ('smaller', true), ('none', true)) v(last_run, recompute)",
    "leiden_quality": STORE_SQL + "SELECT count(*) AS n_entities, count(*) AS n_in_one, true AS better FROM ents",
    "community_run": STORE_SQL + "SELECT level, n AS n_members, n AS n_told, n AS n_entities, false AS again FROM (SELECT count(*) AS n FROM ents), (VALUES ('micro'), ('meso'), ('macro')) v(level)",
    "modularity": MEMBERS_SQL + """, u AS (SELECT DISTINCT least(from_entity_id, to_entity_id) AS a, greatest(from_entity_id, to_entity_id) AS b FROM rels WHERE from_entity_id <> to_entity_id),
       e AS (SELECT x.community_id AS ca, y.community_id AS cb FROM u JOIN members x ON x.entity_id = a AND x.level = 'macro' JOIN members y ON y.entity_id = b AND y.level = 'macro'),
       d AS (SELECT c, count(*) AS d FROM (SELECT ca AS c FROM e UNION ALL SELECT cb FROM e) GROUP BY c), l AS (SELECT ca AS c, count(*) AS l FROM e WHERE ca = cb GROUP BY ca), m AS (SELECT count(*) AS m FROM e)
       SELECT round(sum(coalesce(l, 0) / m - (d / (2 * m)) ** 2), 6) AS modularity FROM d LEFT JOIN l USING (c), m""",
    "community_stats": MEMBERS_SQL + """, r AS (SELECT a.level, a.community_id, count(*) AS n FROM rels JOIN members a ON a.entity_id = from_entity_id JOIN members b ON b.entity_id = to_entity_id AND a.level = b.level AND a.community_id = b.community_id GROUP BY ALL),
       c AS (SELECT level, community_id, count(*) AS k FROM members GROUP BY ALL)
       SELECT c.level, c.community_id, k AS entity_count, coalesce(n, 0) AS relationship_count, CASE WHEN k > 1 THEN round(coalesce(n, 0) / (k * (k - 1) / 2), 6) ELSE 0 END AS density FROM c LEFT JOIN r ON r.level = c.level AND r.community_id = c.community_id""",
    "community_top": MEMBERS_SQL + """, i AS (SELECT a.level, a.community_id, from_entity_id AS f, to_entity_id AS t FROM rels JOIN members a ON a.entity_id = from_entity_id JOIN members b ON b.entity_id = to_entity_id AND a.level = b.level AND a.community_id = b.community_id),
       dg AS (SELECT level, community_id, e, count(*) AS d FROM (SELECT level, community_id, f AS e FROM i UNION ALL SELECT level, community_id, t FROM i) GROUP BY ALL),
       r AS (SELECT m.level, m.community_id, canonical_name, row_number() OVER (PARTITION BY m.level, m.community_id ORDER BY coalesce(d, 0) DESC, m.entity_id) AS k FROM members m LEFT JOIN dg ON dg.level = m.level AND dg.community_id = m.community_id AND dg.e = m.entity_id
         JOIN ents ON unique_entity_id = m.entity_id)
       SELECT level, community_id, string_agg(canonical_name, '; ' ORDER BY k) AS top_entities FROM r WHERE k <= 5 GROUP BY ALL""",
    "community_levels": MEMBERS_SQL + "SELECT level, count(DISTINCT community_id) AS n_communities FROM members GROUP BY level",
    "summary_batches": MEMBERS_SQL + "SELECT n AS communities, greatest(1, least(ceil(n / 10), 25))::BIGINT AS batch_size FROM (SELECT count(DISTINCT level || '|' || community_id) AS n FROM members)",
    "pagerank": STORE_SQL.replace("WITH docs", "WITH RECURSIVE docs", 1) + """, l AS (SELECT DISTINCT from_entity_id AS src, to_entity_id AS dst FROM rels WHERE from_entity_id <> to_entity_id), k AS (SELECT src, count(*) AS k FROM l GROUP BY src),
       c AS (SELECT count(*) AS n FROM ents)""" + "".join(f""",
       r{i} AS MATERIALIZED (SELECT e.unique_entity_id AS id, {'1.0::DOUBLE / n' if i == 0 else f'0.15 / n + 0.85 * (coalesce(got, 0) + coalesce(loose, 0) / n)'} AS rank FROM ents e, c""" + ("" if i == 0 else f"""
         CROSS JOIN (SELECT sum(rank) AS loose FROM r{i-1} LEFT JOIN k ON k.src = id WHERE k IS NULL) z LEFT JOIN (SELECT dst, sum(rank / k) AS got FROM l JOIN k USING (src) JOIN r{i-1} ON id = src GROUP BY dst) g ON g.dst = e.unique_entity_id""") + ")" for i in range(ROUNDS + 1)) + f" SELECT id AS node_id, round(rank, 6) AS rank FROM r{ROUNDS}",
}
