"""Queries on evaluation: clusterings of mentions against their resolved entities, aliases, answers and coverage."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import evaluate
from gridloom.operators.components import connected_components
from gridloom.queries.text_queries import norm_sql
from gridloom.session import table


def _gold(spark, d):
    return table(spark, d, "occurrences").where("entity_id is not null").select(F.col("node_id").alias("item"), F.col("entity_id").alias("label"))


def _predicted(spark, d):
    pairs = table(spark, d, "match_pairs").where("match_probability >= 0.9")
    clusters = connected_components(pairs, "node_id_l", "node_id_r").select(F.col("node").alias("node_id"), F.col("component").alias("cluster_id"))
    return evaluate.labels(_gold(spark, d), clusters)


def pairwise_f1(spark, d):
    return evaluate.pairwise_scores(_predicted(spark, d), _gold(spark, d))


def method_scores(spark, d):
    """The exact method and a model-assisted one (a stand-in that groups equal names) on the resolved mentions, against their entities."""
    from gridloom.operators.resolve import resolvers
    from gridloom.plans.pipeline import score_methods

    o = table(spark, d, "occurrences").where("entity_id is not null")
    mentions = o.select("node_id", F.lit("Mention").alias("type"), F.trim("surface").alias("name"), F.col("occurrence_id").alias("ord"))
    methods = resolvers(lambda pdf: [list(g) for _, g in pdf.dropna(subset=["name"]).groupby("name")["node_id"] if len(g) > 1])
    out = score_methods({k: methods[k] for k in ("exact", "model")}, mentions, None, _gold(spark, d))
    # what a model finds depends on its batches; that it links nothing wrongly which the names do not
    return out.select("method", "gold_pairs", F.when(F.col("method") == "exact", F.col("shared_pairs")).alias("shared_pairs"), F.when(F.col("method") == "exact", F.col("predicted_pairs")).alias("predicted_pairs"))


def purity(spark, d):
    return evaluate.purity(_predicted(spark, d), _gold(spark, d))


def _aliases(spark, d):
    e = table(spark, d, "entities")
    return e.select(F.col("unique_entity_id").alias("entity"), F.explode("aliases").alias("alias")).unionByName(e.select(F.col("unique_entity_id").alias("entity"), F.col("canonical_name").alias("alias")))


def alias_index(spark, d):
    return evaluate.alias_index(_aliases(spark, d))


def _texts(spark, d):
    return table(spark, d, "occurrences").select(F.col("occurrence_id").alias("id"), F.col("surface").alias("text"))


def recognise(spark, d):
    r = evaluate.recognise(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), alias_index(spark, d))
    return r.select(F.col("id").alias("doc_id"), F.array_join("entities", ",").alias("entities"))


def align_surfaces(spark, d):
    return evaluate.align(_texts(spark, d), alias_index(spark, d)).select(F.col("id").alias("occurrence_id"), "entity")


def set_f1(spark, d):
    """Documents of the two most recent rows of an entity, as sets."""
    from gridloom.functions.text import set_f1 as f1

    e = table(spark, d, "entities").select("load_seq", F.split(F.lower("canonical_name"), " ").alias("a"), F.split(F.lower(F.element_at(F.coalesce(F.nullif(F.col("aliases"), F.array().cast("array<string>")), F.array("canonical_name")), 1)), " ").alias("b"))
    return e.select("load_seq", F.round(f1(F.col("a"), F.col("b")), 6).alias("f1"))


def context_coverage(spark, d):
    """Per scanned document: how many of its mentioned entities the store's occurrences cite for it."""
    o = table(spark, d, "occurrences").where("entity_id is not null")
    docs = table(spark, d, "source_documents").select("document_id", F.col("document_name").alias("document")).distinct()
    seen = table(spark, d, "entity_occurrences").join(docs, "document_id").select(F.col("document").alias("id"), F.col("entity_id").alias("entity"))
    return evaluate.context_coverage(seen, o.select(F.col("document").alias("id"), F.col("entity_id").alias("entity")))


def path_hits(spark, d):
    """Pairs of mentions matched with certainty, against the pairs scored at least 0.8."""
    p = table(spark, d, "match_pairs").where("node_id_l <> node_id_r")
    edges = p.where("match_probability >= 0.8").select((F.col("pair_id") % 50).alias("id"), F.col("node_id_l").alias("a"), F.col("node_id_r").alias("b"))
    paths = p.select((F.col("pair_id") % 50).alias("id"), (F.col("pair_id") % 400).alias("alternative"), F.col("node_id_l").alias("a"), F.col("node_id_r").alias("b"))
    return evaluate.path_hit(edges, paths)


def _scores(spark, d):
    e = table(spark, d, "events")
    return e.select((F.col("event_id") % 997).alias("id"), F.col("event_type").alias("system"), (F.col("user_id") % 7).cast("string").alias("kind"), "value").groupBy("id", "system").agg(F.min("kind").alias("kind"), F.avg("value").alias("score"))


def by_type_means(spark, d):
    return evaluate.means(evaluate.complete_questions(_scores(spark, d)), [["system"], ["system", "kind"]])


def question_order(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("type"))
    return evaluate.question_order(e)


def answer_scores(spark, d):
    """Surfaces as answers to the question for their entity, by kind of answer."""
    e = table(spark, d, "entities").groupBy(F.col("unique_entity_id").alias("entity_id")).agg(F.max_by("canonical_name", "load_seq").alias("gold"))
    o = table(spark, d, "occurrences").where("surface is not null").join(e, "entity_id")
    kind = F.element_at(F.array(F.lit("string"), F.lit("number"), F.lit("yes_no")), (F.col("occurrence_id") % 3 + 1).cast("int"))
    gold = F.when(kind == "number", F.col("occurrence_id").cast("string")).when(kind == "yes_no", "yes").otherwise(F.col("gold"))
    answer = F.when(kind == "number", F.concat(F.lit("about "), F.col("occurrence_id").cast("string"), F.lit(" units"))).when(kind == "yes_no", F.concat(F.lit("Yes, "), F.col("surface"))).otherwise(F.col("surface"))
    none = F.array().cast("array<string>")
    return o.select("occurrence_id", kind.alias("kind"), evaluate.answer_score(kind, answer, gold, none, none).alias("score"))


_G = "g AS (SELECT node_id AS item, entity_id AS label FROM occurrences WHERE entity_id IS NOT NULL)"
_P = f"""WITH RECURSIVE l AS (SELECT DISTINCT node_id_l AS a, node_id_r AS b FROM match_pairs WHERE match_probability >= 0.9 AND node_id_l <> node_id_r), s AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
 reach AS (SELECT DISTINCT a AS n, a AS x FROM s UNION SELECT reach.n, s.b FROM reach JOIN s ON s.a = reach.x), c AS (SELECT n, min(x) AS c FROM reach GROUP BY n), {_G},
 b AS (SELECT item, label AS g, coalesce('c:' || c, 'i:' || item) AS p FROM g LEFT JOIN c ON c.n = item)
"""
_AL = f"""WITH a0 AS (SELECT unique_entity_id AS entity, unnest(aliases) AS alias FROM entities UNION ALL SELECT unique_entity_id, canonical_name FROM entities), a1 AS (SELECT entity, {norm_sql('alias')} AS alias FROM a0),
 idx AS (SELECT alias, min(entity) AS entity FROM a1 WHERE alias <> '' GROUP BY alias HAVING count(DISTINCT entity) = 1)
"""

QUERIES = {f.__name__: f for f in (pairwise_f1, method_scores, purity, alias_index, recognise, align_surfaces, set_f1, context_coverage, path_hits, by_type_means, question_order, answer_scores)}
SQL = {
    "pairwise_f1": _P + """, t AS (SELECT (SELECT coalesce(sum(n * (n - 1) / 2), 0) FROM (SELECT count(*) AS n FROM b GROUP BY p))::BIGINT AS pp, (SELECT coalesce(sum(n * (n - 1) / 2), 0) FROM (SELECT count(*) AS n FROM b GROUP BY g))::BIGINT AS gp,
       (SELECT coalesce(sum(n * (n - 1) / 2), 0) FROM (SELECT count(*) AS n FROM b GROUP BY p, g))::BIGINT AS sp)
       SELECT pp AS predicted_pairs, gp AS gold_pairs, sp AS shared_pairs, round(sp / nullif(pp, 0), 6) AS precision, round(sp / nullif(gp, 0), 6) AS recall, CASE WHEN sp > 0 THEN round(2 * (sp / pp) * (sp / gp) / (sp / pp + sp / gp), 6) ELSE 0 END AS f1 FROM t""",
    "method_scores": f"""WITH {_G}, x AS (SELECT o.node_id AS item, o.entity_id AS g, coalesce(nullif({norm_sql('o.surface')}, ''), 'i:' || o.node_id) AS p FROM occurrences o WHERE entity_id IS NOT NULL),
       t AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM x GROUP BY p))::BIGINT AS pp, (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM x GROUP BY g))::BIGINT AS gp,
       (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM x GROUP BY p, g))::BIGINT AS sp)
       SELECT 'exact' AS method, gp AS gold_pairs, sp AS shared_pairs, pp AS predicted_pairs FROM t UNION ALL SELECT 'model', gp, NULL, NULL FROM t""",
    "purity": _P + """, k AS (SELECT p, g, count(*) AS n FROM b GROUP BY ALL) SELECT round((SELECT sum(m) FROM (SELECT max(n) AS m FROM k GROUP BY p)) / (SELECT count(*) FROM b), 6) AS purity,
       round((SELECT sum(m) FROM (SELECT max(n) AS m FROM k GROUP BY g)) / (SELECT count(*) FROM b), 6) AS inverse_purity""",
    "alias_index": _AL + "SELECT alias, entity FROM idx",
    "set_f1": """WITH e AS (SELECT load_seq, list_distinct(string_split(lower(canonical_name), ' ')) AS a, list_distinct(string_split(lower(CASE WHEN len(aliases) > 0 THEN aliases[1] ELSE canonical_name END), ' ')) AS b FROM entities)
       SELECT load_seq, CASE WHEN len(list_intersect(a, b)) > 0 THEN round(2.0 * len(list_intersect(a, b)) / (len(a) + len(b)), 6) ELSE 0.0 END AS f1 FROM e""",
    "context_coverage": """WITH n AS (SELECT DISTINCT document AS id, entity_id AS entity FROM occurrences WHERE entity_id IS NOT NULL), d AS (SELECT DISTINCT document_id, document_name FROM source_documents),
       c AS (SELECT DISTINCT document_name AS id, entity_id AS entity, 1 AS hit FROM entity_occurrences JOIN d USING (document_id))
       SELECT id, round(count(hit) / count(*), 6) AS coverage, count(hit) = count(*) AS complete FROM n LEFT JOIN c USING (id, entity) GROUP BY id""",
    "path_hits": """WITH p AS (SELECT pair_id % 50 AS id, pair_id % 400 AS alt, least(node_id_l, node_id_r) AS a, greatest(node_id_l, node_id_r) AS b, match_probability AS m FROM match_pairs WHERE node_id_l <> node_id_r),
       e AS (SELECT DISTINCT id, a, b, 1 AS there FROM p WHERE m >= 0.8), s AS (SELECT DISTINCT id, alt, a, b FROM p), x AS (SELECT id, alt, count(there) = count(*) AS hit FROM s LEFT JOIN e USING (id, a, b) GROUP BY ALL)
       SELECT id, bool_or(hit) AS hit FROM x GROUP BY id""",
    "by_type_means": """WITH s AS (SELECT event_id % 997 AS id, event_type AS system, min((user_id % 7)::VARCHAR) AS kind, avg(value) AS score FROM events GROUP BY ALL), f AS (SELECT * FROM s WHERE id IN (SELECT id FROM s GROUP BY id HAVING count(DISTINCT system) = (SELECT count(DISTINCT system) FROM s)))
       SELECT NULL AS kind, system, count(*) AS n, round(avg(score), 4) AS mean_score, round(median(score), 4) AS median_score FROM f GROUP BY system
       UNION ALL SELECT kind, system, count(*), round(avg(score), 4), round(median(score), 4) FROM f GROUP BY kind, system""",
    "question_order": """WITH k AS (SELECT type, row_number() OVER (ORDER BY type) - 1 AS i FROM (SELECT DISTINCT event_type AS type FROM events))
       SELECT event_id AS id, event_type AS type, (row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1) * 10 + i AS priority FROM events JOIN k ON k.type = event_type""",
}
