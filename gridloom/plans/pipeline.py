"""Runs that chain operators: communities from the decision to their summaries, and all resolvers against a gold standard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import communities, evaluate, graph
from gridloom.operators.resolve import Resolver
from gridloom.session import replace_table


def _read(spark, path: str) -> DataFrame | None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)
    return spark.read.parquet(path) if there else None


def community_run(nodes: DataFrame, edges: DataFrame, names: DataFrame, path: str, ask: Callable | None = None, force: bool = False) -> dict[str, DataFrame] | None:
    """Communities of nodes(node_id) and edges(src, dst) at three levels, kept in tables under path; None if the last run still holds.

    The last run holds until entities or relationships have moved too far (graph.must_recompute). Resolutions follow the graph's
    metrics. With a model (ask, as in communities.summaries) every community of names(entity_id, canonical_name) gets a summary. The
    tables are communities, community_summaries and metadata, the last one being written last.
    """
    spark = nodes.sparkSession
    now = graph.sizes(nodes, edges)
    last = _read(spark, f"{path}/metadata")
    if last is not None and not force and not graph.must_recompute(now, last).first()[0]:
        return None
    gammas = graph.resolutions(now.join(graph.clustering(nodes, edges))).first().asDict()
    replace_table(communities.build_levels(nodes, edges, gammas), f"{path}/communities")
    members = spark.read.parquet(f"{path}/communities")
    out = {"communities": members}
    if ask is not None:
        stats = graph.community_stats(edges, members.select("entity_id", "level", F.col("community").alias("community_id")), names)
        replace_table(communities.summaries(stats, ask, f"{path}/replies"), f"{path}/community_summaries")
        out["community_summaries"] = spark.read.parquet(f"{path}/community_summaries")
    replace_table(now.select("n_nodes", "n_edges"), f"{path}/metadata")
    out["metadata"] = spark.read.parquet(f"{path}/metadata")
    return out


def score_methods(methods: dict[str, Resolver], mentions: DataFrame, edges: DataFrame | None, gold: DataFrame) -> DataFrame:
    """(method, clusters_found, pairwise precision, recall and F1, purity): every method's clusters against gold(item, label)."""
    out = None
    for name, method in sorted(methods.items()):
        clusters = method.resolve(mentions, edges)
        labels = evaluate.labels(gold, clusters)
        found = clusters.agg(F.countDistinct("cluster_id").alias("clusters_found"))
        row = evaluate.pairwise_scores(labels, gold).join(evaluate.purity(labels, gold)).join(found).withColumn("method", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out
