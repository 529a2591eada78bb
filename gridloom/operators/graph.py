"""Graph metrics: density, degrees, clustering, components, ranks, modularity and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.components import connected_components
from gridloom.session import Stage


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b): distinct unordered pairs without self loops."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(edges: DataFrame) -> DataFrame:
    """(node_id, degree, triangles) of nodes with an edge in the simple undirected graph.

    Edges point from the end of smaller degree to the other, so a hub has few outgoing edges and the open wedges number at
    most edges ** 1.5; they are closed by an equality join.
    """
    simple = Stage(undirected(edges), "simple").df
    degree = simple.select(F.explode(F.array("a", "b")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    da, db = degree.select(F.col("node_id").alias("a"), F.col("degree").alias("da")), degree.select(F.col("node_id").alias("b"), F.col("degree").alias("db"))
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    out = Stage(simple.join(da, "a").join(db, "b").select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")), "oriented").df
    wedge = out.alias("x").join(out.alias("y"), "u").where("x.v < y.v").select("u", F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    closed = wedge.join(simple, ["a", "b"])
    per = closed.select(F.explode(F.array("u", "a", "b")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("triangles"))
    return degree.join(per, "node_id", "left").na.fill(0, ["triangles"])


def sizes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, density and mean degree over relationship rows, ratio; two counts and nothing more."""
    nn, mm = F.col("n_nodes"), F.col("n_edges")
    return nodes.agg(F.count("*").alias("n_nodes")).join(edges.agg(F.count("*").alias("n_edges"))).select(
        "n_nodes", "n_edges",
        F.when(nn > 1, F.round(mm / (nn * (nn - 1)), 8)).otherwise(0.0).alias("density"),
        F.when(nn > 0, F.round(mm / nn, 6)).otherwise(0.0).alias("avg_degree"),
        F.when(mm == 0, F.lit(float("inf"))).otherwise(F.round(nn / mm, 6)).alias("entity_relationship_ratio"),
    )


def clustering(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the mean local clustering over all nodes and ends of relationships."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    every = nodes.select("node_id").unionByName(ends).distinct().agg(F.count("*").alias("n_all"))
    d = F.col("degree")
    local = triangles(edges).agg(F.sum(F.when(d > 1, 2.0 * F.col("triangles") / (d * (d - 1))).otherwise(0.0)).alias("c"))
    return every.join(local).select(F.round(F.coalesce(F.col("c"), F.lit(0.0)) / F.nullif(F.col("n_all"), F.lit(0)), 6).alias("avg_clustering"))


def component_count(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: the connected components over all nodes and ends of relationships."""
    ends = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    every = nodes.select("node_id").unionByName(ends).distinct().agg(F.count("*").alias("n_all"))
    parts = connected_components(edges).agg(F.countDistinct("component").alias("linked"), F.count("*").alias("in_parts"))
    return every.join(parts).select((F.col("linked") + F.col("n_all") - F.col("in_parts")).alias("components"))


def metrics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """sizes, clustering and component_count in one row."""
    return sizes(nodes, edges).join(clustering(nodes, edges)).join(component_count(nodes, edges)).select(
        "n_nodes", "n_edges", "density", "avg_degree", "avg_clustering", "components", "entity_relationship_ratio"
    )


def resolutions(m: DataFrame) -> DataFrame:
    """(micro, meso, macro) from density, avg_degree and avg_clustering."""
    dense = (F.col("density") > 0.1) | (F.col("avg_degree") > 20)
    medium = (F.col("density") > 0.01) | (F.col("avg_degree") > 5)
    pick = lambda a, b, c: F.when(dense, a).when(medium, b).otherwise(c)
    tight = F.col("avg_clustering") > 0.5
    return m.select(
        F.round(pick(2.0, 1.5, 1.0) * F.when(tight, 1.2).otherwise(1.0), 4).alias("micro"),
        F.round(pick(1.2, 1.0, 0.7) * F.when(tight, 1.1).otherwise(1.0), 4).alias("meso"),
        pick(0.5, 0.3, 0.1).alias("macro"),
    )


def must_recompute(now: DataFrame, last: DataFrame) -> Column | DataFrame:
    """(recompute): true without a last run, or when entities moved by more than 10 % or relationships by more than 15 %."""
    joined = now.select(F.col("n_nodes").alias("e"), F.col("n_edges").alias("r")).join(last.select(F.col("n_nodes").alias("le"), F.col("n_edges").alias("lr")), how="left")
    change = lambda a, b: F.when(F.col(b) == 0, 1.0).otherwise(F.abs(F.col(a) - F.col(b)) / F.col(b))
    return joined.select((F.col("le").isNull() | (change("e", "le") > 0.10) | (change("r", "lr") > 0.15)).alias("recompute"))


def summary_text(m: DataFrame) -> DataFrame:
    return m.select(F.format_string("entities %d, relationships %d, density %.6f, average degree %.2f, components %d", "n_nodes", "n_edges", "density", "avg_degree", "components").alias("summary"))


def page_rank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-8) -> DataFrame:
    """(node_id, rank), once all ranks together move by no more than the tolerance; what nodes without outgoing edges hold is
    spread evenly. The change shrinks by the damping every round, so the rounds needed do not depend on the graph's size."""
    links = Stage(edges.where("src <> dst").select("src", "dst").distinct(), "links").df
    ids = Stage(nodes.select("node_id").distinct(), "ids").df
    n = ids.count()
    out = links.groupBy("src").agg(F.count("*").alias("k"))
    base = ids.join(out.withColumnRenamed("src", "node_id"), "node_id", "left")
    state = Stage(base.withColumn("rank", F.lit(1.0 / max(n, 1))), "rank")
    moved = 2.0
    while n and moved > tolerance:
        loose = state.df.where("k is null").agg(F.sum("rank")).first()[0] or 0.0
        given = links.join(state.df.select(F.col("node_id").alias("src"), (F.col("rank") / F.col("k")).alias("share")), "src").groupBy(F.col("dst").alias("node_id")).agg(F.sum("share").alias("got"))
        fresh = state.df.select("node_id", "k", "rank").join(given, "node_id", "left").withColumn("was", F.col("rank")).withColumn("rank", (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + loose / n)).drop("got")
        after = Stage(fresh.select("node_id", "k", "rank", "was"), "rank")
        moved = after.df.agg(F.sum(F.abs(F.col("rank") - F.col("was")))).first()[0]
        state.drop()
        state = after
    return state.df.select("node_id", "rank")


def modularity(edges: DataFrame, members: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(modularity) of a partition members(node_id, community) of the simple undirected graph."""
    simple = undirected(edges)
    a = members.select(F.col("node_id").alias("a"), F.col("community").alias("ca"))
    b = members.select(F.col("node_id").alias("b"), F.col("community").alias("cb"))
    e = simple.join(a, "a").join(b, "b")
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("c")).agg(F.count("*").alias("l"))
    degree = e.select(F.explode(F.array("ca", "cb")).alias("c")).groupBy("c").agg(F.count("*").alias("d"))
    m = e.agg(F.count("*").alias("m"))
    q = degree.join(inside, "c", "left").join(m).agg(F.sum(F.coalesce("l", F.lit(0)) / F.col("m") - gamma * F.pow(F.col("d") / (2 * F.col("m")), F.lit(2))).alias("q"))
    return q.select(F.round("q", 6).alias("modularity"))


def community_stats(edges: DataFrame, members: DataFrame, names: DataFrame, top: int = 5) -> DataFrame:
    """(level, community_id, entity_count, relationship_count, density, top_entities): degree is counted inside the community.

    members(entity_id, level, community_id), names(entity_id, canonical_name).
    """
    a = members.select(F.col("entity_id").alias("src"), "level", "community_id")
    b = members.select(F.col("entity_id").alias("dst"), "level", F.col("community_id").alias("other"))
    inner = edges.select("src", "dst").join(a, "src").join(b, ["dst", "level"]).where("community_id = other")
    rels = inner.groupBy("level", "community_id").agg(F.count("*").alias("relationship_count"))
    degree = inner.select("level", "community_id", F.explode(F.array("src", "dst")).alias("entity_id")).groupBy("level", "community_id", "entity_id").agg(F.count("*").alias("d"))
    ranked = members.join(degree, ["level", "community_id", "entity_id"], "left").na.fill(0, ["d"]).join(names, "entity_id", "left")
    # Spark limits each group before its shuffle, so a large community sends `top` rows a task
    w = Window.partitionBy("level", "community_id").orderBy(F.desc("d"), "entity_id")
    first = ranked.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top).groupBy("level", "community_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rn", "canonical_name"))), lambda x: x["canonical_name"]).alias("top_entities")
    )
    best = members.groupBy("level", "community_id").agg(F.count("*").alias("entity_count")).join(first, ["level", "community_id"])
    n, m = F.col("entity_count"), F.coalesce("relationship_count", F.lit(0))
    return best.join(rels, ["level", "community_id"], "left").select("level", "community_id", "entity_count", m.alias("relationship_count"), F.when(n > 1, F.round(m / (n * (n - 1) / 2), 6)).otherwise(0.0).alias("density"), F.array_join("top_entities", "; ").alias("top_entities"))


def batch_size(total: int, per_minute: int = 10, cap: int = 25) -> int:
    """Communities per request: enough for one request a slot, at least 1 and at most the cap."""
    return 1 if total <= 0 else max(1, min(-(-total // per_minute), cap))
