"""Communities by the Leiden method, per connected component, and their levels.

Communities never span components, so each component is one task; a component of more than MAX_EDGES edges is first
coarsened by rounds of distributed label moves whose merges keep to connected groups, until it fits one.
"""

from __future__ import annotations

from collections import defaultdict, deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.components import connected_components
from gridloom.operators.graph import undirected
from gridloom.session import Stage

LEVELS = ("micro", "meso", "macro")
MAX_EDGES = 2_000_000


def leiden(edges: list[tuple[int, int, float]], n: int, loops: dict[int, float], gamma: float, total: float, seed: int = 42, rounds: int = 20) -> np.ndarray:
    """Labels of nodes 0..n-1 that locally maximise sum_c (L_c - gamma * d_c ** 2 / (4 total)); total is the whole graph's weight.

    Fast local moves with a queue, refinement inside each community by merges of well connected nodes, aggregation of the
    refined groups, until nothing moves. Order is seeded.
    """
    rng = np.random.default_rng(seed)
    groups = np.arange(n)
    near = [defaultdict(float) for _ in range(n)]
    for a, b, w in edges:
        near[a][b] += w
        near[b][a] += w
    own = np.array([loops.get(i, 0.0) for i in range(n)])
    start = None
    for _ in range(rounds):
        size = len(near)
        degree = np.array([sum(x.values()) for x in near]) + 2 * own
        com = np.arange(size) if start is None else start.copy()
        weight = np.bincount(com, weights=degree, minlength=size)
        queue, waiting = deque(rng.permutation(size).tolist()), np.ones(size, bool)
        while queue:
            v = queue.popleft()
            waiting[v] = False
            here = com[v]
            to = defaultdict(float)
            for u, w in near[v].items():
                to[com[u]] += w
            weight[here] -= degree[v]
            best, gain = here, to.get(here, 0.0) - gamma * degree[v] * weight[here] / (2 * total)
            for c in sorted(to):
                g = to[c] - gamma * degree[v] * weight[c] / (2 * total)
                if g > gain + 1e-12:
                    best, gain = c, g
            weight[best] += degree[v]
            if best != here:
                com[v] = best
                for u in near[v]:
                    if com[u] != best and not waiting[u]:
                        waiting[u] = True
                        queue.append(u)
        fine = np.arange(size)
        fine_weight = degree.copy()
        alone = np.ones(size, bool)
        total_of = np.bincount(com, weights=degree, minlength=size)
        for v in rng.permutation(size):
            if not alone[v]:
                continue
            to = defaultdict(float)
            inside = 0.0
            for u, w in near[v].items():
                if com[u] == com[v]:
                    to[fine[u]] += w
                    inside += w
            if inside < gamma * degree[v] * (total_of[com[v]] - degree[v]) / (2 * total):
                continue
            best, gain = fine[v], 0.0
            for c in sorted(to):
                if c != fine[v]:
                    g = to[c] - gamma * degree[v] * fine_weight[c] / (2 * total)
                    if g > gain + 1e-12:
                        best, gain = c, g
            if best != fine[v]:
                fine_weight[fine[v]] -= degree[v]
                fine_weight[best] += degree[v]
                fine[v] = best
                alone[v] = alone[best] = False
        _, fine = np.unique(fine, return_inverse=True)
        k = int(fine.max()) + 1
        first = np.zeros(k, np.int64)
        first[fine] = com
        _, start = np.unique(first, return_inverse=True)
        if k == size:
            return start[groups] if start is not None else groups
        groups = fine[groups]
        fresh = [defaultdict(float) for _ in range(k)]
        loop = np.bincount(fine, weights=own, minlength=k)
        for v in range(size):
            for u, w in near[v].items():
                if v < u:
                    if fine[u] == fine[v]:
                        loop[fine[v]] += w
                    else:
                        fresh[fine[v]][fine[u]] += w
                        fresh[fine[u]][fine[v]] += w
        near, own = fresh, loop
    return start[groups]


def _coarsen(edges: DataFrame, total: float, gamma: float) -> DataFrame:
    """(node, group): every node joins its smallest neighbour where that gains; chains end in connected groups."""
    both = edges.select("a", "b", "w").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    degree = both.groupBy("a").agg(F.sum("w").alias("d"))
    pair = both.where("a <> b").groupBy("a", "b").agg(F.sum("w").alias("w")).join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("db")), "b")
    gain = F.col("w") - gamma * F.col("d") * F.col("db") / (2 * total)
    best = pair.where(gain > 0).groupBy("a").agg(F.max(F.struct(gain.alias("g"), "b")).alias("x")).select("a", F.col("x.b").alias("b"))
    return connected_components(best, "a", "b").select("node", F.col("component").alias("group"))


def detect(nodes: DataFrame, edges: DataFrame, gamma: float = 1.0, seed: int = 42, max_edges: int = MAX_EDGES) -> DataFrame:
    """(node_id, community): every node in one community, named after its smallest member; nodes without edges alone."""
    simple = Stage(undirected(edges).withColumn("w", F.lit(1.0)), "simple").df
    total = float(simple.count())
    path = None  # node -> group after coarsening
    current = simple
    while current.count() > max_edges:
        step = Stage(_coarsen(current, total, gamma), "coarse").df
        a = step.select(F.col("node").alias("a"), F.col("group").alias("ga"))
        b = step.select(F.col("node").alias("b"), F.col("group").alias("gb"))
        moved = current.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ga", "a").alias("x"), F.coalesce("gb", "b").alias("y"), "w")
        fewer = Stage(moved.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "w").groupBy("a", "b").agg(F.sum("w").alias("w")), "level").df
        path = step if path is None else path.join(step.select(F.col("node").alias("group"), F.col("group").alias("up")), "group", "left").select("node", F.coalesce("up", "group").alias("group")).unionByName(step.join(path.select("node"), "node", "left_anti"))
        if fewer.count() == current.count():
            break
        current = fewer
    parts = connected_components(current, "a", "b")
    keyed = current.join(parts.select(F.col("node").alias("a"), "component"), "a", "left").withColumn("component", F.coalesce("component", "a"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        names = sorted({*pdf["a"], *pdf["b"]})
        code = {x: i for i, x in enumerate(names)}
        loops: dict[int, float] = defaultdict(float)
        links = []
        for a, b, w in zip(pdf["a"], pdf["b"], pdf["w"], strict=True):
            if a == b:
                loops[code[a]] += w
            else:
                links.append((code[a], code[b], w))
        label = leiden(sorted(links), len(names), loops, gamma, total, seed)
        first: dict[int, str] = {}
        for x, c in zip(names, label, strict=True):
            first.setdefault(c, x)
        return pd.DataFrame({"node": names, "community": [first[c] for c in label]})

    found = keyed.groupBy("component").applyInPandas(solve, "node string, community string")
    if path is not None:
        wide = path.join(found.withColumnRenamed("node", "group"), "group").select("node", "community")
        found = wide.unionByName(found.join(path.select("node"), "node", "left_anti"))
    return nodes.select("node_id").join(found.withColumnRenamed("node", "node_id"), "node_id", "left").select("node_id", F.coalesce("community", "node_id").alias("community"))


def build_levels(nodes: DataFrame, edges: DataFrame, gammas: dict[str, float], seed: int = 42) -> DataFrame:
    """(entity_id, level, resolution, community): one row per entity and level."""
    out = None
    for level in LEVELS:
        part = detect(nodes, edges, gammas[level], seed).select(F.col("node_id").alias("entity_id"), F.lit(level).alias("level"), F.lit(gammas[level]).alias("resolution"), "community")
        out = part if out is None else out.unionByName(part)
    return out


def summaries(stats: DataFrame, ask, cache: str) -> DataFrame:
    """(community_key, summary) of stats(level, community_id, entity_count, relationship_count, density, top_entities).

    ask gets a frame with the column `prompt` and returns one text per row; replies are kept by prompt in the cache.
    """
    from gridloom.sources.sinks import cached_replies

    prompt = F.format_string("Summarise community %s of level %s: %d entities, %d relationships, density %s, led by %s.", F.col("community_id").cast("string"), "level", "entity_count", "relationship_count", F.col("density").cast("string"), "top_entities")
    asked = stats.select(F.concat_ws("_", "level", F.col("community_id").cast("string")).alias("community_key"), prompt.alias("prompt"))
    return cached_replies(asked, ["prompt"], cache, ask).select("community_key", F.col("reply").alias("summary"))
