"""Consolidating pairwise matches into groups.

Union-find runs inside edge partitions and only each partition's spanning forest is kept, as stars (node, local
root). While a forest is larger than one bounded partition, stars that share a node are contracted to edges
between their roots and the next level works on those; the labels are then handed down again. When the forest
fits, one bounded partition merges it; where a level does not shrink the links (edges spread so thinly that no two
of a partition meet), large-star and small-star steps take over, so every input ends. Every level keeps the smallest
node id of a tree as its root, so the final root is the smallest of the whole component.

The first level takes the input's own partitions, one scan split each; from the second on edges are range-partitioned
by (smaller end, larger end): the edges of a hub stand next to each other, are merged into one star where they meet,
and still spread over as many partitions as they fill.

Defined results: null ends, self links and pairs below the threshold (or with a null score) link nothing; repeated
and reversed pairs count once; mentions without a link are no case; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.components import connected_components
from gridloom.session import Stage, merge_join, skew_join

#: Edges that one partition may hold while merging; about 100 bytes each.
MAX_EDGES = 4_000_000
#: A level that leaves more than this share of its links is the last: the rest goes by large-star and small-star steps.
SHRINK = 0.9


def min_roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Union-find over nodes 0..n-1 by hooking to the smaller root and halving paths; each node's smallest member."""
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _forest(batches):
    """Spanning stars of the edges of one partition, in order of node."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    ends = pa.chunked_array([*t.column(0).chunks, *t.column(1).chunks]).combine_chunks()
    coded = ends.dictionary_encode()
    names = coded.dictionary
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[coded.indices.to_numpy()]
    root = min_roots(codes[: t.num_rows], codes[t.num_rows :], len(order))
    names = names.take(pa.array(order))
    yield pa.RecordBatch.from_arrays([names, names.take(pa.array(root))], ["node", "root"])


def spanning_stars(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of every partition; a root is its own root."""
    return edges.select("a", "b").mapInArrow(_forest, "node string, root string")


def component_labels(edges: DataFrame, max_edges: int = MAX_EDGES) -> DataFrame:
    """(node, root) over all edges (a, b) of non-null strings; root is the smallest node of the component."""
    stars = Stage(spanning_stars(edges), "stars")
    forest = stars.df
    links = forest.where("node <> root").count()
    if links <= max_edges:
        return spanning_stars(forest.select(F.col("root").alias("a"), F.col("node").alias("b")).coalesce(1))
    seen = forest.groupBy("node").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    meets = merge_join(forest, seen.where("low <> high").select("node", "low"), "node")
    contracted = Stage(meets.where("root <> low").select(F.col("low").alias("a"), F.col("root").alias("b")).distinct(), "contracted").df
    n = contracted.count()
    if n <= SHRINK * links:
        upper = component_labels(contracted.repartitionByRange(max(2, -(-links // max_edges) * 2), "a", "b"), max_edges)
    else:
        upper = connected_components(contracted, "a", "b").select("node", F.col("component").alias("root"))
    upper = upper.select(F.col("node").alias("low"), F.col("root").alias("top"))
    low = Stage(seen.select("node", "low"), "low").df
    sizes = Stage(low.groupBy("low").agg(F.count("*").alias("n")), "sizes").df
    top = Stage(merge_join(sizes.select("low"), upper, "low", "left").select("low", F.coalesce("top", "low").alias("top")), "upper").df
    return skew_join(low, top, sizes, ["low"], "n").select("node", F.col("top").alias("root"))


def match_groups(pairs: DataFrame, left: str, right: str, score: str | None = None, threshold: float = 0.8, max_edges: int = MAX_EDGES) -> DataFrame:
    """(node_id, group_id) of every node linked to at least one other."""
    kept = pairs if score is None else pairs.where(F.col(score) >= threshold)
    edges = kept.where(F.col(left) != F.col(right)).select(F.least(left, right).alias("a"), F.greatest(left, right).alias("b"))
    return component_labels(edges, max_edges).select(F.col("node").alias("node_id"), F.col("root").alias("group_id"))
