"""Connected components by alternating large-star and small-star steps on DataFrames.

Every step hangs neighbours on the smallest node beside them, so the edges of a component shrink to one star around
its smallest member in a logarithmic number of rounds. Groups are aggregated with min before anything is joined, and
rounds are cut by tables in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.session import Stage

MAX_ROUNDS = 60


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(node, component) of every node with an edge to another; component is the smallest member.

    Null ends and self links link nothing; an empty input gives an empty result.
    """
    a, b = F.least(src, dst), F.greatest(src, dst)
    state = Stage(edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col(src) != F.col(dst))).select(b.alias("node"), a.alias("low")).distinct(), "cc")
    for _ in range(MAX_ROUNDS):
        both = state.df.unionByName(state.df.select(F.col("low").alias("node"), F.col("node").alias("low")))
        least = both.groupBy("node").agg(F.least(F.min("low"), F.first("node")).alias("m"))
        # large star: larger neighbours of a node hang on the node's smallest neighbour
        large = both.where("low > node").join(least, "node").select(F.col("low").alias("node"), F.col("m").alias("low")).distinct()
        # small star: a node and its smaller neighbours hang on the smallest of them
        small_least = large.groupBy("node").agg(F.min("low").alias("m"))
        small = large.join(small_least, "node").where("low <> m").select(F.col("low").alias("node"), F.col("m").alias("low"))
        fresh = Stage(small.unionByName(small_least.select("node", F.col("m").alias("low"))).where("node <> low").distinct(), "cc")
        old, new = state.df, fresh.df
        done = new.count() == old.count() and not new.join(old, ["node", "low"], "left_anti").limit(1).count()
        state.drop()
        state = fresh
        if done:
            break
    else:
        raise RuntimeError("components do not converge")
    stars = state.df.select("node", F.col("low").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
