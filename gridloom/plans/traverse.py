"""Access-filtered traversal with citations.

A subgraph depends only on the set of nodes reached, so walking is a breadth-first search over distinct frontiers: one
equality join per level on edges stored in both directions, instead of enumerating paths. Rights are applied before the
walk: to documents, then to the entities they ground, and every level keeps to those.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.store import OPEN, Store
from gridloom.session import Stage


def allowed_documents(documents: DataFrame, user_tags: list[str]) -> DataFrame:
    """Documents that are unclassified (in any case) or carry one of the user's tags (in their case)."""
    free: Column = F.exists("access_tags", lambda t: F.upper(t) == "UNCLASSIFIED")
    mine = F.arrays_overlap("access_tags", F.array(*[F.lit(t) for t in user_tags])) if user_tags else F.lit(False)
    return documents.where(free | mine)


def grounded(occurrences: DataFrame, allowed: DataFrame) -> DataFrame:
    """(entity_id) of entities that an allowed document mentions."""
    return occurrences.join(allowed.select("document_id"), "document_id", "left_semi").select("entity_id").distinct()


@dataclass
class Context:
    nodes: DataFrame
    edges: DataFrame
    citations: DataFrame

    def to_dict(self) -> dict:
        """A bounded answer for one question, as rows."""
        return {
            "nodes": [r.asDict() for r in self.nodes.collect()],
            "mini_graph": [r.asDict() for r in self.edges.collect()],
            "citation_context": {r[0]: list(r[1]) for r in self.citations.collect()},
        }


class SecureTraversal:
    """All answers for one set of rights over one store."""

    def __init__(self, store: Store, user_tags: list[str]):
        self.store, self.tags = store, user_tags

    @cached_property
    def allowed(self) -> DataFrame:
        return allowed_documents(self.store.documents, self.tags)

    @cached_property
    def grounded(self) -> DataFrame:
        return Stage(grounded(self.store.occurrences, self.allowed), "grounded").df

    @cached_property
    def open_edges(self) -> DataFrame:
        """Open relationships, written once; their ends are held against what is grounded where a walk or an answer meets them."""
        r = self.store.relationships.where(F.col("access_policy") == OPEN)
        return Stage(r.select("relationship_id", "relationship_type", "from_entity_id", "to_entity_id"), "open").df

    def _ends_grounded(self, edges: DataFrame) -> DataFrame:
        for end in ("from_entity_id", "to_entity_id"):
            edges = edges.join(self.grounded.withColumnRenamed("entity_id", end), end, "left_semi")
        return edges

    def _neighbours(self, front: DataFrame) -> DataFrame:
        """(entity_id): distinct grounded entities one open relationship away from front(x), in either direction."""
        e = self.open_edges
        out = e.join(front.withColumnRenamed("x", "from_entity_id"), "from_entity_id", "left_semi").select(F.col("to_entity_id").alias("entity_id"))
        back = e.join(front.withColumnRenamed("x", "to_entity_id"), "to_entity_id", "left_semi").select(F.col("from_entity_id").alias("entity_id"))
        return out.unionByName(back).distinct().join(self.grounded, "entity_id", "left_semi")

    def reached(self, starts: DataFrame, max_depth: int) -> DataFrame:
        """(entity_id, depth) of grounded entities within max_depth of starts(entity_id)."""
        if max_depth < 0:
            raise ValueError("max_depth must not be negative")
        seen = Stage(starts.select("entity_id").distinct().join(self.grounded, "entity_id", "left_semi").withColumn("depth", F.lit(0)), "seen")
        for depth in range(1, max_depth + 1):
            front = seen.df.where(F.col("depth") == depth - 1)
            step = self._neighbours(front.select(F.col("entity_id").alias("x")))
            fresh = step.join(seen.df, "entity_id", "left_anti").withColumn("depth", F.lit(depth))
            after = Stage(seen.df.unionByName(fresh), "seen")
            seen.drop()
            seen = after
        return seen.df

    def subgraph(self, reached: DataFrame) -> DataFrame:
        """Open relationships with both ends reached, with the names of the ends."""
        ids = reached.select("entity_id")
        e = self.open_edges.join(ids.withColumnRenamed("entity_id", "from_entity_id"), "from_entity_id", "left_semi")
        e = e.join(ids.withColumnRenamed("entity_id", "to_entity_id"), "to_entity_id", "left_semi")
        n = self.store.entities.select("unique_entity_id", "canonical_name")
        a = n.select(F.col("unique_entity_id").alias("from_entity_id"), F.col("canonical_name").alias("from_name"))
        b = n.select(F.col("unique_entity_id").alias("to_entity_id"), F.col("canonical_name").alias("to_name"))
        return e.join(a, "from_entity_id").join(b, "to_entity_id").select("relationship_id", "relationship_type", "from_entity_id", "to_entity_id", "from_name", "to_name").distinct()

    def details(self, ids: DataFrame) -> DataFrame:
        return self.store.entities.join(ids.select(F.col("entity_id").alias("unique_entity_id")).distinct(), "unique_entity_id", "left_semi").select("unique_entity_id", "entity_type", "canonical_name", "cluster_size", F.coalesce("attributes", F.lit("{}")).alias("attributes"))

    def citations(self, ids: DataFrame, relationship_occurrences: DataFrame | None = None) -> DataFrame:
        """(document_name, pages) of allowed documents that mention the entities, or a relationship that touches them."""
        seen = self.store.occurrences.join(ids.select("entity_id").distinct(), "entity_id", "left_semi").select("document_id", "page_numbers")
        if relationship_occurrences is not None:
            mine = ids.select("entity_id").distinct()
            each = self.open_edges.select("relationship_id", "from_entity_id", "to_entity_id")
            touch = each.join(mine.withColumnRenamed("entity_id", "from_entity_id"), "from_entity_id", "left_semi").unionByName(each.join(mine.withColumnRenamed("entity_id", "to_entity_id"), "to_entity_id", "left_semi"))
            touch = self._ends_grounded(touch).select("relationship_id").distinct()
            seen = seen.unionByName(relationship_occurrences.join(touch, "relationship_id", "left_semi").select("document_id", "page_numbers"))
        rows = seen.where("page_numbers is not null").join(self.allowed.select("document_id", "document_name"), "document_id")
        # pages are made distinct before they are gathered, so a much cited document costs its pages only
        pages = rows.select("document_name", F.explode_outer("page_numbers").alias("page")).distinct()
        return pages.groupBy("document_name").agg(F.array_sort(F.collect_list("page")).alias("pages"))

    def context(self, start_ids: list[str] | DataFrame, max_depth: int = 2) -> Context:
        starts = start_ids if isinstance(start_ids, DataFrame) else self.store.entities.sparkSession.createDataFrame([(i,) for i in start_ids], "entity_id string")
        reached = self.reached(starts, max_depth)
        return Context(self.details(reached), self.subgraph(reached), self.citations(reached, self.store.relationship_occurrences))

    def shortest_path(self, source: str, target: str) -> list[str] | None:
        """The lexicographically smallest of the shortest paths, or None; one frontier join per level, from the target back.

        The driver holds the path only.
        """
        spark = self.store.entities.sparkSession
        ids = spark.createDataFrame([(source,), (target,)], "entity_id string").join(self.grounded, "entity_id", "left_semi")
        if ids.select("entity_id").distinct().count() < len({source, target}):
            return None
        if source == target:
            return [source]
        seen = Stage(spark.createDataFrame([(target, 0)], "entity_id string, depth int"), "back")
        depth = 0
        while True:  # every level reaches new nodes or is the last
            depth += 1
            front = seen.df.where(F.col("depth") == depth - 1).select(F.col("entity_id").alias("x"))
            fresh = self._neighbours(front).join(seen.df, "entity_id", "left_anti").withColumn("depth", F.lit(depth))
            after = Stage(seen.df.unionByName(fresh), "back")
            seen.drop()
            seen = after
            level = seen.df.where(F.col("depth") == depth)
            if level.where(F.col("entity_id") == source).limit(1).count():
                break
            if not level.limit(1).count():
                return None
        path, at = [source], source
        for d in range(depth - 1, -1, -1):
            step = self._neighbours(spark.createDataFrame([(at,)], "x string")).join(seen.df.where(F.col("depth") == d), "entity_id")
            at = step.agg(F.min("entity_id")).first()[0]
            path.append(at)
        return path

    def path_edges(self, path: list[str]) -> DataFrame:
        """One open relationship per step: forward before backward, then the smallest relationship_id."""
        spark = self.store.entities.sparkSession
        steps = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(path, path[1:], strict=False))], "step int, a string, b string")
        e = self._ends_grounded(self.open_edges)
        forward = steps.join(e, (F.col("a") == F.col("from_entity_id")) & (F.col("b") == F.col("to_entity_id"))).withColumn("backward", F.lit(0))
        backward = steps.join(e, (F.col("b") == F.col("from_entity_id")) & (F.col("a") == F.col("to_entity_id"))).withColumn("backward", F.lit(1))
        every = forward.unionByName(backward)
        best = every.groupBy("step").agg(F.min_by(F.struct("relationship_id", "relationship_type", "from_entity_id", "to_entity_id"), F.struct("backward", "relationship_id")).alias("r"))
        return best.select("step", "r.*")
