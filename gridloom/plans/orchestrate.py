"""Questions to cited subgraphs: retrieval, a planned mode, and passages where nothing was found.

The planner and the embedder are injected. Rights hold on every way out: candidates, subgraphs, citations and fallback
passages are limited to what the user may see, and refusals give counts, not names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.retrieve import passages, vector_top_k
from gridloom.operators.store import Store
from gridloom.plans.traverse import SecureTraversal

LASER, FLASHLIGHT = "laser", "flashlight"


@dataclass
class Plan:
    """What a planner decides: a path between two entities, or the neighbourhood of named entities and types."""

    mode: str
    source_id: str | None = None
    target_id: str | None = None
    names: list[str] = field(default_factory=list)
    types: list[str] = field(default_factory=list)
    relationship_types: list[str] = field(default_factory=list)

    def is_empty(self) -> bool:
        if self.mode == LASER:
            return not (self.source_id and self.target_id)
        return self.mode != FLASHLIGHT or not (self.names or self.types or self.relationship_types)


@dataclass
class Answer:
    status: str
    plan: Plan | None = None
    nodes: list[dict] = field(default_factory=list)
    mini_graph: list[dict] = field(default_factory=list)
    citation_context: dict[str, list[int]] = field(default_factory=dict)
    passages: list[dict] = field(default_factory=list)
    message: str = ""


class Orchestrator:
    """Answers for one store; vectors(sql_id, vector) and texts(document, chunk, text) are optional."""

    def __init__(self, store: Store, planner: Callable[[str, list[dict], list[str]], Plan], embed: Callable[[str], list[float]] | None = None, vectors: DataFrame | None = None, texts: DataFrame | None = None):
        self.store, self.planner, self.embed, self.vectors, self.texts = store, planner, embed, vectors, texts

    def similar(self, text: str, k: int, threshold: float) -> DataFrame:
        """(sql_id, score) of the nearest entities by vector."""
        if self.embed is None or self.vectors is None:
            return self.store.entities.sparkSession.createDataFrame([], "sql_id string, score double")
        return vector_top_k(self.vectors, "sql_id", "vector", self.embed(text), k, threshold)

    def schema(self) -> list[str]:
        """Entity types that exist; a summary for the planner."""
        return sorted(r[0] for r in self.store.entities.select("entity_type").where("entity_type is not null").distinct().collect())

    def candidates(self, plan: Plan, per_name: int, threshold: float, per_type: int) -> DataFrame:
        """(entity_id): the best few per name, the first few per type in order of id, and the ends of relationship types."""
        spark = self.store.entities.sparkSession
        out = spark.createDataFrame([], "entity_id string")
        for name in plan.names:
            out = out.unionByName(self.similar(name, per_name, threshold).select(F.col("sql_id").alias("entity_id")))
        for kind in plan.types:
            first = self.store.entities.where(F.col("entity_type") == kind).orderBy("unique_entity_id").limit(per_type)
            out = out.unionByName(first.select(F.col("unique_entity_id").alias("entity_id")))
        if plan.relationship_types:
            ends = self.store.relationships.where(F.col("relationship_type").isin(plan.relationship_types)).select(F.explode(F.array("from_entity_id", "to_entity_id")).alias("entity_id")).distinct().orderBy("entity_id").limit(per_type)
            out = out.unionByName(ends)
        return out.distinct()

    def ask(self, question: str, user_tags: list[str], max_depth: int = 2, threshold: float = 0.1, per_name: int = 5, per_type: int = 20, fallback_passages: int = 5) -> Answer:
        """One answer; passages are added when the plan is ambiguous, fails, or succeeds with nothing, but never on refusal."""
        walk = SecureTraversal(self.store, user_tags)
        try:
            answer = self._graph(question, walk, max_depth, threshold, per_name, per_type)
        except Exception as e:
            answer = Answer("error", message=f"{type(e).__name__}: {e}")
        nothing = answer.status == "success" and not answer.nodes and not answer.mini_graph
        if (answer.status in ("ambiguous", "error") or nothing) and self.texts is not None:
            found = [r.asDict() for r in passages(self.texts, question, fallback_passages, walk.allowed).collect()]
            if found:
                answer.status, answer.passages = "text_fallback", found
        return answer

    def _graph(self, question: str, walk: SecureTraversal, max_depth: int, threshold: float, per_name: int, per_type: int) -> Answer:
        seen = self.similar(question, 10, max(threshold - 0.1, 0.0)).join(walk.grounded.withColumnRenamed("entity_id", "sql_id"), "sql_id", "left_semi")
        named = seen.join(self.store.entities.withColumnRenamed("unique_entity_id", "sql_id"), "sql_id").select("sql_id", "canonical_name", "entity_type", "score")
        plan = self.planner(question, [r.asDict() for r in named.orderBy(F.desc("score"), "sql_id").collect()], self.schema())
        if plan.is_empty():
            return Answer("ambiguous", plan, message="the question names nothing to look for")
        if plan.mode == LASER:
            may = walk.grounded.where(F.col("entity_id").isin(plan.source_id, plan.target_id)).count()
            if may < len({plan.source_id, plan.target_id}):
                return Answer("no_access", plan, message=f"{len({plan.source_id, plan.target_id}) - may} of the entities cannot be shown")
            path = walk.shortest_path(plan.source_id, plan.target_id) or []
            if not path:
                return Answer("success", plan, message="no path")
            ids = self.store.entities.sparkSession.createDataFrame([(i,) for i in path], "entity_id string")
            return Answer("success", plan, [r.asDict() for r in walk.details(ids).collect()], [r.asDict() for r in walk.path_edges(path).orderBy("step").collect()], {r[0]: list(r[1]) for r in walk.citations(ids).collect()})
        chosen = self.candidates(plan, per_name, threshold, per_type)
        n = chosen.count()
        if not n:
            return Answer("ambiguous", plan, message="nothing matches")
        mine = chosen.join(walk.grounded, "entity_id", "left_semi")
        if not mine.limit(1).count():
            return Answer("no_access", plan, message=f"{n} matching entities cannot be shown")
        d = walk.context(mine, max_depth).to_dict()
        return Answer("success", plan, d["nodes"], d["mini_graph"], d["citation_context"])
