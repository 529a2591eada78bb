"""Queries on variant spellings (p6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.llm import names
from gridloom.session import merge_join, table


def p6_found(spark, d):
    """Spellings of resolved mentions count as recorded variants of their entity, like name_variants and aliases."""
    known = names.entity_names(table(spark, d, "entities"))
    mentions = table(spark, d, "occurrences")
    kind = known.groupBy("entity").agg(F.max("organisation").alias("organisation"))
    resolved = mentions.where("entity_id is not null and surface is not null").select(F.col("entity_id").alias("entity"), F.col("surface").alias("name")).distinct()
    known = known.unionByName(merge_join(resolved, kind, "entity").select("entity", "organisation", "name", F.lit(False).alias("canonical")))
    open_ = mentions.where("entity_id is null")
    return names.link_mentions(open_, known, "occurrence_id", "surface").select("occurrence_id", F.col("entity").alias("unique_entity_id"))


QUERIES = {"p6_found": p6_found}
SQL: dict[str, str] = {}
