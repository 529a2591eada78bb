"""The relational store: upserts, conversion of a merged graph to rows, and the views over it.

Rows arrive as a load history. `upsert_last` keeps the last writer of a key, `insert_or_ignore` the first; both are
one partial aggregation per key, so a key with very many versions is combined before the shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.keys import document_key, entity_key, norm_key, relationship_key, strip
from gridloom.session import merge_join, replace_table, table

OPEN = "OPEN"
#: Attribute names that belong to the graph, not to the record.
RESERVED_NODE = ("original_id", "type", "source_doc", "source_docs", "page_numbers", "cluster_size", "merge_reasoning")
RESERVED_EDGE = ("relationship_type", "source_doc", "source_docs")


def upsert_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of greatest order per key; null keys are no key."""
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return df.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(last).select(*keys, "r.*").select(df.columns)


def insert_or_ignore(df: DataFrame, keys: list[str], order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """The row of least order per key, for keys that the target does not hold."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("r")
    out = df.where(" and ".join(f"{k} is not null" for k in keys)).groupBy(*keys).agg(first).select(*keys, "r.*").select(df.columns)
    return out if existing is None else out.join(existing.select(*keys), keys, "left_anti")


def parse_tags(c: Column) -> Column:
    """A JSON array of tags; anything else holds no tag."""
    return F.coalesce(F.when(F.trim(c).startswith("["), F.from_json(c, "array<string>")), F.array().cast("array<string>"))


def parse_pages(c: Column) -> Column:
    """The whole numbers of a page list, whatever its JSON form; null for null."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))


@dataclass
class Store:
    """The tables of the store as DataFrames."""

    documents: DataFrame
    entities: DataFrame
    relationships: DataFrame
    occurrences: DataFrame
    relationship_occurrences: DataFrame | None = None

    def counts(self) -> DataFrame:
        out = None
        for name in ("documents", "entities", "relationships", "occurrences", "relationship_occurrences"):
            if getattr(self, name) is None:
                continue
            n = getattr(self, name).agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
            out = n if out is None else out.unionByName(n)
        return out


REQUIRED = ("entities", "relationships", "entity_occurrences", "source_documents")


def open_store(spark: SparkSession, path: str) -> Store:
    """The live store of a folder of tables; ValueError names what is missing. relationship_occurrences may be absent."""

    def there(t: str) -> bool:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/{t}.parquet")
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    missing = [t for t in REQUIRED if not there(t)]
    if missing:
        raise ValueError(f"missing tables: {', '.join(missing)}")
    cited = table(spark, path, "relationship_occurrences") if there("relationship_occurrences") else None
    return build_store(table(spark, path, "source_documents"), table(spark, path, "entities"), table(spark, path, "relationships"), table(spark, path, "entity_occurrences"), cited)


def build_store(documents: DataFrame, entities: DataFrame, relationships: DataFrame, occurrences: DataFrame, relationship_occurrences: DataFrame | None = None) -> Store:
    docs = insert_or_ignore(documents, ["document_id"], ["created_at", "document_name"]).where("deleted_at is null")
    docs = docs.select(norm_key(F.col("document_id")).alias("document_id"), "document_name", "file_path", parse_tags(F.col("access_tags")).alias("access_tags"))
    ents = upsert_last(entities, ["unique_entity_id"], ["load_seq"]).where("deleted_at is null")
    ents = ents.select("unique_entity_id", F.initcap(F.trim("entity_type")).alias("entity_type"), strip(F.col("canonical_name")).alias("canonical_name"), "cluster_size", "attributes", "name_variants", "merge_reasoning")
    rels = upsert_last(relationships.withColumn("relationship_id", norm_key(F.col("relationship_id"))), ["relationship_id"], ["load_seq"])
    rels = rels.select("relationship_id", "relationship_type", norm_key(F.col("from_entity_id")).alias("from_entity_id"), norm_key(F.col("to_entity_id")).alias("to_entity_id"), "attributes", "access_policy")
    ids = ents.select("unique_entity_id")
    rels = rels.join(ids.withColumnRenamed("unique_entity_id", "from_entity_id"), "from_entity_id", "left_semi").join(ids.withColumnRenamed("unique_entity_id", "to_entity_id"), "to_entity_id", "left_semi")
    occ = occurrences.select("load_seq", norm_key(F.col("entity_id")).alias("entity_id"), norm_key(F.col("document_id")).alias("document_id"), parse_pages(F.col("page_numbers")).alias("page_numbers"))
    occ = upsert_last(occ, ["entity_id", "document_id"], ["load_seq"]).drop("load_seq")
    if relationship_occurrences is not None:
        cited = relationship_occurrences.select("load_seq", norm_key(F.col("relationship_id")).alias("relationship_id"), norm_key(F.col("document_id")).alias("document_id"), parse_pages(F.col("page_numbers").cast("string")).alias("page_numbers"))
        relationship_occurrences = upsert_last(cited, ["relationship_id", "document_id"], ["load_seq"]).drop("load_seq")
    return Store(docs, ents, rels, occ, relationship_occurrences)


# ---------------------------------------------------------------- conversion of a merged graph


def convert_graph(nodes: DataFrame, edges: DataFrame) -> dict[str, DataFrame]:
    """The five tables of a merged graph.

    nodes(node_id, ord, type, original_id, source_doc, source_docs, page_numbers, cluster_size, attrs map),
    edges(src, dst, ord, relationship_type, source_doc, source_docs, attrs map). Rows that meet in a key: the last wins.
    """
    name = F.coalesce(F.nullif(F.col("attrs")["name"], F.lit("")), F.nullif(F.col("original_id"), F.lit("")), F.lit("UNKNOWN_ENTITY"))
    kind = F.coalesce("type", F.lit("Unknown"))
    keyed = nodes.withColumn("canonical_name", name).withColumn("entity_type", kind).withColumn("unique_entity_id", entity_key(name, kind))
    plain = F.to_json(F.map_filter("attrs", lambda k, v: ~k.isin(*RESERVED_NODE, "name") & v.isNotNull()))
    # a node that a resolver merged keeps the reasoning, and its own id stands for the names that went into it
    why = F.nullif(F.col("attrs")["merge_reasoning"], F.lit(""))
    variants = F.when(F.get_json_object(why, "$.merged_entities").isNotNull(), F.array("node_id"))
    columns = ["unique_entity_id", "entity_type", "canonical_name", variants.alias("name_variants"), F.coalesce("cluster_size", F.lit(1)).alias("cluster_size"), plain.alias("attributes"), why.alias("merge_reasoning"), "ord"]
    entities = upsert_last(keyed.select(*columns), ["unique_entity_id"], ["ord"]).drop("ord")
    docs_of = lambda: F.filter(F.array_distinct(F.concat(F.coalesce("source_docs", F.array().cast("array<string>")), F.array("source_doc"))), lambda d: d.isNotNull() & (F.trim(d) != ""))
    names = nodes.select(F.explode(docs_of()).alias("document_name")).union(edges.select(F.explode(docs_of()).alias("document_name"))).distinct()
    documents = names.select(document_key(F.col("document_name")).alias("document_id"), "document_name")
    seen = keyed.select("unique_entity_id", "ord", "page_numbers", F.explode(docs_of()).alias("d")).select(F.col("unique_entity_id").alias("entity_id"), document_key(F.col("d")).alias("document_id"), "page_numbers", "ord")
    occurrences = upsert_last(seen, ["entity_id", "document_id"], ["ord"]).drop("ord")
    ids = keyed.select("node_id", "unique_entity_id")
    ends = edges.join(ids.select(F.col("node_id").alias("src"), F.col("unique_entity_id").alias("from_entity_id")), "src").join(ids.select(F.col("node_id").alias("dst"), F.col("unique_entity_id").alias("to_entity_id")), "dst")
    ends = ends.withColumn("relationship_type", F.coalesce("relationship_type", F.lit("RELATED_TO")))
    ends = ends.withColumn("relationship_id", relationship_key(F.col("from_entity_id"), F.col("to_entity_id"), F.col("relationship_type")))
    left = F.to_json(F.map_filter("attrs", lambda k, v: ~k.isin(*RESERVED_EDGE) & v.isNotNull()))
    rows = ends.select("relationship_id", "relationship_type", "from_entity_id", "to_entity_id", left.alias("attributes"), F.lit(OPEN).alias("access_policy"), "ord")
    relationships = upsert_last(rows, ["relationship_id"], ["ord"]).drop("ord")
    pages = F.from_json(F.col("attrs")["pages"], "array<int>")
    found = ends.select("relationship_id", "ord", pages.alias("page_numbers"), F.explode(docs_of()).alias("d")).select("relationship_id", document_key(F.col("d")).alias("document_id"), "page_numbers", "ord")
    relationship_occurrences = upsert_last(found, ["relationship_id", "document_id"], ["ord"]).drop("ord")
    return {"documents": documents, "entities": entities, "relationships": relationships, "entity_occurrences": occurrences, "relationship_occurrences": relationship_occurrences}


#: Keys of the store's tables and whether a new row replaces the one that is there.
LOADS = {
    "documents": (["document_id"], False),
    "entities": (["unique_entity_id"], True),
    "relationships": (["relationship_id"], True),
    "entity_occurrences": (["entity_id", "document_id"], True),
    "relationship_occurrences": (["relationship_id", "document_id"], True),
}


def load_graph(nodes: DataFrame, edges: DataFrame, path: str) -> dict[str, DataFrame]:
    """The tables of a merged graph written into the store at path, beside what it holds; returns the tables as they are then.

    Documents are inserted or ignored, all else inserted or replaced; loading the same graph twice changes nothing.
    """
    spark = nodes.sparkSession
    out = {}
    for name, rows in convert_graph(nodes, edges).items():
        keys, replace = LOADS[name]
        target = f"{path}/{name}"
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            old = spark.read.parquet(target)
            both = merge_join(old, rows, keys, "left_anti").unionByName(rows) if replace else old.unionByName(merge_join(rows, old, keys, "left_anti"))
        else:
            both = rows
        replace_table(both, target)
        out[name] = spark.read.parquet(target)
    return out


# ---------------------------------------------------------------- views


def entity_details(s: Store) -> DataFrame:
    """Per entity the names of its documents, sorted, and their number."""
    seen = s.occurrences.join(s.documents.select("document_id", "document_name"), "document_id").groupBy("entity_id").agg(
        F.array_join(F.array_sort(F.collect_set("document_name")), ",").alias("documents"), F.countDistinct("document_id").alias("document_count")
    )
    out = s.entities.join(seen, s.entities.unique_entity_id == seen.entity_id, "left")
    return out.select("unique_entity_id", "entity_type", "canonical_name", "documents", F.coalesce("document_count", F.lit(0)).alias("document_count"))


def relationship_details(s: Store) -> DataFrame:
    """Relationships with the names of both ends and of the documents that state them, sorted (null where none is known)."""
    e = s.entities.select("unique_entity_id", "canonical_name", "entity_type")
    a = e.select(F.col("unique_entity_id").alias("from_entity_id"), F.col("canonical_name").alias("from_name"), F.col("entity_type").alias("from_type"))
    b = e.select(F.col("unique_entity_id").alias("to_entity_id"), F.col("canonical_name").alias("to_name"), F.col("entity_type").alias("to_type"))
    out = s.relationships.join(a, "from_entity_id").join(b, "to_entity_id").select("relationship_id", "relationship_type", "from_name", "from_type", "to_name", "to_type", "access_policy")
    if s.relationship_occurrences is None:
        return out.withColumn("documents", F.lit(None).cast("string"))
    seen = s.relationship_occurrences.join(s.documents.select("document_id", "document_name"), "document_id").groupBy("relationship_id").agg(F.array_join(F.array_sort(F.collect_set("document_name")), ",").alias("documents"))
    return out.join(seen, "relationship_id", "left")


def entity_communities(entities: DataFrame, members: DataFrame, levels: tuple[str, ...] = ("micro", "meso", "macro")) -> DataFrame:
    """One row per entity with its community at each level; members(entity_id, level, community_id)."""
    wide = members.groupBy("entity_id").pivot("level", list(levels)).agg(F.min("community_id"))
    for level in levels:
        wide = wide.withColumnRenamed(level, f"community_{level}")
    return entities.join(wide, entities.unique_entity_id == wide.entity_id, "left").drop("entity_id")


def community_members(members: DataFrame) -> DataFrame:
    return members.groupBy("level", "community_id").agg(F.count("*").alias("actual_member_count"))


def community_relationships(rels: DataFrame, members: DataFrame) -> DataFrame:
    """(level, community_id, relationship_id): relationships with both ends in one community, as one set operation."""
    a = members.select(F.col("entity_id").alias("from_entity_id"), "level", "community_id")
    b = members.select(F.col("entity_id").alias("to_entity_id"), "level", F.col("community_id").alias("other"))
    return rels.join(a, "from_entity_id").join(b, ["to_entity_id", "level"]).where("community_id = other").select("level", "community_id", "relationship_id")


def cross_community(rels: DataFrame, members: DataFrame, level: str) -> DataFrame:
    """Relationships between different communities of a level."""
    m = members.where(F.col("level") == level)
    a = m.select(F.col("entity_id").alias("from_entity_id"), F.col("community_id").alias("from_community"))
    b = m.select(F.col("entity_id").alias("to_entity_id"), F.col("community_id").alias("to_community"))
    return rels.join(a, "from_entity_id").join(b, "to_entity_id").where("from_community <> to_community").select("relationship_id", "relationship_type", "from_community", "to_community")


#: The store's tables and their columns.
SCHEMAS = {
    "documents": "document_id STRING NOT NULL, document_name STRING, file_path STRING, access_tags ARRAY<STRING>",
    "entities": "unique_entity_id STRING NOT NULL, entity_type STRING, canonical_name STRING, name_variants ARRAY<STRING>, cluster_size INT, attributes STRING, merge_reasoning STRING",
    "relationships": "relationship_id STRING NOT NULL, relationship_type STRING, from_entity_id STRING, to_entity_id STRING, attributes STRING, access_policy STRING",
    "entity_occurrences": "entity_id STRING NOT NULL, document_id STRING NOT NULL, page_numbers ARRAY<INT>",
    "relationship_occurrences": "relationship_id STRING NOT NULL, document_id STRING NOT NULL, page_numbers ARRAY<INT>",
    "communities": "entity_id STRING NOT NULL, level STRING NOT NULL, resolution DOUBLE, community STRING",
    "community_summaries": "community_key STRING NOT NULL, level STRING, community_id STRING, summary STRING, entity_count BIGINT, relationship_count BIGINT, density DOUBLE",
}


def create_tables(spark: SparkSession, database: str) -> None:
    """The empty tables of a store as parquet tables of a database; what exists stays."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}")
    for name, columns in SCHEMAS.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def summary_of_entity(entity_communities: DataFrame, summaries: DataFrame, level: str) -> DataFrame:
    """(entity_id, summary): the summary of each entity's community at a level."""
    m = entity_communities.where(F.col("level") == level).select("entity_id", "level", F.col("community_id").cast("string").alias("community_id"))
    s = summaries.select("level", F.col("community_id").cast("string").alias("community_id"), "summary")
    return m.join(s, ["level", "community_id"]).select("entity_id", "summary")
