"""Mention graphs from extraction results, and their merge into entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.components import connected_components
from gridloom.operators.store import RESERVED_EDGE, RESERVED_NODE
from gridloom.session import running_before

EXTRACTION = "entities array<struct<id string, type string, attributes map<string,string>>>, relationships array<struct<from_id string, to_id string, type string, attributes map<string,string>>>"


def protect(attrs: Column, reserved: tuple[str, ...]) -> Column:
    """Attributes whose names belong to the graph are renamed attr_<name>."""
    return F.transform_keys(attrs, lambda k, _: F.when(k.isin(*reserved), F.concat(F.lit("attr_"), k)).otherwise(k))


def page_list(own: Column, document: Column) -> Column:
    """A page list, a single page, or nothing (then the document's pages) as array<int>; own is JSON text."""
    many = F.from_json(own, "array<int>")
    one = F.when(own.rlike(r"^\s*\d+\s*$"), F.array(F.trim(own).cast("int")))
    none = F.array().cast("array<int>")
    return F.coalesce(one, F.when(F.size(many) > 0, many), document, none)


def mentions(extractions: DataFrame) -> DataFrame:
    """(node_id, ord, original_id, type, source_doc, page_numbers, attrs): one node per mention.

    extractions(source_doc, doc_ord, pages array<int>, entities, relationships) holds one result per document. Numbers run
    over all documents in their order, by running sums of the counts per document.
    """
    counts = extractions.select("source_doc", "doc_ord", F.greatest(F.size("entities"), F.lit(0)).alias("n"))
    start = running_before(counts, ["doc_ord"], "n", "start").select("source_doc", "start")
    each = extractions.join(start, "source_doc").select("source_doc", "pages", "start", F.posexplode("entities").alias("pos", "e"))
    no = F.col("start") + F.col("pos")
    original = F.coalesce(F.nullif(F.col("e.id"), F.lit("")), F.concat(F.lit("ENTITY_"), no.cast("string")))
    own = F.coalesce(F.col("e.attributes")["page_numbers"], F.col("e.attributes")["page_number"])
    attrs = protect(F.coalesce(F.map_filter("e.attributes", lambda k, v: ~k.isin("page_numbers", "page_number")), F.create_map().cast("map<string,string>")), RESERVED_NODE)
    return each.select(
        F.concat(F.lit("node_"), (no + 1).cast("string"), F.lit("_"), original).alias("node_id"), (no + 1).alias("ord"), original.alias("original_id"),
        F.coalesce("e.type", F.lit("Unknown")).alias("type"), "source_doc", page_list(own, F.col("pages")).alias("page_numbers"), attrs.alias("attrs"),
    )


def mention_edges(extractions: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst, ord, relationship_type, source_doc, attrs): ends resolved inside their document, unknown ends dropped.

    An id that a document uses twice means the later mention; of parallel relationships the last type wins and their
    attributes are merged, later ones over earlier ones.
    """
    ids = nodes.groupBy("source_doc", "original_id").agg(F.max_by("node_id", "ord").alias("node_id"))
    each = extractions.select("source_doc", "doc_ord", F.posexplode("relationships").alias("pos", "r"))
    a = ids.select("source_doc", F.col("original_id").alias("from_id"), F.col("node_id").alias("src"))
    b = ids.select("source_doc", F.col("original_id").alias("to_id"), F.col("node_id").alias("dst"))
    rows = each.select("source_doc", F.struct("doc_ord", "pos").alias("ord"), F.col("r.from_id").alias("from_id"), F.col("r.to_id").alias("to_id"), F.coalesce("r.type", F.lit("RELATED_TO")).alias("relationship_type"), protect(F.coalesce("r.attributes", F.create_map().cast("map<string,string>")), RESERVED_EDGE).alias("attrs"))
    joined = rows.join(a, ["source_doc", "from_id"]).join(b, ["source_doc", "to_id"])
    return collapse_edges(joined.select("src", "dst", "ord", "relationship_type", "source_doc", "attrs"))


def collapse_edges(edges: DataFrame) -> DataFrame:
    """One edge per ordered pair: last type, attributes merged cell by cell with the latest winning."""
    types = edges.groupBy("src", "dst").agg(F.max_by(F.struct("relationship_type", "source_doc"), "ord").alias("t"), F.max("ord").alias("ord"))
    cells = edges.select("src", "dst", "ord", F.explode("attrs").alias("k", "v")).groupBy("src", "dst", "k").agg(F.max_by("v", "ord").alias("v"))
    attrs = cells.groupBy("src", "dst").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("k", "v")))).alias("attrs"))
    return types.join(attrs, ["src", "dst"], "left").select("src", "dst", "ord", "t.relationship_type", "t.source_doc", F.coalesce("attrs", F.create_map().cast("map<string,string>")).alias("attrs"))


def remap_chunks(entities: DataFrame, relationships: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ids of results that came in chunks: <id>_chunk<k>; an end unseen in its chunk means the latest chunk before it.

    entities(doc, chunk, id), relationships(doc, chunk, from_id, to_id). The latest chunk is found as of the reference's
    chunk within (doc, id).
    """
    named = entities.withColumn("new_id", F.concat("id", F.lit("_chunk"), F.col("chunk").cast("string")))
    ids = named.select("doc", "id", "chunk", "new_id").distinct()

    def resolve(rels: DataFrame, col: str) -> DataFrame:
        left = ids.select("doc", F.col("id").alias(col), "chunk", "new_id", F.lit(0).alias("kind"))
        asked = rels.select("doc", col, "chunk").distinct().select("doc", col, "chunk", F.lit(None).cast("string").alias("new_id"), F.lit(1).alias("kind"))
        w = Window.partitionBy("doc", col).orderBy("chunk", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        known = left.unionByName(asked).withColumn("new_id", F.last("new_id", True).over(w)).where("kind = 1 and new_id is not null")
        return rels.join(known.select("doc", col, "chunk", F.col("new_id").alias(f"{col}_new")), ["doc", col, "chunk"])

    return named, resolve(resolve(relationships, "from_id"), "to_id")


def graph_union(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union of two node or edge tables; the later one's row wins."""
    both = first.withColumn("_o", F.lit(0)).unionByName(second.withColumn("_o", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys and c != "_o"]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_o").alias("r")).select(*keys, "r.*")


def filtered(nodes: DataFrame, edges: DataFrame, types: list[str] | None = None, documents: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The part of a graph with nodes of these types that these documents mention, and the edges between such nodes."""
    kept = nodes
    if types is not None:
        kept = kept.where(F.col("type").isin(types))
    if documents is not None:
        kept = kept.where(F.col("source_doc").isin(documents))
    ids = kept.select("node_id")
    inside = edges.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    return kept, inside.select(edges.columns)


def statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(metric, key, value): nodes, edges, components, nodes per type and document, edges per type, mean and greatest degree."""
    row = lambda df, metric, key, value: df.select(F.lit(metric).alias("metric"), key.cast("string").alias("key"), value.cast("double").alias("value"))
    degree = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("d"))
    n = nodes.agg(F.count("*").alias("n"))
    linked = connected_components(edges)
    parts = linked.agg(F.countDistinct("component").alias("c"), F.count("*").alias("l"))
    every = n.join(edges.agg(F.count("*").alias("m"))).join(parts).join(degree.agg(F.max("d").alias("top")))
    none = F.lit("")
    out = row(every, "nodes", none, F.col("n"))
    for metric, value in (("edges", F.col("m")), ("components", F.col("c") + F.col("n") - F.col("l")), ("avg_degree", 2 * F.col("m") / F.nullif(F.col("n"), F.lit(0))), ("max_degree", F.coalesce("top", F.lit(0)))):
        out = out.unionByName(row(every, metric, none, value))
    for df, metric, key in ((nodes, "type", "type"), (nodes, "document", "source_doc"), (edges, "relationship", "relationship_type")):
        out = out.unionByName(row(df.groupBy(F.col(key).alias("k")).count(), metric, F.col("k"), F.col("count")))
    return out


# ---------------------------------------------------------------- merge


def representatives(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(node_id, cluster_id, rep): the member with most attributes stands for its cluster, ties to the earliest.

    A node in several clusters counts in the greatest cluster_id, as the later one overwrites.
    """
    one = clusters.groupBy("node_id").agg(F.max("cluster_id").alias("cluster_id"))
    member = nodes.join(one, "node_id", "left").withColumn("cluster_id", F.coalesce("cluster_id", "node_id"))
    rep = member.groupBy("cluster_id").agg(F.min_by("node_id", F.struct(-F.size("attrs"), "ord")).alias("rep"))
    return member.select("node_id", "cluster_id").join(rep, "cluster_id")


def merge_nodes(nodes: DataFrame, reps: DataFrame) -> DataFrame:
    """One node per cluster under the representative's id with the first member's attributes, all documents and pages."""
    rows = nodes.join(reps, "node_id")
    return rows.groupBy(F.col("rep").alias("node_id")).agg(
        F.min("ord").alias("ord"), F.min_by("attrs", "ord").alias("attrs"), F.min_by("type", "ord").alias("type"), F.min_by("original_id", "ord").alias("original_id"),
        F.min_by("source_doc", "ord").alias("source_doc"), F.array_sort(F.collect_set("source_doc")).alias("source_docs"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("page_numbers")))).alias("page_numbers"), F.count("*").cast("int").alias("cluster_size"),
    )


def merge_edges(edges: DataFrame, reps: DataFrame, all_documents: bool = True, multi_edge: bool = False) -> DataFrame:
    """Edges between representatives without self loops; the first edge's type and attributes win per ordered pair.

    all_documents=False keeps only the first and the last document of an edge; multi_edge keeps one edge per type.
    """
    a = reps.select(F.col("node_id").alias("src"), F.col("rep").alias("u"))
    b = reps.select(F.col("node_id").alias("dst"), F.col("rep").alias("v"))
    rows = edges.join(a, "src").join(b, "dst").where("u <> v")
    keys = ["u", "v", "relationship_type"] if multi_edge else ["u", "v"]
    docs = F.array_sort(F.collect_set("source_doc")) if all_documents else F.array_distinct(F.array(F.min_by("source_doc", "ord"), F.max_by("source_doc", "ord")))
    first = F.min_by(F.struct("relationship_type", "attrs", "source_doc"), "ord").alias("f")
    return rows.groupBy(*keys).agg(first, F.min("ord").alias("ord"), docs.alias("source_docs")).select(F.col("u").alias("src"), F.col("v").alias("dst"), "ord", "f.relationship_type", "f.attrs", "f.source_doc", "source_docs")


def merge_reasons(clusters: DataFrame, groups: DataFrame) -> DataFrame:
    """(cluster_id, reasoning): the reasoning of a group whose members are exactly those of the cluster.

    groups(group_id, node_id, reasoning). Sets compare by size and by the number of members they share.
    """
    size = clusters.groupBy("cluster_id").agg(F.count("*").alias("n"))
    group = groups.groupBy("group_id").agg(F.count("*").alias("g"), F.min("reasoning").alias("reasoning"))
    shared = clusters.join(groups.select("group_id", "node_id"), "node_id").groupBy("cluster_id", "group_id").agg(F.count("*").alias("s"))
    return shared.join(size, "cluster_id").join(group, "group_id").where("s = n and s = g").groupBy("cluster_id").agg(F.min_by("reasoning", "group_id").alias("reasoning"))


def reduction(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """(clusters_found, nodes_before, nodes_after, reduction_pct) of one method."""
    c = clusters.agg(F.countDistinct("cluster_id").alias("clusters_found"), F.countDistinct("node_id").alias("m"))
    n = nodes.agg(F.count("*").alias("nodes_before"))
    after = F.col("nodes_before") - F.col("m") + F.col("clusters_found")
    return c.join(n).select("clusters_found", "nodes_before", after.alias("nodes_after"), F.round(100.0 * (F.col("nodes_before") - after) / F.nullif(F.col("nodes_before"), F.lit(0)), 4).alias("reduction_pct"))
