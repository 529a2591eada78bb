"""Queries of the general data-quality operators (p3, p7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.operators import references, wide
from gridloom.session import table


def _dangling(spark, d):
    parents = [references.Parent("entities", table(spark, d, "entities"), "unique_entity_id"), references.Parent("source_documents", table(spark, d, "source_documents"), "document_id")]
    refs = [
        references.Reference("relationships", table(spark, d, "relationships"), {"from_entity_id": "entities", "to_entity_id": "entities"}),
        references.Reference("entity_occurrences", table(spark, d, "entity_occurrences"), {"document_id": "source_documents"}),
    ]
    return references.dangling_references(parents, refs)


def p3_found(spark, d):
    return _dangling(spark, d).select("ref_table", "ref_field", "load_seq")


def p3_report(spark, d):
    return references.dangling_report(_dangling(spark, d))


def _runs(spark, d):
    version = F.struct("created_at", "load_seq")
    return [wide.sparse_delta(table(spark, d, owner), owner, "load_seq", "attributes", version) for owner in ("entities", "relationships")]


def p7_found(spark, d):
    catalog = wide.load_catalog(table(spark, d, "attribute_catalog"))
    cells = wide.typed_cells(wide.compact_cells(*_runs(spark, d)), catalog)
    return wide.unreadable_cells(cells).select("owner_table", F.col("row_key").alias("load_seq"), "attr_name")


def _wide(owner):
    def run(spark, d):
        catalog = wide.load_catalog(table(spark, d, "attribute_catalog"))
        delta = wide.sparse_delta(table(spark, d, owner), owner, "load_seq", "attributes", F.struct("created_at", "load_seq"))
        out = wide.to_wide(delta, wide.typed_cells(wide.compact_cells(delta), catalog), catalog, owner)
        other = F.to_json(F.col("other"))
        return out.withColumnRenamed("row_key", "load_seq").withColumn("other", F.coalesce(other, F.lit("{}")))

    return run


def p7_states(spark, d):
    """The latest cell of every attribute of an entity and the load it comes from: entities arrive month by month, one run each."""
    entities = table(spark, d, "entities").where("unique_entity_id is not null")
    month = F.date_format("created_at", "yyyy-MM")
    keyed = entities.withColumn("batch", F.pmod(F.xxhash64(F.coalesce(month, F.lit(""))), F.lit(BATCHES)))
    runs = wide.SortedRuns(spark)
    for batch in range(BATCHES):
        runs.append(wide.sparse_delta(keyed.where(F.col("batch") == batch), "entities", "unique_entity_id", "attributes", F.struct("created_at", "load_seq")))
    return runs.cells().select(F.col("row_key").alias("unique_entity_id"), "attr_name", F.col("version.load_seq").alias("load_seq"))


#: Batches that the months of the load history are dealt into.
BATCHES = 4

_REFS = """
WITH par AS (
  SELECT 'entities' AS target, lower(trim(unique_entity_id)) AS nk, min(created_at) AS f, bool_or(deleted_at IS NULL) AS live
  FROM entities WHERE trim(unique_entity_id) <> '' GROUP BY ALL
  UNION ALL
  SELECT 'source_documents', lower(trim(document_id)), min(created_at), bool_or(deleted_at IS NULL)
  FROM source_documents WHERE trim(document_id) <> '' GROUP BY ALL),
refs AS (
  SELECT 'relationships' AS ref_table, 'from_entity_id' AS ref_field, load_seq, created_at, 'entities' AS target, lower(trim(from_entity_id)) AS nk FROM relationships
  UNION ALL SELECT 'relationships', 'to_entity_id', load_seq, created_at, 'entities', lower(trim(to_entity_id)) FROM relationships
  UNION ALL SELECT 'entity_occurrences', 'document_id', load_seq, created_at, 'source_documents', lower(trim(document_id)) FROM entity_occurrences),
hit AS (
  SELECT r.*, CASE WHEN p.nk IS NULL THEN 'missing' WHEN NOT live THEN 'deleted' WHEN r.created_at < p.f THEN 'late' END AS reason
  FROM refs r LEFT JOIN par p ON p.target = r.target AND p.nk = r.nk WHERE r.nk IS NOT NULL AND r.nk <> '')
"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p7_found": p7_found, "p7_states": p7_states, "p7_wide_entities": _wide("entities"), "p7_wide_relationships": _wide("relationships")}
_CELLS = r"""
WITH b AS (SELECT 'entities' AS owner_table, load_seq, attributes AS j FROM entities UNION ALL SELECT 'relationships', load_seq, attributes FROM relationships),
k AS (SELECT owner_table, load_seq, j, unnest(json_keys(j)) AS attr_name FROM b WHERE json_valid(j) AND json_type(j) = 'OBJECT'),
v AS (SELECT k.owner_table, load_seq, k.attr_name, value_type, json_extract_string(j, '$."' || k.attr_name || '"') AS raw
  FROM k JOIN attribute_catalog c ON c.owner_table = k.owner_table AND c.attr_name = k.attr_name WHERE value_type <> 'text'),
n AS (SELECT *, lower(trim(raw)) AS t, regexp_replace(regexp_replace(lower(trim(raw)), '^(inr|rs\.?|₹)\s*', ''), '\s*/-$', '') AS n FROM v WHERE raw IS NOT NULL AND trim(raw) <> '')
SELECT owner_table, load_seq, attr_name FROM n WHERE NOT coalesce(CASE value_type
  WHEN 'bigint' THEN regexp_full_match(n, '[+-]?(\d+|\d{1,3}(,\d{3})+|\d{1,2}(,\d{2})*,\d{3})(\.0*)?')
  WHEN 'double' THEN regexp_full_match(regexp_replace(n, '\s*(%|per cent)$', ''), '[+-]?(\d+|\d{1,3}(,\d{3})+)(\.\d*)?')
  WHEN 'boolean' THEN t IN ('true', 'false', 'yes', 'no', 'y', 'n', '1', '0', 't', 'f')
  WHEN 'date' THEN try_strptime(t, ['%Y-%m-%d', '%Y-%m-%dt%H:%M:%S', '%d/%m/%Y', '%m/%d/%Y', '%d.%m.%Y', '%d-%b-%Y', '%d %B %Y', '%B %d, %Y']) IS NOT NULL END, false)
""".replace("\\\\", "\\")

SQL = {
    "p7_states": """
WITH b AS (SELECT unique_entity_id, load_seq, created_at, attributes AS j FROM entities WHERE unique_entity_id IS NOT NULL AND json_valid(attributes) AND json_type(attributes) = 'OBJECT'),
k AS (SELECT DISTINCT unique_entity_id, load_seq, created_at, unnest(json_keys(j)) AS attr_name FROM b)
SELECT unique_entity_id, attr_name, arg_max(load_seq, (coalesce(created_at, TIMESTAMP '0001-01-01'), load_seq)) AS load_seq FROM k GROUP BY ALL""",
    "p7_found": _CELLS,
    "p3_found": _REFS + "SELECT ref_table, ref_field, load_seq FROM hit WHERE reason IS NOT NULL",
    "p3_report": _REFS + "SELECT ref_table, ref_field, strftime(created_at, '%Y-%m') AS month, reason, count(*) AS n_refs FROM hit WHERE reason IS NOT NULL GROUP BY ALL",
}
