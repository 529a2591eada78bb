"""Attribute-value rows into wide tables, as log-structured upserts.

Every batch becomes a sparse wide delta: one row per key with a map from attribute name to a cell that carries
its own version. Compaction keeps, for every cell, the value of the greatest version; it aggregates cells, never
whole rows, so a key with very many versions is combined on the map side and no task holds a group.

Batches that arrive one after another are kept as sorted runs (`SortedRuns`): each is bucketed by row key and sorted by
(row key, attribute name) once, when it is written. Compaction and the wide rows then read bucket by bucket over all runs,
with no further shuffle of cells.

Defined results: a null blob, a blob that is no JSON object and a key without attributes give a row with only
nulls; repeated rows and ties of version keep the greater value; names that the catalogue does not hold are kept as
text in `other`; an empty table gives an empty result; columns of the input beside those named are ignored.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.parsing import CASTS, parse_json_object, readable
from gridloom.session import delete_path, merge_join, shared_dir


@dataclass(frozen=True)
class Attribute:
    owner_table: str
    attr_name: str
    column_name: str
    value_type: str


#: The catalogue is a schema; one longer than this is not a list of columns.
MAX_CATALOG = 10_000


def load_catalog(df: DataFrame) -> list[Attribute]:
    rows = df.select("owner_table", "attr_name", "column_name", "value_type").limit(MAX_CATALOG + 1).collect()
    if len(rows) > MAX_CATALOG:
        raise ValueError(f"an attribute catalogue of more than {MAX_CATALOG} names is not a schema")
    return [Attribute(*r) for r in rows]


def sparse_delta(df: DataFrame, owner: str, key: str, blob: str, version: Column) -> DataFrame:
    """(owner_table, row_key, delta): a narrow step, one input row to one delta."""
    ver = version.alias("version")
    values = parse_json_object(F.col(blob))
    delta = F.transform_values(values, lambda _, v: F.struct(ver, v.alias("raw")))
    return df.select(F.lit(owner).alias("owner_table"), F.col(key).alias("row_key"), delta.alias("delta"))


def rows_to_delta(df: DataFrame, owner: str, key: str, name: str, value: str, version: Column) -> DataFrame:
    """The same delta from rows of entity, attribute, value: one sparse cell each; compaction joins them."""
    cell = F.struct(version.alias("version"), F.col(value).cast("string").alias("raw"))
    delta = F.when(F.col(name).isNotNull(), F.create_map(F.col(name), cell))
    return df.select(F.lit(owner).alias("owner_table"), F.col(key).alias("row_key"), delta.alias("delta"))


def compact_cells(*runs: DataFrame) -> DataFrame:
    """(owner_table, row_key, attr_name, raw, version): per cell the latest version over all runs."""
    cells = None
    for run in runs:
        part = run.select("owner_table", "row_key", F.explode("delta").alias("attr_name", "cell"))
        cells = part if cells is None else cells.unionByName(part)
    newest = F.max(F.struct(F.col("cell.version").alias("version"), F.col("cell.raw").alias("raw"))).alias("c")
    return cells.groupBy("owner_table", "row_key", "attr_name").agg(newest).select(
        "owner_table", "row_key", "attr_name", "c.raw", "c.version"
    )


class SortedRuns:
    """Runs of versioned cells of one table of runs, every run bucketed by row key and sorted by (row key, attribute name).

    A batch's own cells are compacted before they are written, so a run has one version per cell. The number of buckets is
    fixed for the table; choose it for the size that all live runs together will have.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, name: str | None = None, path: str | None = None):
        self.spark, self.name = spark, name or f"gridloom_runs_{uuid.uuid4().hex}"
        self.path = path or f"{shared_dir(spark)}/gridloom/{self.name}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs = 0

    def append(self, *deltas: DataFrame) -> None:
        """One more run of the cells of these deltas."""
        cells = compact_cells(*deltas).withColumn("run", F.lit(self.runs))
        spread = cells.repartition(self.buckets, "row_key").sortWithinPartitions("row_key", "attr_name")
        spread.write.mode("append").format("parquet").option("path", self.path).bucketBy(self.buckets, "row_key").sortBy("row_key", "attr_name").saveAsTable(self.name)
        self.runs += 1

    def cells(self) -> DataFrame:
        """(owner_table, row_key, attr_name, raw, version): the latest version of every cell over all runs; reads bucket by bucket."""
        newest = F.max(F.struct("version", "raw")).alias("c")
        return self.spark.table(self.name).groupBy("row_key", "attr_name", "owner_table").agg(newest).select("owner_table", "row_key", "attr_name", "c.raw", "c.version")

    def compact(self) -> SortedRuns:
        """All runs merged into the first one of a new table; the buckets stay where they are."""
        merged = SortedRuns(self.spark, self.buckets)
        cells = self.cells().withColumn("run", F.lit(0)).sortWithinPartitions("row_key", "attr_name")
        cells.write.format("parquet").option("path", merged.path).bucketBy(self.buckets, "row_key").sortBy("row_key", "attr_name").saveAsTable(merged.name)
        merged.runs = 1
        return merged

    def drop(self) -> None:
        """Forget the table and delete its files; call only when nothing lazy still reads it."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        delete_path(self.spark, self.path)


def typed_cells(cells: DataFrame, catalog: list[Attribute]) -> DataFrame:
    """Adds column_name and value_type; a name outside the catalogue is a text column of its own."""
    known = F.create_map(
        *[x for a in catalog for x in (F.lit(f"{a.owner_table}\t{a.attr_name}"), F.struct(F.lit(a.column_name).alias("c"), F.lit(a.value_type).alias("t")))]
    ) if catalog else F.lit(None).cast("map<string,struct<c:string,t:string>>")
    hit = F.try_element_at(known, F.concat_ws("\t", "owner_table", "attr_name"))
    return cells.withColumn("hit", hit).select(
        "*",
        F.coalesce("hit.c", "attr_name").alias("column_name"),
        F.coalesce("hit.t", F.lit("text")).alias("value_type"),
        F.col("hit").isNotNull().alias("in_catalog"),
    ).drop("hit")


def unreadable_cells(cells: DataFrame) -> DataFrame:
    """Typed cells that hold something which denotes no value of their type."""
    v = F.col("raw")
    return cells.where((F.col("value_type") != "text") & v.isNotNull() & ~v.rlike(r"(?U)^\s*$") & ~readable(v, F.col("value_type")))


def to_wide(keys: DataFrame, cells: DataFrame, catalog: list[Attribute], owner: str) -> DataFrame:
    """One row per key of one owner table with the typed columns of the catalogue and `other`.

    Where one row spells a column in several ways, the readable cell of the latest version wins, then the greater
    value. Columns are conditional aggregates, so partial aggregation runs before the only shuffle.
    """
    own = [a for a in catalog if a.owner_table == owner]
    kinds = {a.column_name: a.value_type for a in own}
    cells = cells.where(F.col("owner_table") == owner)
    aggs = []
    for column, kind in kinds.items():
        value = CASTS[kind](F.col("raw"))
        mine = (F.col("column_name") == column) & F.col("in_catalog") & value.isNotNull()
        aggs.append(F.max(F.when(mine, F.struct("version", value.alias("v"))))["v"].alias(column))
    extra = F.when(~F.col("in_catalog") & F.col("raw").isNotNull(), F.struct("attr_name", "raw"))
    aggs.append(F.map_from_entries(F.sort_array(F.collect_list(extra))).alias("other"))
    rows = cells.groupBy("row_key").agg(*aggs)
    return merge_join(keys.where(F.col("owner_table") == owner).select("owner_table", "row_key").distinct(), rows, "row_key", "left")
