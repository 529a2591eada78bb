"""References to records that do not exist.

Parent keys become integers and sorted contiguous integers compress into runs; every distinct reference key is
matched as of the preceding run start and is orphaned when it lies beyond that run's end. Runs are built from
parents with a live row and carry the latest first_created of their keys: a reference older than that, and every
key outside the runs, is settled by an equality join on those few keys (missing, deleted or late). Keys that are
not 16 hexadecimal digits take that join directly.

References are grouped to distinct keys before any shuffle of theirs, so a key held by a third of all rows costs
one row per map task. Runs never cross a bucket: buckets are quantile ranges of parent keys, so dense as well as
hashed keys spread evenly.

Defined results: null and blank references are no cases; keys compare without case and outer blanks; a null
created_at on either side is never late; repeated rows are reported each; no parents at all makes every reference
missing; empty references give an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.keys import hex_key_int, norm_key
from gridloom.session import materialize, merge_join, skew_join


@dataclass(frozen=True)
class Parent:
    name: str
    df: DataFrame
    key: str


@dataclass(frozen=True)
class Reference:
    table: str
    df: DataFrame
    fields: dict[str, str]  # field -> name of the parent
    row_id: str = "load_seq"


def parent_keys(parents: list[Parent]) -> DataFrame:
    """(target, nk, ik, first_created, live): one row per key."""
    out = None
    for p in parents:
        part = (
            p.df.select(F.lit(p.name).alias("target"), norm_key(F.col(p.key)).alias("nk"), "created_at", "deleted_at")
            .where("nk is not null")
            .groupBy("target", "nk")
            .agg(F.min("created_at").alias("first_created"), F.max(F.col("deleted_at").isNull()).alias("live"))
        )
        out = part if out is None else out.unionByName(part)
    return out.withColumn("ik", hex_key_int(F.col("nk")))


def reference_rows(refs: list[Reference]) -> DataFrame:
    """(ref_table, ref_field, load_seq, target, nk, created_at): one scan of each table."""
    out = None
    for r in refs:
        fields = F.array(*[F.struct(F.lit(f).alias("ref_field"), F.lit(t).alias("target"), norm_key(F.col(f)).alias("nk")) for f, t in r.fields.items()])
        part = r.df.select(F.lit(r.table).alias("ref_table"), F.col(r.row_id).alias("load_seq"), "created_at", F.inline(fields)).where("nk is not null")
        out = part if out is None else out.unionByName(part)
    return out


def compress_runs(keys: DataFrame, by: list[str]) -> DataFrame:
    """Sorted distinct integers ik into runs (start, stop, first_max) within each group of by."""
    w = Window.partitionBy(*by).orderBy("ik")
    fresh = F.when(F.lag("ik").over(w) == F.col("ik") - 1, 0).otherwise(1)
    return (
        keys.withColumn("fresh", fresh)
        .withColumn("run", F.sum("fresh").over(w))
        .groupBy(*by, "run")
        .agg(F.min("ik").alias("start"), F.max("ik").alias("stop"), F.max("first_created").alias("first_max"))
        .drop("run")
    )


def asof_runs(runs: DataFrame, keys: DataFrame, by: list[str]) -> DataFrame:
    """Each row of keys (by, ik, ...) with the stop and first_max of the run that starts at or before ik."""
    extra = [c for c in keys.columns if c not in (*by, "ik")]
    left = runs.select(*by, F.col("start").alias("at"), F.lit(0).alias("kind"), F.struct("stop", "first_max").alias("run"), *[F.lit(None).cast(keys.schema[c].dataType).alias(c) for c in extra])
    right = keys.select(*by, F.col("ik").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast(left.schema["run"].dataType).alias("run"), *extra)
    w = Window.partitionBy(*by).orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        left.unionByName(right)
        .withColumn("run", F.last("run", ignorenulls=True).over(w))
        .where("kind = 1")
        .select(*by, F.col("at").alias("ik"), *extra, F.col("run.stop").alias("stop"), F.col("run.first_max").alias("first_max"))
    )


def dangling_references(parents: list[Parent], refs: list[Reference], buckets: int | None = None) -> DataFrame:
    """(ref_table, ref_field, load_seq, created_at, reason): reason is missing, deleted or late."""
    spark = refs[0].df.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = reference_rows(refs)
    distinct = materialize(rows.groupBy("target", "nk").agg(F.min("created_at").alias("oldest"), F.count("*").alias("n")).withColumn("ik", hex_key_int(F.col("nk"))), "refkeys")
    par = materialize(parent_keys(parents), "parents")

    cuts = par.where("live and ik is not null").agg(F.percentile_approx(F.col("ik").cast("double"), [i / n for i in range(1, n)], 10_000)).first()[0] or [0.0]  # no parents: any cut will do
    bucketizer = Bucketizer(splits=[-float("inf"), *sorted(set(cuts)), float("inf")], inputCol="dk", outputCol="bucket")
    bucket = lambda df: bucketizer.transform(df.withColumn("dk", F.col("ik").cast("double"))).drop("dk")

    runs = compress_runs(bucket(par.where("live and ik is not null").select("target", "ik", "first_created")), ["target", "bucket"])
    placed = asof_runs(runs, bucket(distinct.where("ik is not null")), ["target", "bucket"]).select("target", "nk", "ik", "oldest", "stop", "first_max")
    beyond = F.col("stop").isNull() | (F.col("ik") > F.col("stop"))
    suspect = placed.where(beyond | (F.col("oldest") < F.col("first_max"))).select("target", "nk", "oldest")
    suspect = suspect.unionByName(distinct.where("ik is null").select("target", "nk", "oldest"))

    settled = merge_join(suspect, par.drop("ik"), ["target", "nk"], "left").withColumn(
        "why",
        F.when(F.col("live").isNull(), "missing").when(~F.col("live"), "deleted").when(F.col("oldest") < F.col("first_created"), "late"),
    )
    lookup = materialize(settled.where("why is not null").select("target", "nk", "why", "first_created"), "orphans")
    hit = skew_join(rows, lookup, distinct.select("target", "nk", "n"), ["target", "nk"], "n")
    return hit.where((F.col("why") != "late") | (F.col("created_at") < F.col("first_created"))).select(
        "ref_table", "ref_field", "load_seq", "created_at", F.col("why").alias("reason")
    )


def dangling_report(found: DataFrame) -> DataFrame:
    """Counts per table, field, month of created_at (null where that is null) and reason."""
    month = F.date_format(F.date_trunc("month", "created_at"), "yyyy-MM").alias("month")
    return found.groupBy("ref_table", "ref_field", month, "reason").agg(F.count("*").alias("n_refs"))
