"""Session factory, shared-folder tables and join helpers used by every operator."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: dict[str, str] = {}


def get_spark(app: str = "gridloom", cpus: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and benches; a cluster passes its own session to the operators."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
    )
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one where it is unset and all runs in one process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {master} share")
    if "dir" not in _OWN_DIR:
        _OWN_DIR["dir"] = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, _OWN_DIR["dir"], ignore_errors=True)
    return "file://" + _OWN_DIR["dir"]


def delete_path(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Shuffle files of a query are deleted when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession):
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


class Stage:
    """A table written once to the shared folder and read back: cuts lineage and survives lost executors."""

    def __init__(self, df: DataFrame, label: str = "stage", partition_by: list[str] | None = None):
        self.spark = df.sparkSession
        self.path = f"{shared_dir(self.spark)}/gridloom/{label}-{uuid.uuid4().hex}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        with _shuffles_dropped(self.spark):
            writer.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        """Delete the table; call only when nothing lazy still reads it."""
        delete_path(self.spark, self.path)


class Scratch:
    """The tables that one run of an operator writes; they are deleted when its result has been written."""

    def __init__(self) -> None:
        self.stages: list[Stage] = []

    def stage(self, df: DataFrame, label: str = "stage") -> DataFrame:
        self.stages.append(Stage(df, label))
        return self.stages[-1].df

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        for s in self.stages:
            s.drop()


def merge_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join of two sides that both grow with the data: sorted and merged, never broadcast whatever Spark guesses of its size."""
    return left.join(right.hint("merge"), on, how)


def replace_table(df: DataFrame, path: str) -> None:
    """Truncate and reload: the new content is written beside the old one, the old one is set aside, and the new one takes its
    place; the old one is deleted last. After a crash between the two renames the content set aside is put back first."""
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    new, here, aside = (fs_path(path + end) for end in (".new", "", ".old"))
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(aside) and not fs.exists(here):
        fs.rename(aside, here)
    df.write.mode("overwrite").parquet(path + ".new")
    fs.delete(aside, True)
    if fs.exists(here) and not fs.rename(here, aside) or not fs.rename(new, here):
        raise OSError(f"cannot replace {path}")
    fs.delete(aside, True)


def materialize(df: DataFrame, label: str = "stage") -> DataFrame:
    return Stage(df, label).df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: A key is hot when it holds more than one in HOT_SHARE of all rows, and more than HOT_LEAST, so there are at most HOT_SHARE hot keys.
HOT_SHARE, HOT_LEAST = 1000, 10_000


def skew_join(big: DataFrame, lookup: DataFrame, counts: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of rows with a lookup that is unique per key.

    counts holds every key of big once with the number of its rows in column n; it and lookup must be cheap to read
    again. The keys of more than total / HOT_SHARE rows, at most HOT_SHARE of them whatever the data, never enter the shuffle:
    their rows are held back by a broadcast of those keys and meet their part of the lookup by another; without such a part
    they are dropped there. The rest goes by a shuffle join in which no key is large.
    """
    total = counts.agg(F.sum(n)).first()[0] or 0
    limit = max(total / HOT_SHARE, HOT_LEAST)
    hot_rows = counts.where(F.col(n) > limit).select(*keys).limit(HOT_SHARE + 1).collect()
    if not hot_rows:
        return merge_join(big, lookup, keys)
    assert len(hot_rows) <= HOT_SHARE
    hot = F.broadcast(big.sparkSession.createDataFrame(hot_rows, counts.select(*keys).schema))
    theirs = lookup.join(hot, keys, "left_semi").limit(HOT_SHARE + 1).collect()
    cold = merge_join(big.join(hot, keys, "left_anti"), lookup, keys)
    if not theirs:
        return cold
    return cold.unionByName(big.join(F.broadcast(big.sparkSession.createDataFrame(theirs, lookup.schema)), keys))


def running_before(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """Adds the sum of value over all rows before, in the given order of distinct rows, without a single task for all.

    Rows are range-partitioned and written with their partition; sums run inside partitions and over partitions.
    """
    from pyspark.sql import Window

    part = Stage(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranged").df
    sums = part.groupBy("_part").agg(F.sum(value).alias("_s"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    shift = sums.select("_part", F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum(value).over(inside), F.lit(0))
    return part.withColumn("_own", own).join(F.broadcast(shift), "_part").withColumn(name, F.col("_own") + F.col("_shift")).drop("_part", "_own", "_shift")
