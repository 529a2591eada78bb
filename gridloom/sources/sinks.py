"""Writers: tables, graphs as GraphML, reports, and a cache of model replies."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import Stage, replace_table  # noqa: F401


def append_table(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def _escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ('"', "&quot;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Nodes(node_id, attrs) and edges(src, dst, attrs) as GraphML elements, every attribute as text; header and footer stand in files of their own."""
    data = F.array_join(F.transform(F.map_entries(F.map_filter("attrs", lambda k, v: v.isNotNull())), lambda e: F.concat(F.lit('<data key="'), _escape(e["key"]), F.lit('">'), _escape(e["value"]), F.lit("</data>"))), "")
    n = nodes.select(F.concat(F.lit('<node id="'), _escape(F.col("node_id")), F.lit('">'), data, F.lit("</node>")).alias("value"))
    e = edges.select(F.concat(F.lit('<edge source="'), _escape(F.col("src")), F.lit('" target="'), _escape(F.col("dst")), F.lit('">'), data, F.lit("</edge>")).alias("value"))
    spark = nodes.sparkSession
    one = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1)
    one('<?xml version="1.0" encoding="utf-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', '<graph edgedefault="directed">').write.mode("overwrite").text(f"{path}/a_head")
    n.write.mode("overwrite").text(f"{path}/b_nodes")
    e.write.mode("overwrite").text(f"{path}/c_edges")
    one("</graph>", "</graphml>").write.mode("overwrite").text(f"{path}/d_foot")


def reply_key(*columns: str) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)


def cached_replies(requests: DataFrame, columns: list[str], path: str, ask: Callable[[pd.DataFrame], list[str]]) -> DataFrame:
    """requests with their replies; only requests whose key the cache at path lacks are asked, once each, and then kept.

    ask gets the request columns of one batch and returns a reply per row.
    """
    spark: SparkSession = requests.sparkSession
    keyed = requests.withColumn("key", reply_key(*columns))
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    known = spark.read.schema("key string, reply string").parquet(path) if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p) else spark.createDataFrame([], "key string, reply string")

    def run(frames):
        for pdf in frames:
            yield pd.DataFrame({"key": pdf["key"], "reply": ask(pdf[columns])})

    fresh = keyed.select("key", *columns).dropDuplicates(["key"]).join(known.select("key"), "key", "left_anti").mapInPandas(run, "key string, reply string")
    stage = Stage(fresh, "replies")
    stage.df.write.mode("append").parquet(path)
    return keyed.join(spark.read.schema("key string, reply string").parquet(path), "key").drop("key")
