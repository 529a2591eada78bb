"""Attribute rows that arrive as a stream: every micro-batch is appended as a sorted run of versioned cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.operators.wide import compact_cells, sparse_delta


def write_deltas(stream: DataFrame, owner: str, key: str, blob: str, version: Column, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends each micro-batch's cells as one run; a batch that is replayed overwrites its own run, so cells stay exact."""

    def put(batch: DataFrame, number: int) -> None:
        cells = compact_cells(sparse_delta(batch, owner, key, blob, version))
        cells.sortWithinPartitions("row_key", "attr_name").write.mode("overwrite").parquet(f"{path}/run={number}")

    writer = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def compact_runs(runs: DataFrame) -> DataFrame:
    """The latest version of every cell over the runs written so far."""
    newest = F.max(F.struct("version", "raw")).alias("c")
    return runs.groupBy("owner_table", "row_key", "attr_name").agg(newest).select("owner_table", "row_key", "attr_name", "c.raw", "c.version")
