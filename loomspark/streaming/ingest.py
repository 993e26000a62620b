"""Streaming ingest: new JSON Lines files are parsed and rows routed by status. Repeated ids all stay, as in a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.operators.routing import usable
from loomspark.sources.jsonl import parse


def stream_records(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """Typed records of a growing folder; ``files_per_trigger`` bounds what is in flight."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", "true").text(folder)
    return parse(lines.select(F.trim("value").alias("line"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("string").alias("file_layer")).where("line <> ''"))


def route_by_status(records: DataFrame, good: str, bad: str, checkpoint: str, once: bool = True):
    """Starts a query that appends usable rows to ``good`` and the others to ``bad``; exactly once per micro-batch.

    A batch's folder is named by its number, so a batch that runs again after a failure replaces what it wrote.
    """

    def batch(df: DataFrame, number: int) -> None:
        df = df.drop("file", "file_layer")
        df.persist()
        fine = usable(F.col("status")) & ~F.col("malformed")
        df.where(fine).write.mode("overwrite").parquet(f"{good}/batch={number}")
        df.where(~fine).write.mode("overwrite").parquet(f"{bad}/batch={number}")
        df.unpersist()

    writer = records.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
