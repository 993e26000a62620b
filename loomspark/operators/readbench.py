"""How fast samples can be read: lists of samples to read, and rates of the reads."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, functions as F

from loomspark.functions.text import shuffle_key


def read_list(index: DataFrame, n: int, mode: str, seed: int = 0) -> DataFrame:
    """``n`` samples in the order to read them (``place``): the first ones (``seq``), or those of least random key (``random``).

    Only the top n are kept at any time, so nothing is sorted as a whole.
    """
    key = {"seq": F.lpad(F.col("sample_id").cast("string"), 20, "0"), "random": shuffle_key(F.col("sample_id"), seed)}[mode]
    top = index.select("sample_id", "shard_id", "seq_len", key.alias("k")).orderBy("k", "sample_id").limit(n)
    from pyspark.sql import Window

    return top.withColumn("place", F.row_number().over(Window.orderBy("k", "sample_id")) - 1).select("place", "sample_id", "shard_id", "seq_len")


def timed(reads: DataFrame, nbytes: str) -> dict[str, float]:
    """Rows and megabytes a second of reading a table whose rows are of ``nbytes`` bytes each."""
    began = time.perf_counter()
    got = reads.agg(F.count("*").alias("n"), F.coalesce(F.sum(nbytes), F.lit(0)).alias("b")).first()
    seconds = max(time.perf_counter() - began, 1e-9)
    return {"rows": got["n"], "seconds": seconds, "rows_per_second": got["n"] / seconds, "mb_per_second": got["b"] / 1e6 / seconds}
