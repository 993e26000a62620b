"""Exact distribution statistics that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F


def nearest_rank(values: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group: n, sum, mean, min, max and nearest-rank percentiles ``sorted[round_half_even(q * (n - 1))]``.

    Values are first counted by (group, value), map-side; the running sum then goes over a group's *different* values
    (lengths: some thousands), not over its rows. Null values are left out; a group without values doesn't occur.
    """
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    order = Window.partitionBy(*by).orderBy(value)
    every = Window.partitionBy(*by)
    ranked = counts.withColumn("_upto", F.sum("_c").over(order)).withColumn("_n", F.sum("_c").over(every))

    def at(q: float) -> Column:
        rank = F.rint(F.lit(q) * (F.col("_n") - 1)) + 1
        return F.min(F.when(F.col("_upto") >= rank, F.col(value)))

    return ranked.groupBy(*by).agg(
        F.max("_n").alias("n"),
        F.sum(F.col("_c") * F.col(value)).alias("total"),
        (F.sum(F.col("_c") * F.col(value)) / F.sum("_c")).alias("mean"),
        F.min(value).alias("least"),
        F.max(value).alias("most"),
        *[at(q).alias(name) for name, q in shares.items()],
    )


def interpolated(values: DataFrame, by: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles cut to integers, for anchor positions."""
    aggs = [F.percentile(F.col(value), F.lit(q)).cast("bigint").alias(name) for name, q in shares.items()]
    first = [F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most")]
    return values.groupBy(*by).agg(*first, *aggs) if by else values.agg(*first, *aggs)
