"""Splits that keep related records together.

Records are linked through any number of key columns (a user, an id, a source). Links carry on, so the unit of a split
is a connected component of the graph of keys (:mod:`loomspark.llm.components`). Components are then ordered by
hash and given whole to the split that lacks most of what they hold.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from loomspark.llm.components import SMALL_GRAPH_EDGES, connected_components


def linked_groups(records: DataFrame, row: str, keys: Sequence[str], small_graph_edges: int = SMALL_GRAPH_EDGES) -> DataFrame:
    """``(row, first_row, size)``: the group of each record, named by its smallest row, through shared non-null keys.

    Records without any key are groups of one. Row ids must be unique and not null. Keys of different columns never
    meet. One key may hold any share of the records: only aggregates by key, made map-side first, and edges between
    keys are shuffled by it, and the last join is one that adaptive execution splits when skewed.
    """
    tagged = [F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{i}:"), F.col(k).cast("string"))) for i, k in enumerate(keys)]
    at = records.select(F.col(row).alias("_row"), *[t.alias(f"_k{i}") for i, t in enumerate(tagged)])
    at = at.withColumn("_key", F.coalesce(*[F.col(f"_k{i}") for i in range(len(keys))]))
    edges = None
    for i in range(1, len(keys)):
        e = at.where(f"_k{i} IS NOT NULL AND _key <> _k{i}").select(F.col("_key").alias("src"), F.col(f"_k{i}").alias("dst"))
        edges = e if edges is None else edges.unionByName(e)

    by_key = at.where("_key IS NOT NULL").groupBy("_key").agg(F.min("_row").alias("first"), F.count("*").alias("n"))
    if edges is not None:
        comps = connected_components(edges, small_graph_edges).withColumnRenamed("vertex", "_key")
        by_key = by_key.join(comps, "_key", "left").withColumn("component", F.coalesce("component", "_key"))
    else:
        by_key = by_key.withColumn("component", F.col("_key"))
    groups = by_key.groupBy("component").agg(F.min("first").alias("first_row"), F.sum("n").alias("size"))
    of_key = by_key.select("_key", "component").join(groups, "component").select("_key", "first_row", "size")
    return at.select(F.col("_row").alias(row), "_key").join(of_key, "_key", "left").select(
        row, F.coalesce("first_row", row).alias("first_row"), F.coalesce("size", F.lit(1).cast("long")).alias("size")
    )


def _assigner(names: list[str], shares: list[float]):
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(r["unit"], r["giant"], r["layers"]) for b in batches for r in b.to_pylist()]
        if not rows:
            return
        layers = sorted({x["layer"] for _, _, ls in rows for x in ls})
        at = {x: i for i, x in enumerate(layers)}
        vectors = np.zeros((len(rows), len(layers)))
        for i, (_, _, ls) in enumerate(rows):
            for x in ls:
                vectors[i, at[x["layer"]]] += x["n"]
        lacking = np.outer(shares, vectors.sum(0))
        full = np.maximum(lacking, 1e-9)
        out = []
        # Largest units first, as only they can't be balanced later; the rest in hash order.
        for i in sorted(range(len(rows)), key=lambda i: (not rows[i][1], -vectors[i].sum() if rows[i][1] else 0, rows[i][0])):
            gain = ((lacking / full) * vectors[i]).sum(1) if not rows[i][1] else (np.minimum(lacking, vectors[i])).sum(1)
            k = int(gain.argmax())
            lacking[k] -= vectors[i]
            out.append((rows[i][0], names[k]))
        yield pa.record_batch([pa.array([u for u, _ in out]), pa.array([s for _, s in out])], names=["unit", "split"])

    return assign


def split_groups(
    grouped: DataFrame,
    group: str,
    layer: str,
    shares: dict[str, float],
    seed: int = 7,
    cells: int = 2048,
    giant_share: float = 0.001,
) -> DataFrame:
    """``(group, split)``: every group whole in one split, with ``shares`` met per layer as nearly as whole groups allow.

    Groups fall by the order of their hash into ``cells`` cells per leading layer, which are assigned as one; groups
    with more than ``giant_share`` of all rows (hence at most ``1 / giant_share`` of them) are assigned one by one and
    first. What one task sees is so bounded by ``cells`` times the layers, whatever the number of groups; a null layer
    counts as a layer of its own. Small inputs have about one group to a cell.
    """
    total = sum(shares.values())
    held = grouped.select(F.col(group).alias("g"), F.coalesce(F.col(layer), F.lit("")).alias("layer")).groupBy("g", "layer").agg(F.count("*").alias("n"))
    per_group = held.groupBy("g").agg(F.max_by("layer", F.struct("n", "layer")).alias("leading"), F.sum("n").alias("size"))
    rows = held.agg(F.sum("n").alias("rows"))
    hashed = F.xxhash64("g", F.lit(seed))
    cell = F.concat_ws("\x00", F.lit("c"), F.lpad(F.pmod(F.shiftrightunsigned(hashed, 32), F.lit(cells)).cast("string"), 8, "0"), F.col("leading"))
    units = (
        per_group.crossJoin(F.broadcast(rows))  # one row
        .withColumn("giant", (F.col("size") > giant_share * F.col("rows")) & (F.col("size") > 1))
        .select("g", "giant", F.when(F.col("giant"), F.concat(F.lit("g\x00"), F.col("g").cast("string"))).otherwise(cell).alias("unit"))
    )
    summed = held.join(units, "g").groupBy("unit", "giant", "layer").agg(F.sum("n").alias("n"))
    vectors = summed.groupBy("unit", "giant").agg(F.collect_list(F.struct("layer", "n")).alias("layers"))
    schema = T.StructType([T.StructField("unit", T.StringType()), T.StructField("split", T.StringType())])
    assigned = vectors.coalesce(1).mapInArrow(_assigner(list(shares), [s / total for s in shares.values()]), schema)
    return units.join(assigned, "unit").select(F.col("g").alias(group), "split")
