"""Nearest vectors of a stated set of queries among all vectors, in blocks of matrix products."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def nearest_by_cosine(queries: DataFrame, vectors: DataFrame, id_: str, vector: str, query_block: int = 4096, block: int = 65_536) -> DataFrame:
    """``(id, near, cosine)``: for each query the vector of greatest cosine but itself; ties go to the smaller id.

    Every vector is compared with every query. Both are dealt to blocks by a hash; a task multiplies one block of queries with
    one of vectors and leaves a best per query, and these are reduced by query. Nothing is collected, and what a task
    holds is bounded by the sizes of the blocks, whatever the numbers of queries and vectors.
    """
    q = max(1, -(-queries.count() // query_block))
    v = max(1, -(-vectors.count() // block))
    dealt = lambda n: F.pmod(F.xxhash64(id_), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select(id_, vector, dealt(q).alias("_q"), every(v).alias("_v"))
    held = vectors.select(id_, vector, every(q).alias("_q"), dealt(v).alias("_v"))
    best = asked.groupBy("_q", "_v").cogroup(held.groupBy("_q", "_v")).applyInArrow(lambda a, b: _best(a, b), f"{id_} bigint, near bigint, cosine double")
    return best.groupBy(id_).agg(F.max_by("near", F.struct("cosine", (-F.col("near")).alias("n"))).alias("near"), F.max("cosine").alias("cosine"))


def _unit(rows: pa.ChunkedArray) -> np.ndarray:
    x = np.array(rows.to_pylist(), np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)


def _best(asked: pa.Table, held: pa.Table, at_once: int = 4096) -> pa.Table:
    names = asked.column(0).to_numpy()
    best, near = np.full(len(names), -np.inf), np.zeros(len(names), np.int64)
    if len(names) and held.num_rows:
        q = _unit(asked.column(1))
        for at in range(0, held.num_rows, at_once):
            part = held.slice(at, at_once)
            who = part.column(0).to_numpy()
            c = q @ _unit(part.column(1)).T
            c[names[:, None] == who[None, :]] = -np.inf
            top = c.max(1)
            # The smallest id among equals, here and against what was found before.
            first = np.where(c == top[:, None], who[None, :], np.iinfo(np.int64).max).min(1)
            better = (top > best) | ((top == best) & (first < near))
            best, near = np.where(better, top, best), np.where(better, first, near)
    ok = np.isfinite(best)
    return pa.table([pa.array(names[ok]), pa.array(near[ok]), pa.array(best[ok])], names=[asked.schema.names[0], "near", "cosine"])
