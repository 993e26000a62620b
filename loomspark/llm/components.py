"""Connected components by frontier breadth-first search from many seeds at once.

Each level of the operator
1. ranks vertices by (degree, hash) and makes every vertex that outranks all its neighbours a seed,
2. grows all seeds concurrently, wave by wave: the frontier's labels reach the vertices whose best neighbour it holds,
3. turns edges between differently labelled regions into the edges of a much smaller graph of seeds,
4. merges that graph, in one bounded task if it has at most ``small_graph_edges`` edges, else by another level. The
   first level always runs, however small the graph is.

Adjacency stays a table of edges, hash-partitioned by vertex, never a list in a row, so a hub with a third of all
edges is only a skewed partition that adaptive execution splits. Hubs become seeds, hence stars end in one wave.
Nothing is collected to the driver but row counts. Seeds are pairwise non-adjacent, so every level at least halves the
vertices that still have edges; ranks use a hash, so the expected depth of a wave chain is logarithmic.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomspark.runtime import discard, materialize

SMALL_GRAPH_EDGES = 10_000
_LOG = logging.getLogger(__name__)


def _union_find_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict = {}

    def root(x):
        r = x
        while parent.setdefault(r, r) != r:
            r = parent[r]
        while parent[x] != r:
            parent[x], x = r, parent[x]
        return r

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
    if parent:
        keys = list(parent)
        yield pa.record_batch([pa.array(keys), pa.array([root(k) for k in keys])], names=["vertex", "component"])


def connected_components(edges: DataFrame, small_graph_edges: int = SMALL_GRAPH_EDGES, _level: int = 0) -> DataFrame:
    """``edges(src, dst)`` of one orderable type -> ``(vertex, component)``; component is one of its vertices.

    Null ends and self loops are dropped, repeated and reversed edges count once, an empty table gives an empty one.
    A vertex without an edge to another does not occur in the result.
    """
    vertex_type = edges.schema["src"].dataType.simpleString()
    pairs = (
        edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))
        .where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct()
    )
    pairs = materialize(pairs)
    n = pairs.count()
    _LOG.info("level %d: %d edges", _level, n)
    if not n or (_level and n <= small_graph_edges):
        out = materialize(pairs.coalesce(1).mapInArrow(_union_find_batches, f"vertex {vertex_type}, component {vertex_type}"))
        discard(pairs)
        return out

    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    degree = both.groupBy("a").agg(F.count("*").alias("d"))
    ranked = degree.select("a", F.struct((-F.col("d")).alias("d"), F.xxhash64("a", F.lit(_level)).alias("h"), F.col("a").alias("v")).alias("r"))
    # Edges symmetric: what a sends along its edges is what each b hears about its neighbours.
    heard = both.join(ranked, "a").groupBy("b").agg(F.min("r").alias("best"))
    parents = materialize(
        heard.join(ranked, heard.b == ranked.a).select(
            F.col("a").alias("v"), F.when(F.col("best") < F.col("r"), F.col("best.v")).alias("parent")
        )
    )

    frontier = materialize(parents.where("parent IS NULL").select("v", F.col("v").alias("label")))
    waves = [frontier]
    waiting = parents.where("parent IS NOT NULL")
    while True:
        reached = materialize(waiting.join(frontier.withColumnRenamed("v", "parent"), "parent").select("v", "label"))
        if reached.isEmpty():
            break
        waves.append(reached)
        frontier = reached
    labels = waves[0]
    for wave in waves[1:]:
        labels = labels.unionByName(wave)

    left = labels.select(F.col("v").alias("a"), F.col("label").alias("src"))
    right = labels.select(F.col("v").alias("b"), F.col("label").alias("dst"))
    seeds = connected_components(pairs.join(left, "a").join(right, "b").where("src <> dst").select("src", "dst"), small_graph_edges, _level + 1)
    out = materialize(
        labels.join(seeds.withColumnRenamed("vertex", "label"), "label", "left").select(
            F.col("v").alias("vertex"), F.coalesce("component", "label").alias("component")
        )
    )
    for done in (pairs, parents, *waves, seeds):
        discard(done)
    return out
