"""Filling containers of fixed capacity: bounded-space online best fit.

Each task packs its items as they come into at most ``open_bins`` open containers per capacity. The open ones' free
spaces are the set bits of an integer, so the tightest one that still takes an item is the lowest set bit at or above
its size. With too many open, the fullest closes first. What is open at the end of a task is handed on as items of
its own to a second packing by groups of tasks, so that small tasks don't leave many half-filled containers.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from loomspark.runtime import materialize

OPEN_BINS = 256
TASKS_PER_GROUP = 64


class BestFit:
    """Open containers of one capacity. A container is named by its number; ``add`` gives the number of an item's."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.most = capacity, open_bins
        self.mask, self.by_free, self.made, self.open = 0, {}, 0, 0
        self.closed: list[int] = []

    def add(self, size: int) -> int:
        above = self.mask >> size
        if above:
            free = size + (above & -above).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.made
            self.made += 1
        self._put(bin_, free - size)
        if self.open > self.most:
            self.closed.append(self._take((self.mask & -self.mask).bit_length() - 1))
        return bin_

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_ = bins.pop()
        self.open -= 1
        if not bins:
            del self.by_free[free]
            self.mask &= ~(1 << free)
        return bin_

    def _put(self, bin_: int, free: int) -> None:
        self.by_free.setdefault(free, []).append(bin_)
        self.mask |= 1 << free
        self.open += 1

    def left(self) -> list[tuple[int, int]]:
        """(container, free space) of what is still open."""
        return [(b, free) for free, bins in self.by_free.items() for b in bins]


def _first(capacities: Sequence[tuple[int, int]], open_bins: int):
    names = ["budget_id", "item", "piece", "size", "task", "bin", "kind"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        packers = {b: BestFit(c, open_bins) for b, c in capacities}
        wholes = {b: 0 for b, _ in capacities}
        for batch in batches:
            out = [[] for _ in names]
            for item, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = max(size or 0, 0)
                for b, c in capacities:
                    piece = 0
                    while size - piece * c > c:  # only what is larger than a container is split; these parts fill one each
                        wholes[b] -= 1
                        for col, v in zip(out, (b, item, piece, c, task, wholes[b], "item")):
                            col.append(v)
                        piece += 1
                    rest = size - piece * c
                    for col, v in zip(out, (b, item, piece, rest, task, packers[b].add(rest), "item")):
                        col.append(v)
            yield pa.record_batch(_typed(out), names=names)
        out = [[] for _ in names]
        for b, c in capacities:
            for bin_, free in packers[b].left():
                for col, v in zip(out, (b, None, 0, c - free, task, bin_, "open")):
                    col.append(v)
        yield pa.record_batch(_typed(out), names=names)

    return run


def _typed(out: list[list]) -> list[pa.Array]:
    kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string()]
    return [pa.array(v, t) for v, t in zip(out, kinds)]


def _second(capacity: dict[int, int], open_bins: int):
    """Consecutive rows of one (budget, group): open containers, the fullest first, become parts of joint ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, packer = None, None
        for batch in batches:
            joint = []
            for b, g, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if (b, g) != now:
                    now, packer = (b, g), BestFit(capacity[b], open_bins)
                joint.append(packer.add(size))
            yield pa.record_batch([*batch.columns, pa.array(joint, pa.int64())], names=[*batch.schema.names, "joint"])

    return run


def pack(items: DataFrame, item: str, size: str, capacities: Sequence[tuple[int, int]], open_bins: int = OPEN_BINS, tasks_per_group: int = TASKS_PER_GROUP) -> DataFrame:
    """``(budget_id, container, item, piece, size)``: where each item, or part of one, goes for each capacity.

    ``capacities`` lists (budget_id, capacity) with positive capacities. An item is split only if it is larger than the
    capacity, into full containers and a rest; null sizes count as 0, items of size 0 stand in a container too.
    Repeated items are separate items. Containers' names are unique within a budget.
    """
    first = materialize(
        items.select(F.col(item).cast("long"), F.col(size).cast("long")).mapInArrow(
            _first(capacities, open_bins), "budget_id int, item long, piece int, size long, task int, bin long, kind string"
        )
    )
    ready = (
        first.where("kind = 'open'")
        .select("budget_id", F.floor(F.col("task") / tasks_per_group).cast("int").alias("group"), "size", "task", "bin")
        .repartition("budget_id", "group")
        .sortWithinPartitions("budget_id", "group", F.desc("size"), "task", "bin")
    )
    joint = ready.mapInArrow(_second(dict(capacities), open_bins * 4), "budget_id int, group int, size long, task int, bin long, joint long")
    joint = joint.select("budget_id", "task", "bin", F.concat(F.lit("j"), F.col("group").cast("string"), F.lit("-"), F.col("joint").cast("string")).alias("joined"))
    own = F.concat(F.lit("t"), F.col("task").cast("string"), F.lit("-"), F.col("bin").cast("string"))
    return (
        first.where("kind = 'item'")
        .join(joint, ["budget_id", "task", "bin"], "left")
        .select("budget_id", F.coalesce("joined", own).alias("container"), F.col("item").alias(item), "piece", F.col("size").alias(size))
    )


def fill_report(packed: DataFrame, capacities: DataFrame, size: str) -> DataFrame:
    """Per budget: containers, items, parts of split items, sum of sizes and the share of all space that is filled."""
    per = packed.groupBy("budget_id").agg(
        F.countDistinct("container").alias("containers"),
        F.count(F.when(F.col("piece") == 0, 1)).alias("items"),
        F.count(F.when(F.col("piece") > 0, 1)).alias("further_pieces"),
        F.sum(size).alias(size),
    )
    return per.join(F.broadcast(capacities), "budget_id").select("*", (F.col(size) / (F.col("containers") * F.col("capacity"))).alias("filled"))
