"""Sample caches: ordinals, shards, byte layout, index, manifest, their checks, batches and shuffles."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from loomspark.runtime import materialize

# Fixed values of the format.
VERSION, INDEX_RECORD = 1, 72
KV = {"kv_full_k": (2, 512), "kv_full_v": (2, 512), "kv_slide_k": (8, 256), "kv_slide_v": (8, 256)}
HIDDEN = 2816
FIELDS = ("input_ids", "loss_mask", "last_hidden", *KV)
SHARD_BYTES = 64 * 1024**3
SHARD_NAME = "shard-%05d.bin"
_RECORD = np.dtype([("sample_id", "<i8"), ("shard_id", "<i4"), ("seq_len", "<i4"), *[(f"off_{f}", "<i8") for f in FIELDS]])


def field_bytes(tokens: Column, hidden: int = HIDDEN, kv: dict[str, tuple[int, int]] = KV) -> dict[str, Column]:
    """Bytes of each field of a sample of so many tokens, in the order of the format."""
    n = tokens.cast("bigint")
    return {"input_ids": n * 4, "loss_mask": n, "last_hidden": n * hidden * 2, **{k: n * h * d * 2 for k, (h, d) in kv.items()}}


def sample_bytes(tokens: Column, hidden: int = HIDDEN, kv: dict[str, tuple[int, int]] = KV) -> Column:
    return tokens.cast("bigint") * (5 + 2 * hidden + sum(2 * h * d for h, d in kv.values()))


def dense_ordinal(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with 0, 1, 2, … in their order (which must be total), without sorting everything in one task.

    Rows are range-partitioned and sorted; the partitions' counts, one row each, give where each begins.
    """
    sorted_ = materialize(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()))
    sizes = sorted_.groupBy("_part").agg(F.count("*").alias("_c"))
    starts = sizes.withColumn("_start", F.sum("_c").over(Window.orderBy("_part")) - F.col("_c")).select("_part", "_start")
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return sorted_.withColumn("_rank", rank).join(starts, "_part").withColumn(name, (F.col("_start") + F.col("_rank")).cast("bigint")).drop("_part", "_rank", "_start")


def modulo_rank(ordinal: Column, ranks: int) -> Column:
    return F.pmod(ordinal, F.lit(ranks)).cast("int")


def contiguous_rank(ordinal: Column, total: Column, ranks: int) -> Column:
    """Balanced ranges; the first ``total % ranks`` ranks have one more."""
    size, more = F.floor(total / ranks), total % ranks
    big = more * (size + 1)
    return F.when(ordinal < big, F.floor(ordinal / (size + 1))).otherwise(more + F.floor((ordinal - big) / F.greatest(size, F.lit(1)))).cast("int")


def rotating_rank(ordinal: Column, total: Column, ranks: int, epoch: int) -> Column:
    """Equal ranges that move by one rank each epoch; null for the remainder, which is left out."""
    per = F.floor(total / ranks)
    return F.when((per > 0) & (ordinal < per * ranks), F.pmod(F.floor(ordinal / F.greatest(per, F.lit(1))) - epoch, F.lit(ranks))).cast("int")


def _roller(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, used = None, 0, 0
        for batch in batches:
            shards, offsets = [], []
            for writer, size in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if writer != now:
                    now, shard, used = writer, 0, 0
                if used and used + size > limit:
                    shard, used = shard + 1, 0
                shards.append(shard), offsets.append(used)
                used += size
            yield pa.record_batch([*batch.columns, pa.array(shards, pa.int32()), pa.array(offsets, pa.int64())], names=[*batch.schema.names, "local_shard", "shard_offset"])

    return run


def roll_shards(samples: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """``samples(writer INT, ordinal BIGINT, nbytes BIGINT)`` with their writer's shard and their place in it.

    Greedy, in order: a shard that holds something and would exceed the limit is closed. Each writer's samples stream
    through one task in order, sorted with spilling; writers run side by side.
    """
    ready = samples.select("writer", "ordinal", "nbytes").repartition("writer").sortWithinPartitions("writer", "ordinal")
    return ready.mapInArrow(_roller(limit), "writer int, ordinal bigint, nbytes bigint, local_shard int, shard_offset bigint")


def global_shards(rolled: DataFrame) -> DataFrame:
    """``(writer, local_shard, shard_id)``: contiguous ids over writers in the order of their first sample.

    The numbering goes over shards (64 GiB each), not over samples.
    """
    local = rolled.groupBy("writer", "local_shard").agg(F.min("ordinal").alias("first"))
    starts = local.withColumn("source_start", F.min("first").over(Window.partitionBy("writer")))
    return starts.select("writer", "local_shard", (F.row_number().over(Window.orderBy("source_start", "local_shard")) - 1).cast("int").alias("shard_id"))


def merged_index(rolled: DataFrame, tokens: DataFrame, hidden: int = HIDDEN, kv: dict[str, tuple[int, int]] = KV) -> DataFrame:
    """The index: dense ``sample_id`` in the order of writers and samples, shard and the offset of each field.

    ``tokens(ordinal, seq_len)``. Local indexes are joined to the global numbers of their shards.
    """
    shards = global_shards(rolled)
    start = rolled.groupBy("writer").agg(F.min("ordinal").alias("source_start"))
    rows = rolled.join(start, "writer").join(shards, ["writer", "local_shard"]).join(tokens, "ordinal")
    rows = dense_ordinal(rows, ["source_start", "ordinal"], "sample_id")
    out, before = [], F.col("shard_offset")
    for name, size in field_bytes(F.col("seq_len"), hidden, kv).items():
        out.append(before.alias(f"off_{name}"))
        before = before + size
    return rows.select("sample_id", "shard_id", "seq_len", *out, "ordinal")


def manifest(index: DataFrame, hidden: int = HIDDEN, kv: dict[str, tuple[int, int]] = KV) -> DataFrame:
    """One row: what a reader must know of a cache."""
    names = F.transform(F.sequence(F.lit(0), F.max("shard_id")), lambda i: F.struct(i.alias("shard_id"), F.format_string(SHARD_NAME, i).alias("file_name")))
    dims = F.create_map(*[x for k, (h, d) in kv.items() for x in (F.lit(k), F.array(F.lit(h), F.lit(d)))])
    return index.agg(F.lit(VERSION).alias("version"), F.count("*").alias("num_samples"), (F.max("shard_id") + 1).alias("num_shards"), F.lit(INDEX_RECORD).alias("index_record_size"),
                     F.lit(hidden).alias("hidden_size"), names.alias("shards")).withColumn("kv_dims", dims)


def index_records(index: DataFrame) -> DataFrame:
    """``(sample_id, record BINARY)``: each index row as the format's record of fixed size."""
    names = _RECORD.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.empty(batch.num_rows, _RECORD)
            for i, name in enumerate(names):
                rows[name] = batch.column(i).to_numpy(zero_copy_only=False)
            raw = rows.tobytes()
            cuts = range(0, len(raw), INDEX_RECORD)
            yield pa.record_batch([batch.column(0), pa.array([raw[a : a + INDEX_RECORD] for a in cuts], pa.binary())], names=["sample_id", "record"])

    return index.select(*[F.col(c).cast("int" if _RECORD[c].itemsize == 4 else "long") for c in names]).mapInArrow(run, "sample_id long, record binary")


def decoded_index(records: DataFrame) -> DataFrame:
    """The index rows of records; a record of another size fails the job."""
    schema = ", ".join(f"{c} {'int' if _RECORD[c].itemsize == 4 else 'long'}" for c in _RECORD.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(0).to_pylist()
            if any(len(r) != INDEX_RECORD for r in held):
                raise ValueError(f"an index record has not {INDEX_RECORD} bytes")
            rows = np.frombuffer(b"".join(held), _RECORD)
            yield pa.record_batch([pa.array(np.ascontiguousarray(rows[c])) for c in _RECORD.names], names=list(_RECORD.names))

    return records.select("record").mapInArrow(run, schema)


def missing_shards(manifest_: DataFrame, files: DataFrame) -> DataFrame:
    """``(shard_id, file_name)`` of the manifest's shards that ``files(file_name)`` doesn't list."""
    named = manifest_.select(F.explode("shards").alias("s")).select("s.shard_id", "s.file_name")
    return named.join(files.select("file_name").distinct(), "file_name", "left_anti").select("shard_id", "file_name")


def manifest_checks(manifest_: DataFrame, records: DataFrame, files: DataFrame) -> DataFrame:
    """``(check_name, ok)``: what a reader asserts before it reads: version, record size, an index, its bytes, shard ids in a row from 0, shard files, samples.

    ``manifest_`` has one row, ``records(record)`` is the index as bytes, ``files(file_name)`` the listing of the folder.
    """
    held = records.agg(F.count("*").alias("records"), F.coalesce(F.sum(F.octet_length("record")), F.lit(0)).alias("bytes"))
    lost = missing_shards(manifest_, files).agg(F.count("*").alias("lost"))
    m = manifest_.crossJoin(F.broadcast(held)).crossJoin(F.broadcast(lost))  # one row each
    in_a_row = F.forall(F.transform("shards", lambda s, i: s["shard_id"] == i), lambda x: x)
    checks = {
        "version": F.col("version") == VERSION, "record_size": F.col("index_record_size") == INDEX_RECORD, "index_exists": F.col("records") > 0,
        "index_bytes": F.col("bytes") == F.col("num_samples") * INDEX_RECORD, "shards_in_a_row": in_a_row & (F.size("shards") == F.col("num_shards")), "shard_files": F.col("lost") == 0,
        "num_samples": F.col("records") == F.col("num_samples"),
    }
    return m.select(F.explode(F.array(*[F.struct(F.lit(k).alias("check_name"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in checks.items()])).alias("x")).select("x.check_name", "x.ok")


def looked_up(index: DataFrame, ordinals: DataFrame) -> DataFrame:
    """The index rows of ``ordinals(sample_id)``, each as often as it is asked for. A point read; the filter of a range is pushed to the files."""
    return ordinals.join(index, "sample_id")


def limited(ordered: DataFrame, ordinal: str, limit: int) -> DataFrame:
    """Rows whose ordinal is below the limit, before any is given to a rank; 0 means no limit."""
    return ordered.where(F.col(ordinal) < limit) if limit else ordered


def index_checks(index: DataFrame) -> DataFrame:
    """``(check_name, ok)``: density of sample and shard ids, lengths, and offsets that follow the sizes of the fields."""
    n = index.agg(
        (F.count("*") == F.max("sample_id") - F.min("sample_id") + 1).alias("dense_samples"),
        (F.min("sample_id") == 0).alias("samples_from_0"),
        (F.count("sample_id") == F.countDistinct("sample_id")).alias("unique_samples"),
        (F.countDistinct("shard_id") == F.max("shard_id") + 1).alias("dense_shards"),
        F.coalesce(F.min(F.col("seq_len") > 0), F.lit(True)).alias("positive_lengths"),
        F.coalesce(F.min((F.col("off_loss_mask") - F.col("off_input_ids") == F.col("seq_len") * 4) & (F.col("off_last_hidden") - F.col("off_loss_mask") == F.col("seq_len"))), F.lit(True)).alias("offsets_follow_fields"),
    )
    names = n.columns
    return n.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"), F.coalesce(F.col(c), F.lit(False)).alias("ok")) for c in names])).alias("x")).select("x.check_name", "x.ok")


def shard_totals(index: DataFrame) -> DataFrame:
    return index.groupBy("shard_id").agg(F.count("*").alias("samples"), F.sum(F.col("seq_len").cast("bigint")).alias("tokens"), F.sum(sample_bytes(F.col("seq_len"))).alias("nbytes"))


def padded_batches(samples: DataFrame, batch: str, pads: dict[str, int]) -> DataFrame:
    """Array columns padded on the right to their batch's longest; the first one's length rules.

    Samples are shuffled once, by batch; a batch is what fits a training step.
    """
    longest = F.max(F.size(next(iter(pads)))).over(Window.partitionBy(batch))
    held = samples.withColumn("_longest", longest)
    padded = [F.concat(F.col(c), F.array_repeat(F.lit(v), F.greatest(F.col("_longest") - F.size(c), F.lit(0)))).alias(c) for c, v in pads.items()]
    return held.select(*[c for c in samples.columns if c not in pads], *padded)


def buffered_shuffle(rows: DataFrame, order: Sequence[str], buffer: int, seed: int) -> DataFrame:
    """A shuffle of bounded memory: within each range of the order, a random one of ``buffer`` held rows leaves at a time.

    ``out_rank`` says where a row leaves within its partition ``part``; it is at most ``buffer - 1`` before its place in.
    For an even shuffle of everything, order by :func:`loomspark.functions.text.shuffle_key`.
    """
    fields = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        rng, held, n = random.Random(seed * 1_000_003 + part), [], 0
        schema = None

        def out(rows_):
            nonlocal n
            cols = [pa.array([r[i] for r in rows_], schema.field(i).type) for i in range(len(fields))]
            ranks = pa.array([n + i for i in range(len(rows_))], pa.int64())
            n += len(rows_)
            return pa.record_batch([*cols, pa.array([part] * len(rows_), pa.int32()), ranks], names=[*fields, "part", "out_rank"])

        for batch in batches:
            schema = batch.schema
            leaving = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) >= buffer:
                    i = rng.randrange(len(held))
                    held[i], held[-1] = held[-1], held[i]
                    leaving.append(held.pop())
            if leaving:
                yield out(leaving)
        if held:
            rng.shuffle(held)
            yield out(held)

    from pyspark.sql import types as T

    schema_out = T.StructType([*rows.schema.fields, T.StructField("part", T.IntegerType()), T.StructField("out_rank", T.LongType())])
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema_out)
