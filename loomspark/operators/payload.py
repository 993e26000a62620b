"""Samples as the bytes of a cache's fields, and back: int32 and uint8 sequences, bfloat16 matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def to_bfloat16(x: np.ndarray) -> bytes:
    """Rounded to the nearest, ties to even; NaN stays NaN."""
    bits = np.asarray(x, np.float32).view(np.uint32)
    rounded = ((bits.astype(np.uint64) + 0x7FFF + ((bits >> 16) & 1)) >> 16).astype(np.uint16)
    return np.where(np.isnan(np.asarray(x, np.float32)), np.uint16(0x7FC0), rounded).astype("<u2").tobytes()


def from_bfloat16(data: bytes) -> np.ndarray:
    return (np.frombuffer(data, "<u2").astype(np.uint32) << 16).view(np.float32)


def encode_samples(samples: DataFrame, row: str, ids: str, mask: str, hidden: str, kv: str) -> DataFrame:
    """``(row, seq_len, input_ids, loss_mask, last_hidden, kv)`` with BINARY fields.

    ``hidden`` is (T, H); ``kv`` is (heads, T, D) and stored with the sequence first, so that a range of places is one
    range of bytes. Fields of unequal length are an error.
    """
    kind = samples.schema[row].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[] for _ in range(5)]
            for i, m, h, c in zip(*(batch.column(k).to_pylist() for k in range(1, 5))):
                cache = np.array(c, np.float32).transpose(1, 0, 2)
                if not len(i) == len(m) == len(h) == len(cache):
                    raise ValueError(f"fields of lengths {len(i)}, {len(m)}, {len(h)}, {len(cache)}")
                for col, v in zip(out, (len(i), np.array(i, "<i4").tobytes(), np.array(m, np.uint8).tobytes(), to_bfloat16(np.array(h, np.float32)), to_bfloat16(cache))):
                    col.append(v)
            types = [pa.int32(), *[pa.binary()] * 4]
            yield pa.record_batch([batch.column(0), *[pa.array(v, t) for v, t in zip(out, types)]], names=[row, "seq_len", "input_ids", "loss_mask", "last_hidden", "kv"])

    return samples.select(row, ids, mask, hidden, kv).mapInArrow(run, f"{row} {kind}, seq_len int, input_ids binary, loss_mask binary, last_hidden binary, kv binary")


def decode_samples(encoded: DataFrame, row: str, heads: int) -> DataFrame:
    """The arrays of :func:`encode_samples`, ``kv`` with the heads first again. Fields of wrong size are an error."""
    kind = encoded.schema[row].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, masks, hidden, kv = [], [], [], []
            for n, i, m, h, c in zip(*(batch.column(k).to_pylist() for k in range(1, 6))):
                if len(i) != 4 * n or len(m) != n or (n and (len(h) % (2 * n) or len(c) % (2 * n * heads))):
                    raise ValueError(f"fields don't fit {n} tokens")
                ids.append(np.frombuffer(i, "<i4").tolist())
                masks.append(np.frombuffer(m, np.uint8).astype(np.int32).tolist())
                hidden.append(from_bfloat16(h).reshape(n, -1).tolist() if n else [])
                kv.append(from_bfloat16(c).reshape(n, heads, -1).transpose(1, 0, 2).tolist() if n else [])
            two, three = pa.list_(pa.list_(pa.float32())), pa.list_(pa.list_(pa.list_(pa.float32())))
            yield pa.record_batch(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(masks, pa.list_(pa.int32())), pa.array(hidden, two), pa.array(kv, three)],
                names=[row, "input_ids", "loss_mask", "last_hidden", "kv"],
            )

    fields = "input_ids array<int>, loss_mask array<int>, last_hidden array<array<float>>, kv array<array<array<float>>>"
    return encoded.select(row, "seq_len", "input_ids", "loss_mask", "last_hidden", "kv").mapInArrow(run, f"{row} {kind}, {fields}")
