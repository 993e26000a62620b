"""Comparison tokens of a text, and which of them are frequent in a corpus."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_CJK = "぀-ヿ㐀-䶿一-鿿豈-﫿가-힯"
_TOKEN = re.compile(f"([{_CJK}]+)|[^\\W_{_CJK}]+")
has_cjk = re.compile(f"[{_CJK}]").search
_WORDS = re.compile(r"[^\W_]+").findall


def tokens(text: str, wide: int = 2) -> list[str]:
    """Lower-case words and numbers; runs of scripts without spaces give their overlapping pieces of ``wide`` characters."""
    text = text.lower()
    if text.isascii() or not has_cjk(text):
        return _WORDS(text)
    out: list[str] = []
    for m in _TOKEN.finditer(text):
        run = m.group()
        if m.lastindex and len(run) > wide:
            out.extend(run[i : i + wide] for i in range(len(run) - wide + 1))
        else:
            out.append(run)
    return out


class Hashes(dict):
    """Token -> its CRC, remembered up to a bound."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        v = self[token] = zlib.crc32(token.encode("utf-8", "surrogatepass"))
        return v


def hashed(text: str, cache: Hashes, wide: int = 2) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, tokens(text, wide)), np.uint32)


def frequent_tokens(texts: DataFrame, column: str, share: float, wide: int = 2, least: int = 0) -> tuple[np.ndarray, int]:
    """Sorted CRCs of the tokens in more than ``share`` of all non-null texts and more than ``least``, and the number of those texts.

    All texts are counted. What reaches the driver is bounded: at most ``mean distinct tokens of a text / share``
    tokens can be that frequent, whatever the number of texts.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, seen, n = Hashes(), Counter(), 0

        def flush():
            keys = np.fromiter(seen.keys(), np.int64, len(seen))
            return pa.record_batch([pa.array(keys), pa.array(np.fromiter(seen.values(), np.int64, len(seen)))], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                n += 1
                seen.update(set(map(cache.__getitem__, tokens(text, wide))))
            if len(seen) > 1_000_000:
                yield flush()
                seen.clear()
        seen[-1] = n
        yield flush()

    counts = texts.select(column).where(F.col(column).isNotNull()).mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    total = F.max(F.when(F.col("token") == -1, F.col("n")))
    rows = counts.crossJoin(F.broadcast(counts.agg(total.alias("total"))))  # one row
    kept = rows.where((F.col("token") == -1) | (F.col("n") > F.greatest(F.col("total") * share, F.lit(float(least))))).select("token", "n").collect()
    n = next((r["n"] for r in kept if r["token"] == -1), 0)
    return np.sort(np.array([r["token"] for r in kept if r["token"] >= 0], np.uint32)), n
