"""Token counts, token ids and their aggregates over a corpus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from loomspark.llm.bpe import VOCABULARY, Counter, Encoder, Vocabulary

#: One vocabulary per worker process: it takes a fifth of a second to read.
_HELD: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    if path not in _HELD:
        _HELD[path] = Vocabulary(path)
    return _HELD[path]


def canonical_language(lang: Column) -> Column:
    """The primary subtag in lower case; null for a null, empty or unlettered value.

    ``EN``, `` en``, ``en-GB`` and ``en_x`` are all ``en``.
    """
    return F.nullif(F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


def with_token_counts(rows: DataFrame, text: str, out: str = "tokens", vocabulary: str = VOCABULARY) -> DataFrame:
    """``rows`` and the number of tokens of ``text`` as BIGINT: 0 for a null or empty text.

    ``text`` may also be ARRAY<STRING>; its non-null elements are counted together. All other columns stay as they are.
    """
    at = rows.columns.index(text)
    schema = rows.drop(out).schema.add(out, "long")
    many = rows.schema[text].dataType.typeName() == "array"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(_vocabulary(vocabulary))
        for batch in batches:
            values = batch.column(at).to_pylist()
            if many:
                n = [sum(counter.text(t) for t in v or () if t) for v in values]
            else:
                n = [counter.text(t) if t else 0 for t in values]
            yield pa.record_batch([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, out])

    return rows.drop(out).mapInArrow(run, schema) if out != text else rows.mapInArrow(run, schema)


def encode(rows: DataFrame, row: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(row, ids ARRAY<INT>)`` for every row; null and empty texts have the empty list. Special tokens are text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(_vocabulary(vocabulary))
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):  # bounds what one Arrow list holds
                part = batch.slice(start, 1024)
                ids, offsets = encoder.batch(part.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids))
                yield pa.record_batch([part.column(0), lists], names=[row, "ids"])

    return rows.select(row, text).mapInArrow(run, f"{row} {rows.schema[row].dataType.simpleString()}, ids array<int>")


def token_cube(counted: DataFrame, dimensions: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Sums of ``measures`` and the number of rows for every combination of ``dimensions``.

    ``(all)`` marks a dimension summed over, ``(none)`` its null values; ``grouping_level`` has Spark's grouping id.
    Rows are first summed by all dimensions, so the cube expands groups, not rows.
    """
    base = counted.groupBy(*dimensions).agg(F.count("*").alias("rows"), *[F.sum(m).alias(m) for m in measures])
    total = base.cube(*dimensions).agg(
        *[F.when(F.grouping(d) == 1, "(all)").otherwise(F.coalesce(F.col(d), F.lit("(none)"))).alias(f"_{d}") for d in dimensions],
        F.sum("rows").alias("rows"), *[F.sum(m).alias(m) for m in measures], F.grouping_id().alias("grouping_level"),
    )
    return total.select(*[F.col(f"_{d}").alias(d) for d in dimensions], "rows", *measures, "grouping_level")
