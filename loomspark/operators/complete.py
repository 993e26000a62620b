"""New answers for conversations, by a completer that is given (a model behind HTTP, or the offline stand-in)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomspark.operators.routing import skeleton, skeleton_error

Completer = Callable[[list[dict]], str]


def echo(messages: list[dict]) -> str:
    """Offline stand-in: says which turn it answers and how long the question was."""
    asked = [m for m in messages if m["role"] == "user"]
    return f"answer {len(asked)} to {len(asked[-1]['content'] or '')} characters"


def regenerate(rows: DataFrame, row: str, messages: str, completer: Completer = echo, endpoints: int = 1) -> DataFrame:
    """``(row, conversations, status, error)``. Turns of one row follow each other: each sees the earlier new answers.

    A row that can't be asked, or whose completer raises, becomes an error row and fails nothing else. One batch is in
    flight per task; ``endpoints`` says over how many partitions rows are dealt.
    """
    kind = rows.schema[row].dataType.simpleString()
    asked = rows.select(row, skeleton(F.col(messages)).alias("kept"), skeleton_error(F.col(messages)).alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, status, errors = [], [], []
            for kept, error in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                said: list[dict] = []
                if error is None:
                    try:
                        for m in kept:
                            said.append(m)
                            if m["role"] == "user":
                                said.append({"role": "assistant", "content": completer(said)})
                    except Exception as e:  # noqa: BLE001 - any failure is this row's
                        error = str(e)
                out.append(said if error is None else None), status.append("success" if error is None else "error"), errors.append(error)
            kind_ = pa.list_(pa.struct([("role", pa.string()), ("content", pa.string())]))
            yield pa.record_batch([batch.column(0), pa.array(out, kind_), pa.array(status), pa.array(errors, pa.string())], names=[row, "conversations", "status", "error"])

    if endpoints > 1:
        asked = asked.repartition(endpoints)
    return asked.mapInArrow(run, f"{row} {kind}, conversations array<struct<role:string,content:string>>, status string, error string")


def reshaped(rows: DataFrame, messages: str, answered: DataFrame, row: str) -> DataFrame:
    """Input rows with their new conversation: the field ``messages`` is dropped from rows that were answered, the rest kept."""
    both = rows.join(answered, row)
    return both.withColumn(messages, F.when(F.col("status") == "error", F.col(messages)))
