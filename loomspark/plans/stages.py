"""Stages that run one after another and are skipped where their output exists."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.sources import jsonl


@dataclass(frozen=True)
class Stage:
    name: str
    output: str
    run: Callable[[SparkSession, dict[str, DataFrame]], DataFrame]


def exists(spark: SparkSession, path: str) -> bool:
    """A committed output: the folder with its success mark."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def run_layers(spark: SparkSession, folder: str, output: str, run: Callable[[DataFrame, str], DataFrame], layers: Sequence[str] | None = None, final: str | None = None) -> dict[str, str]:
    """Runs ``run(lines, layer)`` on each layer's file ``<layer>.jsonl`` and writes ``<layer>_regen.jsonl``; says what became of each.

    Without ``layers`` all files of the folder are taken. A missing or an empty file is skipped. A layer's output is copied to
    ``final`` as soon as it is done, so what is finished stays if a later layer fails.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = layers or sorted(s.getPath().getName().removesuffix(".jsonl") for s in fs.globStatus(path(f"{folder}/*.jsonl")))
    said: dict[str, str] = {}
    for layer in names:
        source = path(f"{folder}/{layer}.jsonl")
        if not fs.exists(source):
            said[layer] = "no input file"
        elif not fs.getFileStatus(source).getLen():
            said[layer] = "empty file"
        else:
            rows = run(jsonl.read_lines(spark, f"{folder}/{layer}.jsonl"), layer).withColumn("_layer", F.lit(layer))
            for name in jsonl.write_files(rows, output, "_layer", "{}_regen.jsonl"):
                if final:
                    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, path(f"{output}/{name}"), fs, path(f"{final}/{name}"), False, True, spark.sparkContext._jsc.hadoopConfiguration())
            said[layer] = "ran"
    return said


def run_stages(spark: SparkSession, stages: Sequence[Stage], only: str | None = None) -> dict[str, str]:
    """Runs each stage on the outputs of those before it; says per stage whether it ran, was there, or wasn't asked for.

    An output without its success mark is of a run that failed, and is written anew.
    """
    said: dict[str, str] = {}
    outputs: dict[str, DataFrame] = {}
    for s in stages:
        if exists(spark, s.output):
            said[s.name] = "there"
        elif only is None or s.name == only:
            s.run(spark, outputs).write.mode("overwrite").parquet(s.output)
            said[s.name] = "ran"
        else:
            said[s.name] = "left out"
            continue
        outputs[s.name] = spark.read.parquet(s.output)
    return said
