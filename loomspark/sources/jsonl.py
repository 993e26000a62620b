"""JSON Lines: strict and tolerant reading, layers from file names, id scans, and writers.

Lines are read as text and parsed as VARIANT: a JSON reader would flatten an array line to several rows and drop blanks.
"""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomspark.functions.text import layer_of_file

MESSAGES = "array<struct<role:string,content:string>>"
_LISTS = ("prompt_messages", "conversations", "messages")


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """``(line, file, file_layer)`` of the non-blank lines. An empty glob is an error."""
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    df = reader.text(path)
    # The name comes as part of a URL.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return df.select(F.trim("value").alias("line"), name.alias("file"), layer_of_file(name).alias("file_layer")).where("line <> ''")


def read_split_files(spark: SparkSession, folder: str) -> DataFrame:
    """The files of a split folder, ``train_layer*.jsonl`` and ``eval_datasets/*.jsonl``, with their ``split``."""
    train = read_lines(spark, folder, "train_layer*.jsonl").withColumn("file_layer", F.regexp_replace("file_layer", "^train_", "")).withColumn("split", F.lit("train"))
    return train.unionByName(read_lines(spark, f"{folder}/eval_datasets", "*.jsonl").withColumn("split", F.lit("eval")))


def count_lines(spark: SparkSession, path: str) -> int:
    """Lines as a file has them, blank ones too."""
    return spark.read.text(path).count()


def _messages(v: Column, name: str) -> Column:
    list_ = F.try_variant_get(v, f"$.{name}", "array<variant>")
    return F.transform(list_, lambda m: F.struct(F.try_variant_get(m, "$.role", "string").alias("role"), F.try_variant_get(m, "$.content", "string").alias("content")))


def parse(lines: DataFrame, strict: bool = False) -> DataFrame:
    """Typed records. Tolerant: a bad line, or one whose first truthy list field is no list, has null messages and ``malformed``.

    Strict: a line that isn't JSON fails the job. Fields: id, prompt_hash, user_id, source_layer, status, error, messages
    (the first non-empty of prompt_messages, conversations and messages), has_id, malformed, file, file_layer.
    """
    v = F.parse_json("line") if strict else F.try_parse_json("line")
    df = lines.withColumn("v", v)
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string").alias(k)
    kinds = [F.coalesce(F.schema_of_variant(F.try_variant_get("v", f"$.{k}", "variant")), F.lit("VOID")) for k in _LISTS]
    # The first field that holds something decides, also if that is no list.
    truthy = [(~kind.isin("VOID") & ~((kind.startswith("ARRAY")) & (F.coalesce(F.size(_messages(F.col("v"), k)), F.lit(0)) == 0)) & ~((kind == "STRING") & (F.try_variant_get("v", f"$.{k}", "string") == ""))) for kind, k in zip(kinds, _LISTS)]
    chosen = F.lit(None).cast(MESSAGES)
    for cond, kind, k in list(zip(truthy, kinds, _LISTS))[::-1]:
        chosen = F.when(cond, F.when(kind.startswith("ARRAY"), _messages(F.col("v"), k))).otherwise(chosen)
    any_truthy = truthy[0] | truthy[1] | truthy[2]
    last_list = _messages(F.col("v"), _LISTS[-1])
    messages = F.when(any_truthy, chosen).otherwise(last_list)
    out = df.select(text("id"), text("prompt_hash"), text("user_id"), text("source_layer"), text("status"), text("error"), messages.alias("messages"),
                    F.try_variant_get("v", "$.id", "variant").isNotNull().alias("has_id"), "file", "file_layer")
    return out.withColumn("malformed", F.col("messages").isNull())


def capped(records: DataFrame, per_file: int, order: str) -> DataFrame:
    """At most ``per_file`` rows of each file, malformed ones counted (an option for a quick look)."""
    return records.withColumn("_n", F.row_number().over(Window.partitionBy("file").orderBy(order))).where(F.col("_n") <= per_file).drop("_n")


def ids(records: DataFrame) -> DataFrame:
    return records.select("id").where("id IS NOT NULL AND id <> ''").distinct()


def write(records: DataFrame, path: str, by: str | None = None, overwrite_parts: bool = False) -> None:
    """JSON Lines, characters as they are; one folder per value of ``by``. An existing folder is an error.

    With ``overwrite_parts`` only the folders of the values that occur are replaced.
    """
    writer = records.write
    if by:
        writer = writer.partitionBy(by)
    if overwrite_parts:
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.option("ignoreNullFields", "false").json(path)


def write_files(records: DataFrame, path: str, by: str, name: str = "{}.jsonl", parts: int = 1) -> list[str]:
    """One JSON Lines file per value of ``by``, named after it, and the names. Files appear whole or not at all.

    A value's rows are written by ``parts`` tasks, as many files then, so that no task need hold the largest value's; each is
    written aside and renamed when all are there. ``by`` must have few values: the driver renames the files.
    """
    spark = records.sparkSession
    aside = f"{path}/_tmp-{uuid.uuid4().hex}"
    salted = records.withColumn("_value", F.coalesce(F.col(by).cast("string"), F.lit("unknown"))).withColumn("_part", F.floor(F.rand(7) * parts).cast("int"))
    salted.repartition("_value", "_part").drop(by).write.partitionBy("_value", "_part").option("ignoreNullFields", "false").json(aside)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(aside)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = []
    for i, f in enumerate(sorted(str(s.getPath()) for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{aside}/_value=*/_part=*/part-*")))):
        value = unquote(f.split("/_value=")[1].split("/")[0])
        stem = name.format(value)
        target = stem if parts == 1 else re.sub(r"(\.jsonl)$", rf"-{i:05d}\1", stem)
        if not fs.rename(jvm.org.apache.hadoop.fs.Path(f), jvm.org.apache.hadoop.fs.Path(f"{path}/{target}")):
            raise FileExistsError(target)
        names.append(target)
    fs.delete(place, True)
    return names


def write_object(spark: SparkSession, path: str, value: dict) -> None:
    """A small JSON object as a file: written aside and renamed, so a reader sees the old one or the new one."""
    jvm = spark.sparkContext._jvm
    target, aside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(f"{path}.tmp-{uuid.uuid4().hex}")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = fs.create(aside, True)
    out.write(bytearray(json.dumps(value, ensure_ascii=False, indent=2).encode()))
    out.close()
    fs.delete(target, False)
    if not fs.rename(aside, target):
        raise OSError(path)


def config_values(documents: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """``(key, value)`` of configuration objects: from ``text_config`` if the object has one, else from its top."""
    v = documents.select("*", F.try_parse_json(text).alias("v"))
    nested = F.try_variant_get("v", "$.text_config", "variant")
    pairs = [F.struct(F.lit(k).alias("key"), F.coalesce(F.when(nested.isNotNull(), F.try_variant_get("v", f"$.text_config.{k}", "string")).otherwise(F.try_variant_get("v", f"$.{k}", "string")), F.lit("(absent)")).alias("value")) for k in keys]
    return v.select(*documents.columns, F.explode(F.array(*pairs)).alias("p")).select(*[c for c in documents.columns if c != text], "p.key", "p.value")
