"""Queries of the operators that relate records: overlap of splits, near-duplicates, grouped splits; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.functions.messages import first_content, last_content
from loomspark.functions.records import canonical_user, effective_id, effective_layer
from loomspark.llm.groupsplit import linked_groups, split_groups
from loomspark.llm.neardup import duplicate_pairs, near_duplicate_classes
from loomspark.llm.overlap import class_overlaps, split_overlaps
from loomspark.runtime import table

SHARES = {"train": 80.0, "validation": 10.0, "test": 10.0}


def _prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_prompts").select("row_id", last_content(F.col("prompt_messages"), "user").alias("text"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = duplicate_pairs(near_duplicate_classes(_prompts(spark, sf_dir), "row_id", "text"), "row_id")
    return pairs.select(F.col("row_a").alias("row_id_a"), F.col("row_b").alias("row_id_b"))


def p3_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per prompt with its class; copies aren't expanded into pairs."""
    return near_duplicate_classes(_prompts(spark, sf_dir), "row_id", "text")


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.when(F.col("split") == "train", False).when(F.col("split").isin("eval", "test"), True)
    return table(spark, sf_dir, "split_rows").select("split_row_id", first_content(F.col("conversations"), "user").alias("text"), held.alias("held"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("held_row"), F.col("train_row")
    return split_overlaps(_evaluated(spark, sf_dir), "split_row_id", "text", "held").select(F.least(a, b).alias("split_row_id_a"), F.greatest(a, b).alias("split_row_id_b"))


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per split and source_layer: held-out rows, those that also stand in train, and their pairs, counted by classes."""
    rows = table(spark, sf_dir, "split_rows").where(F.col("split").isin("eval", "test")).select(F.col("split_row_id").alias("row"), "split", "source_layer")
    found, classes = class_overlaps(_evaluated(spark, sf_dir), "split_row_id", "text", "held")
    sizes = classes.where("NOT held").groupBy(F.col("class").alias("train_class")).agg(F.count("*").alias("n"))
    met = found.join(sizes, "train_class").groupBy(F.col("held_class").alias("class")).agg(F.sum("n").alias("pairs"))
    per_row = classes.where("held").join(met, "class").select("row", "pairs")
    return rows.join(per_row, "row", "left").groupBy("split", "source_layer").agg(
        F.count("*").alias("rows"), F.count("pairs").alias("overlapping_rows"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")
    )


def _linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    layer = effective_layer(F.col("source_layer"), F.col("file_layer"))
    records = table(spark, sf_dir, "raw_prompts").select(
        "row_id",
        canonical_user(F.col("user_id")).alias("user_key"),
        effective_id(F.col("id"), layer, F.col("prompt_hash")).alias("id_key"),
        layer.alias("layer"),
    )
    return records, linked_groups(records, "row_id", ["user_key", "id_key"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _linked(spark, sf_dir)[1].where("size > 1").select("row_id", F.col("first_row").alias("first_row_id"))


def p5_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share of each split per layer."""
    records, groups = _linked(spark, sf_dir)
    grouped = groups.join(records, "row_id")
    split = split_groups(grouped, "first_row", "layer", SHARES)
    counts = grouped.join(split, "first_row").groupBy("layer", "split").agg(F.count("*").alias("rows"))
    totals = counts.groupBy("layer").agg(F.sum("rows").alias("layer_rows"))
    return counts.join(totals, "layer").select("layer", "split", "rows", (F.col("rows") / F.col("layer_rows")).alias("share"))


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split of every prompt."""
    records, groups = _linked(spark, sf_dir)
    split = split_groups(groups.join(records, "row_id"), "first_row", "layer", SHARES)
    return groups.join(split, "first_row").select("row_id", "split")


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_classes, p5_found, p5_splits, p5_split_report)}

#: p2 and p3 have no SQL: similarity joins of whole tables are too slow in it; tests hold them against brute force.
#: Groups by 64 rounds in which a row takes the least label of the rows it shares a key with.
ORACLE_SQL: dict[str, str] = {
    "p5_found": r"""WITH RECURSIVE r AS (SELECT row_id, lower(regexp_replace(user_id, '[\s\x{00a0}\x{200b}-\x{200d}\x{2060}\x{3000}\x{feff}_\-]+', '', 'g')) AS u,
  coalesce(nullif(id, ''), coalesce(nullif(source_layer, ''), file_layer) || ':' || prompt_hash) AS i FROM raw_prompts),
 k AS (SELECT row_id, 'u' || u AS key FROM r WHERE u NOT IN ('', '0', 'null', 'none', 'nil', 'nan', 'na', 'n/a', 'unknown', 'anonymous', 'anon', 'guest', 'undefined', 'nobody', 'test', '?')
  UNION ALL SELECT row_id, 'i' || i FROM r WHERE i IS NOT NULL),
 cc(step, row_id, lab) AS (SELECT 0, row_id, row_id FROM raw_prompts UNION ALL
  SELECT step + 1, row_id, min(m) FROM (SELECT cc.step, cc.row_id, least(cc.lab, min(cc.lab) OVER (PARTITION BY coalesce(k.key, 'row' || cc.row_id))) AS m FROM cc LEFT JOIN k ON k.row_id = cc.row_id)
   WHERE step < 64 GROUP BY step, row_id)
 SELECT row_id, lab AS first_row_id FROM (SELECT row_id, lab, count(*) OVER (PARTITION BY lab) AS n FROM cc WHERE step = 64) WHERE n > 1""",
}
