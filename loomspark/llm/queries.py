"""Queries of the operators on text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.llm import linking
from loomspark.llm.defects import label_pairs, question_answer_pairs
from loomspark.llm.lang import train_languages
from loomspark.llm.packing import fill_report, pack
from loomspark.llm.reading import reading_levels
from loomspark.llm.tokenize import canonical_language, encode, token_cube, with_token_counts
from loomspark.llm.truncation import truncated_values
from loomspark.functions.records import effective_layer
from loomspark.runtime import table


_ROLES = ("user", "assistant")


def _truncated(spark: SparkSession, sf_dir: str, roles: tuple[str, ...]) -> DataFrame:
    """Each message of the roles with what the terminal-context model of all messages says about its end."""
    rows = table(spark, sf_dir, "regen_rows").select(F.col("regen_id").alias("row"), canonical_language(F.col("lang")).alias("lang"), "conversations")
    said = F.filter(F.transform("conversations", lambda m, i: F.struct(i.cast("int").alias("pos"), m["role"].alias("role"), m["content"].alias("content"))), lambda m: m["role"].isin(*_ROLES))
    exploded = rows.select("row", "lang", F.explode(F.filter(said, lambda m: m["role"].isin(*roles))).alias("m"))
    values = exploded.select("row", F.col("m.pos").alias("pos"), F.col("m.role").alias("column"), "lang", F.col("m.content").alias("text"))
    corpus = rows.select(F.transform(said, lambda m: m["content"]).alias("texts"))
    # A sample holds its whole row, so what a limit of tokens cuts is the row's last message.
    last = table(spark, sf_dir, "regen_rows").select("regen_id", (F.size("conversations") - 1).cast("int").alias("pos"))
    tokens = table(spark, sf_dir, "sample_index").groupBy("regen_id").agg(F.max("seq_len").alias("length")).join(last, "regen_id")
    return truncated_values(values, corpus, tokens.select(F.col("regen_id").alias("row"), "pos", F.lit("tokens").alias("unit"), "length"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _labelled(spark, sf_dir).where("defect IS NOT NULL").select("regen_id", "msg_pos", "defect")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "regen_rows")
    sound = rows.where("status IS NULL OR status = 'success'")
    contents = F.transform("conversations", lambda m: m["content"])
    model = train_languages(rows.select(canonical_language(F.col("lang")).alias("lang"), contents.alias("texts")), "lang", "texts")
    cut = _truncated(spark, sf_dir, ("assistant",)).where("cut").select(F.col("row").alias("regen_id"), F.col("pos").alias("msg_pos"), "cut")
    pairs = question_answer_pairs(sound.select("regen_id", "conversations"), "regen_id", "conversations").join(cut, ["regen_id", "msg_pos"], "left")
    return label_pairs(pairs, model)


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs per layer and defect; sound pairs have the defect ``none``."""
    layers = table(spark, sf_dir, "regen_rows").select("regen_id", effective_layer(F.col("source_layer"), F.col("file_layer")).alias("layer"))
    return _labelled(spark, sf_dir).join(layers, "regen_id").groupBy("layer", F.coalesce("defect", F.lit("none")).alias("defect")).agg(F.count("*").alias("pairs"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _truncated(spark, sf_dir, _ROLES).where("cut").select(F.col("row").alias("regen_id"), F.col("pos").alias("msg_pos"))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per layer and role: messages, those cut off, why they count as cut, and their share."""
    layers = table(spark, sf_dir, "regen_rows").select(F.col("regen_id").alias("row"), effective_layer(F.col("source_layer"), F.col("file_layer")).alias("layer"))
    per = _truncated(spark, sf_dir, _ROLES).select("row", "column", "cut", "reason").join(layers, "row").groupBy("layer", F.col("column").alias("role"))
    reasons = [F.count_if(F.col("reason") == r).alias(f"cut_{r}") for r in ("word", "sentence", "object", "half")]
    return per.agg(F.count("*").alias("messages"), F.count_if("cut").alias("cut_messages"), *reasons).withColumn("share", F.col("cut_messages") / F.col("messages"))


def p4_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of the message contents per layer, lang and domain, and how many are of rows that aren't in error."""
    rows = table(spark, sf_dir, "regen_rows").select(
        effective_layer(F.col("source_layer"), F.col("file_layer")).alias("layer"),
        canonical_language(F.col("lang")).alias("lang"),
        "domain",
        F.coalesce(F.col("status") == "error", F.lit(False)).alias("failed"),
        F.transform("conversations", lambda m: m["content"]).alias("contents"),
        F.coalesce(F.size("conversations"), F.lit(0)).alias("messages"),
    )
    counted = with_token_counts(rows, "contents").withColumn("usable_tokens", F.when(F.col("failed"), 0).otherwise(F.col("tokens")))
    return token_cube(counted.drop("contents"), ["layer", "lang", "domain"], ["messages", "tokens", "usable_tokens"])


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def _packed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    budgets = table(spark, sf_dir, "seq_budgets").where("capacity > 0")
    capacities = sorted((r["budget_id"], r["capacity"]) for r in budgets.collect())  # four rows; the table never grows
    sizes = with_token_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), "text").select("doc_id", "tokens")
    return pack(sizes, "doc_id", "tokens", capacities), budgets


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _packed(spark, sf_dir)[0]


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed, budgets = _packed(spark, sf_dir)
    return fill_report(packed, budgets, "tokens")


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", canonical_language(F.col("lang")).alias("lang"))
    model = train_languages(documents, "lang", "text")
    return reading_levels(documents, table(spark, sf_dir, "level_labels"), "doc_id", "text", model)


def p9_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _levels(spark, sf_dir).select("doc_id", F.col("detected").alias("lang"), "score", "level")


def p9_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and mean score per source, language of the text and level."""
    sources = table(spark, sf_dir, "documents").select("doc_id", "source")
    return _levels(spark, sf_dir).join(sources, "doc_id").groupBy("source", F.col("detected").alias("lang"), "level").agg(F.count("*").alias("documents"), F.avg("score").alias("mean_score"))


QUERIES = linking.QUERIES | {f.__name__: f for f in (p1_found, p1_report, p4_budget, p6_found, p6_report, p7_ids, p8_containers, p8_fill, p9_levels, p9_profile)}

#: Tokenisers and trained models have no SQL; tests hold them against public implementations and brute force.
ORACLE_SQL: dict[str, str] = {**linking.ORACLE_SQL}

from loomspark.llm import checked  # noqa: E402 - it uses the queries above

QUERIES |= checked.QUERIES
ORACLE_SQL |= checked.ORACLE_SQL
