"""What must hold of the results of the operators on text, whatever their models say, each with its SQL.

The SQL counts the same rows from the tables; where a rule may not be broken its number is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomspark.functions.records import canonical_user, effective_id, effective_layer
from loomspark.llm import linking, queries
from loomspark.runtime import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_LAYER = "coalesce(nullif(source_layer, ''), file_layer)"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE_SQL[f.__name__] = f, sql
        return f

    return keep


@query(f"""WITH m AS (SELECT {_LAYER} AS layer, conversations AS c, unnest(range(2, len(conversations) + 1)) AS i FROM regen_rows WHERE status IS NULL OR status = 'success')
 SELECT layer, count(*) AS pairs FROM m WHERE c[i - 1].role = 'user' AND c[i].role = 'assistant' GROUP BY 1""")
def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair has one label."""
    return queries.p1_report(spark, sf_dir).groupBy("layer").agg(F.sum("pairs").alias("pairs"))


@query("SELECT split, source_layer, count(*) AS rows FROM split_rows WHERE split IN ('eval', 'test') GROUP BY 1, 2")
def p2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.p2_report(spark, sf_dir).select("split", "source_layer", "rows")


@query("""WITH t AS (SELECT list_filter(prompt_messages, lambda m: m.role = 'user')[-1].content AS text FROM raw_prompts)
 SELECT count(text) AS rows, 0 AS wrong_sizes, 0 AS unnamed FROM t""")
def p3_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with a text has one class, whose size is the number of its rows and whose name is its smallest row."""
    c = linking.p3_classes(spark, sf_dir)
    per = c.groupBy("class_row").agg(F.count("*").alias("n"), F.min("row_id").alias("first"), F.max("size").alias("size"))
    return per.agg(F.sum("n").alias("rows"), F.count_if(F.col("n") != F.col("size")).cast("int").alias("wrong_sizes"), F.count_if(F.col("first") != F.col("class_row")).cast("int").alias("unnamed"))


@query(f"""WITH r AS (SELECT {_LAYER} AS layer, nullif(regexp_extract(lower(trim(lang)), '^([a-z]{{2,3}})(?:[-_].*)?$', 1), '') AS lang, domain, coalesce(len(conversations), 0) AS n FROM regen_rows)
 SELECT CASE WHEN GROUPING(layer) = 1 THEN '(all)' ELSE coalesce(layer, '(none)') END AS layer, CASE WHEN GROUPING(lang) = 1 THEN '(all)' ELSE coalesce(lang, '(none)') END AS lang, CASE WHEN GROUPING(domain) = 1 THEN '(all)' ELSE coalesce(domain, '(none)') END AS domain,
  count(*) AS rows, CAST(sum(n) AS BIGINT) AS messages, CAST(GROUPING(layer, lang, domain) AS BIGINT) AS grouping_level FROM r GROUP BY CUBE (layer, lang, domain)""")
def p4_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and messages of every slice of the budget."""
    return queries.p4_budget(spark, sf_dir).select("layer", "lang", "domain", "rows", "messages", F.col("grouping_level").cast("long").alias("grouping_level"))


@query("SELECT count(*) AS rows, 0 AS users_apart, 0 AS ids_apart FROM raw_prompts")
def p5_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row has a split, and no user's or id's rows have two."""
    layer = effective_layer(F.col("source_layer"), F.col("file_layer"))
    keys = table(spark, sf_dir, "raw_prompts").select("row_id", canonical_user(F.col("user_id")).alias("user"), effective_id(F.col("id"), layer, F.col("prompt_hash")).alias("id"))
    rows = linking.p5_splits(spark, sf_dir).where("split IN ('train', 'validation', 'test')").join(keys, "row_id")

    def apart(key: str) -> DataFrame:
        return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min("split").alias("a"), F.max("split").alias("b")).agg(F.count_if(F.col("a") != F.col("b")).cast("int").alias(f"{key}s_apart"))

    return rows.agg(F.count("*").alias("rows")).crossJoin(apart("user")).crossJoin(apart("id"))  # one row each


@query(f"SELECT {_LAYER} AS layer, m.role AS role, count(m.content) AS messages FROM (SELECT *, unnest(conversations) AS m FROM regen_rows) WHERE m.role IN ('user', 'assistant') AND m.content IS NOT NULL GROUP BY 1, 2")
def p6_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries.p6_report(spark, sf_dir).select("layer", "role", "messages")


@query("SELECT count(*) AS documents, count(*) FILTER (text IS NULL OR text = '') AS without_ids FROM documents")
def p7_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document has a list, which is empty for no text only."""
    return queries.p7_ids(spark, sf_dir).agg(F.count("*").alias("documents"), F.count_if(F.size("ids") == 0).alias("without_ids"))


@query("SELECT budget_id, (SELECT count(*) FROM documents) AS documents, 0 AS overfull, 0 AS needlessly_split FROM seq_budgets WHERE capacity > 0")
def p8_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stands in a container of each capacity, none holds more than it may, and none that would fit is split."""
    packed, budgets = queries._packed(spark, sf_dir)
    budgets = F.broadcast(budgets.select("budget_id", "capacity"))  # four rows; the table never grows
    items = packed.groupBy("budget_id", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces")).join(budgets, "budget_id")
    per_item = items.groupBy("budget_id").agg(F.count("*").alias("documents"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity"))).cast("int").alias("needlessly_split"))
    full = packed.groupBy("budget_id", "container").agg(F.sum("tokens").alias("held")).join(budgets, "budget_id")
    over = full.groupBy("budget_id").agg(F.count_if(F.col("held") > F.col("capacity")).cast("int").alias("overfull"))
    return per_item.join(over, "budget_id").select("budget_id", "documents", "overfull", "needlessly_split")


@query("SELECT count(*) AS documents, 0 AS out_of_range, count(*) FILTER (text IS NULL OR text = '') AS without_text FROM documents")
def p9_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document has a row, and its level, if any, is one of the five."""
    texts = table(spark, sf_dir, "documents").where("text IS NULL OR text = ''").select("doc_id", F.lit(1).alias("nothing"))
    rows = queries.p9_levels(spark, sf_dir).join(texts, "doc_id", "left")
    return rows.agg(F.count("*").alias("documents"), F.count_if(~F.col("level").between(1, 5)).cast("int").alias("out_of_range"), F.count_if(F.col("level").isNull() & F.col("nothing").isNotNull()).alias("without_text"))
