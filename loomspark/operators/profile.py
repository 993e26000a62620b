"""Profile of conversation records: counters, ids, roles, turns and lengths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from loomspark.functions.stats import nearest_rank
from loomspark.functions.text import role_bucket, word_count
from loomspark.functions.vectors import let

SHARES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def first_nonempty(*lists: Column) -> Column:
    """The first list that isn't empty; the last one, even if empty, where all are."""
    out = lists[-1]
    for x in reversed(lists[:-1]):
        out = F.when(F.size(x) > 0, x).otherwise(out)
    return out


def profile_id(id_: Column, prompt_hash: Column) -> Column:
    return F.coalesce(F.nullif(id_, F.lit("")), prompt_hash)


def row_counters(rows: DataFrame, by: Sequence[str], messages: str) -> DataFrame:
    """Rows, malformed rows (no list), empty lists and rows that don't begin with a user."""
    m = F.col(messages)
    first = F.get(m, 0)["role"]
    return rows.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(m.isNull()).alias("n_bad"),
        F.count_if(F.size(m) == 0).alias("empty_conv"),
        F.count_if((F.size(m) > 0) & ~F.coalesce(first == "user", F.lit(False))).alias("first_not_user"),
    )


def id_report(rows: DataFrame, by: Sequence[str], id_: str, messages: str) -> DataFrame:
    """Ids, different ids and repeats among well-formed rows. Counted by id first, so one group isn't one task."""
    per_id = rows.where(F.col(messages).isNotNull() & F.col(id_).isNotNull()).groupBy(*by, id_).agg(F.count("*").alias("c"))
    return per_id.groupBy(*by).agg(F.sum("c").alias("ids"), F.count("*").alias("distinct_ids"), (F.sum("c") - F.count("*")).alias("dup_ids"))


def messages_of(rows: DataFrame, keep: Sequence[str], messages: str) -> DataFrame:
    """One row per message: pos, role (``?`` if missing), bucket, chars, words."""
    m = rows.select(*keep, F.posexplode(messages).alias("pos", "m"))
    role, content = F.coalesce("m.role", F.lit("?")), F.coalesce("m.content", F.lit("None"))
    return m.select(*keep, "pos", role.alias("role"), role_bucket(role).alias("bucket"), F.length(content).alias("chars"), word_count(content).alias("words"))


def role_counts(rows: DataFrame, messages: str) -> DataFrame:
    return messages_of(rows, [], messages).groupBy("role").agg(F.count("*").alias("messages"))


def first_roles(rows: DataFrame, messages: str) -> DataFrame:
    return rows.where(F.size(messages) > 0).groupBy(F.get(F.col(messages), 0)["role"].alias("role")).agg(F.count("*").alias("rows"))


def turns(rows: DataFrame, keep: Sequence[str], messages: str) -> DataFrame:
    """Turns of each well-formed row; user and assistant turns are null for empty lists, which don't count there."""
    m = F.col(messages)
    of = lambda r: F.when(F.size(m) > 0, F.size(F.filter(m, lambda x: x["role"] == r)))
    return rows.where(m.isNotNull()).select(*keep, F.size(m).alias("turns"), of("user").alias("user_turns"), of("assistant").alias("assistant_turns"))


def length_profile(rows: DataFrame, by: Sequence[str], messages: str, unit: str) -> DataFrame:
    """Distribution of message lengths (``chars`` or ``words``) per role bucket."""
    return nearest_rank(messages_of(rows, by, messages), [*by, "bucket"], unit, SHARES)


def layer_summary(rows: DataFrame, layer: str, messages: str) -> DataFrame:
    """One line per layer: rows, mean system length (cut), user and whole-row percentiles in words.

    Words are counted once per message; lengths of all kinds are then ranked in one aggregation.
    """
    m = F.col(messages)
    counted = F.transform(m, lambda x: F.struct(x["role"].alias("kind"), word_count(F.coalesce(x["content"], F.lit("None"))).alias("words")))
    whole = lambda c: F.concat(c, F.array(F.struct(F.lit("row").alias("kind"), F.aggregate(c, F.lit(0), lambda a, x: a + x["words"]).alias("words"))))
    each = rows.where(F.size(m) > 0).select(F.col(layer).alias("layer"), F.explode(let(counted, whole)).alias("x")).select("layer", "x.kind", "x.words")
    per = nearest_rank(each.where(F.col("kind").isin("system", "user", "row")), ["layer", "kind"], "words", SHARES)
    of = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    return per.groupBy("layer").agg(
        of("row", "n").alias("rows"), *[of("row", p).alias(f"row_{p}") for p in SHARES], of("row", "most").alias("row_max"),
        F.floor(of("system", "mean")).cast("bigint").alias("sys_mean"), *[of("user", p).alias(f"user_{p}") for p in SHARES],
    )
