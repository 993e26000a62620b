"""Splits and routes of records: stratified, by id sets, by status; resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomspark.functions.text import preview, shuffle_key


def usable(status: Column) -> Column:
    """A null status means success."""
    return status.isNull() | (status == "success")


def eval_size(n: Column, share: float | None = None, fixed: int | None = None) -> Column:
    """How many of a stratum's n rows are held out: a rounded share that leaves one, or a fixed number."""
    if fixed is not None:
        return F.least(F.lit(fixed), n)
    return F.when(n > 1, F.greatest(F.lit(0), F.least(F.rint(n * share), n - 1))).otherwise(0)


def stratified_split(rows: DataFrame, stratum: str, id_: str, seed: int, share: float | None = None, fixed: int | None = None, buckets: int = 4096) -> DataFrame:
    """``rows`` with ``split``: in each stratum the ``k`` rows of least shuffle key are ``eval``, the others ``train``.

    Exact without sorting a stratum in one task: shuffle keys fall into ``buckets`` ordered buckets, whose counts (a
    bounded table) say which ones lie wholly below rank k; only the bucket that k falls into is ranked.
    """
    width = len(f"{buckets - 1:x}")
    keyed = rows.withColumn("_key", shuffle_key(F.col(id_), seed)).withColumn("_bucket", F.conv(F.substring("_key", 1, width), 16, 10).cast("int"))
    per = keyed.groupBy(stratum, "_bucket").agg(F.count("*").alias("_c"))
    before = Window.partitionBy(stratum).orderBy("_bucket")
    per = per.withColumn("_upto", F.sum("_c").over(before)).withColumn("_n", F.sum("_c").over(Window.partitionBy(stratum)))
    k = eval_size(F.col("_n"), share, fixed)
    per = per.select(F.col(stratum).alias("_s"), F.col("_bucket").alias("_b"), (F.col("_upto") - F.col("_c")).alias("_below"), F.col("_upto"), k.alias("_k"))
    joined = keyed.join(per, keyed[stratum].eqNullSafe(F.col("_s")) & (F.col("_bucket") == F.col("_b")))
    cutting = (F.col("_below") < F.col("_k")) & (F.col("_upto") > F.col("_k"))
    salt = F.when(cutting, F.lit(0)).otherwise(F.pmod(F.xxhash64(id_), F.lit(1 << 20)) + 1)
    rank = F.row_number().over(Window.partitionBy(stratum, "_bucket", salt).orderBy("_key", id_))
    split = F.when(F.col("_upto") <= F.col("_k"), "eval").when(cutting & (F.col("_below") + rank <= F.col("_k")), "eval").otherwise("train")
    return joined.withColumn("split", split).select(*rows.columns, "split")


def distinct_ids(*tables: DataFrame) -> DataFrame:
    """The different non-null, non-empty ids of tables with a column ``id``."""
    out = tables[0].select("id")
    for t in tables[1:]:
        out = out.unionByName(t.select("id"))
    return out.where("id IS NOT NULL AND id <> ''").distinct()


def route_by_id(rows: DataFrame, train_ids: DataFrame, eval_ids: DataFrame) -> DataFrame:
    """``rows`` with ``split``: train before eval, null (to be dropped) in neither; repeated rows all stay.

    The id sets are shuffled with the rows, or broadcast by adaptive execution where their size at run time allows it.
    """
    t = distinct_ids(train_ids).withColumn("_t", F.lit(True))
    e = distinct_ids(eval_ids).withColumn("_e", F.lit(True))
    return rows.join(t, "id", "left").join(e, "id", "left").withColumn("split", F.when(F.col("_t"), "train").when(F.col("_e"), "eval")).drop("_t", "_e")


def dropped(rows: DataFrame, *id_sets: DataFrame) -> DataFrame:
    """Rows in none of the id sets; a null id is never in one."""
    return rows.join(distinct_ids(*id_sets), "id", "left_anti")


def to_do(inputs: DataFrame, done: DataFrame) -> DataFrame:
    """Resuming: inputs whose id isn't among the successful outputs. Failed ones are tried again."""
    return inputs.join(distinct_ids(done.where(usable(F.col("status")))), "id", "left_anti")


def previews(rows: DataFrame, by: str, order: str, messages: str, n: int = 2, most: int = 200) -> DataFrame:
    """The first ``n`` rows of each split, their messages cut for reading. A top-n report: ranks within groups only."""
    cut = F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("?")), F.lit(": "), F.coalesce(preview(m["content"], most), F.lit(""))))
    first = rows.withColumn("_rank", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_rank") <= n)
    return first.select(by, order, F.array_join(cut, "\n").alias("preview"))


def skeleton(messages: Column) -> Column:
    """What is kept of a conversation for new answers: system and user messages."""
    return F.filter(messages, lambda m: m["role"].isin("system", "user"))


def skeleton_error(messages: Column) -> Column:
    """Why a conversation can't be regenerated; null if it can."""
    roles = F.transform(messages, lambda m: F.coalesce(m["role"], F.lit("?")))
    return (
        F.when(messages.isNull() | (F.size(messages) == 0), "missing conversations")
        .when(F.get(roles, 0) == "assistant", "conversation starts with assistant")
        .when(F.exists(roles, lambda r: ~r.isin("system", "user", "assistant")), F.concat(F.lit("invalid role: "), F.get(F.filter(roles, lambda r: ~r.isin("system", "user", "assistant")), 0)))
    )


def prompt_prefix(messages: Column) -> Column:
    """The messages before the first assistant's; all of them without one."""
    at = F.array_position(F.transform(messages, lambda m: m["role"]), "assistant")
    return F.when(at > 0, F.slice(messages, 1, (at - 1).cast("int"))).otherwise(messages)
