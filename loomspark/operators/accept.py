"""Draft and target tokens: prefix acceptance, rates, divergence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def accepted(draft: Column, target: Column) -> Column:
    """Length of the leading run where both agree; of the shorter one at most."""
    n = F.least(F.size(draft), F.size(target))
    at = F.array_position(F.zip_with(F.slice(draft, 1, n), F.slice(target, 1, n), lambda d, t: d.eqNullSafe(t)), False)
    return F.when(at == 0, n).otherwise(at - 1).cast("int")


def committed(first: Column, draft: Column, target: Column) -> Column:
    """The first token, the accepted ones, and the target's correction where the draft is wrong."""
    n = accepted(draft, target)
    return F.concat(F.array(first), F.slice(draft, F.lit(1), n), F.when(n < F.size(draft), F.slice(target, n + 1, F.lit(1))).otherwise(F.slice(target, F.lit(1), F.lit(0))))


def prefix_flags(draft: Column, target: Column) -> Column:
    n = accepted(draft, target)
    return F.transform(F.sequence(F.lit(0), F.size(draft) - 1), lambda k: k < n)


def rejection_accept(p: Column, q: Column, u: Column) -> Column:
    """Accept with probability p / q, decided by the given uniform number."""
    return F.coalesce((q > 0) & (p / F.nullif(q, F.lit(0.0)) >= u), F.lit(False))


def first_divergence(a: Column, b: Column) -> Column:
    """0-based place of the first difference within the common length; null if there is none."""
    n = F.least(F.size(a), F.size(b))
    return F.nullif(F.array_position(F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: x.eqNullSafe(y)), False), F.lit(0)) - 1


def acceptance(rows: DataFrame, draft: str, target: str, by: list[str] | None = None) -> DataFrame:
    """Drafts, their tokens, accepted and examined ones, both rates and the mean length of what is committed."""
    d, t = F.col(draft), F.col(target)
    n = accepted(d, t)
    per = rows.select(*(by or []), F.size(d).alias("k"), n.alias("a"), F.least(n + 1, F.size(d)).alias("x"))
    total = (per.groupBy(*by) if by else per).agg(F.count("*").alias("drafts"), F.sum("k").alias("draft_tokens"), F.sum("a").alias("accepted"), F.sum("x").alias("examined"))
    return total.select("*", (F.col("accepted") / F.col("draft_tokens")).alias("accept_rate_k"), (F.col("accepted") / F.col("examined")).alias("accept_rate_examined"), (1 + F.col("accepted") / F.col("drafts")).alias("accept_len"))


def acceptance_by_place(rows: DataFrame, draft: str, target: str, by: list[str] | None = None) -> DataFrame:
    """Share of drafts accepted up to each place."""
    flags = rows.select(*(by or []), F.posexplode(prefix_flags(F.col(draft), F.col(target))).alias("place", "ok"))
    return flags.groupBy(*(by or []), "place").agg(F.count("*").alias("drafts"), F.count_if("ok").alias("accepted"), F.avg(F.col("ok").cast("double")).alias("rate"))
