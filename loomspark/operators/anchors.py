"""Token samples: render, tokenise, mask; anchors and their weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomspark.functions.text import render, word_id, words


def tokenised(records: DataFrame, id_: str, messages: str, max_length: int = 4096) -> DataFrame:
    """``(id, input_ids, attention_mask, loss_mask)`` of each record that renders.

    The stand-in tokeniser makes a token of each word. A token is supervised if its word begins within a model turn,
    after the loss prefix; the end-of-turn marker belongs to the turn. Long samples are cut to ``max_length``.
    """
    text = records.select(id_, render(F.col(messages)).alias("text")).where("text IS NOT NULL AND text <> ''")
    # Cut the text where supervision begins and ends: odd pieces are supervised. U+0001 stands in no rendered text.
    mark = "\x01"
    cut = F.regexp_replace("text", r"(?d)(<\|turn>model\n(?:<\|channel>thought\n<channel\|>)?)([\s\S]*?(?:<turn\|>\n|$))", f"$1{mark}$2{mark}")
    pieces = text.select(id_, F.split(cut, mark).alias("pieces"))
    found = pieces.select(id_, F.transform("pieces", lambda p: words(p)).alias("found"))
    counted = found.select(
        id_,
        F.transform(F.flatten("found"), word_id).alias("input_ids"),
        F.flatten(F.transform("found", lambda w, i: F.array_repeat((i % 2).cast("tinyint"), F.size(w)))).alias("loss_mask"),
    )
    kept = [F.slice(c, 1, max_length).alias(c) for c in ("input_ids", "loss_mask")]
    return counted.select(id_, *kept).withColumn("attention_mask", F.transform("input_ids", lambda x: F.lit(1).cast("tinyint")))


def supervised(mask: Column) -> Column:
    return F.aggregate(mask, F.lit(0), lambda a, x: a + x)


def valid_anchors(mask: Column) -> Column:
    """0-based places t where t and t + 1 are supervised."""
    return F.filter(
        F.transform(F.sequence(F.lit(0), F.greatest(F.size(mask) - 2, F.lit(0))), lambda t: F.when((F.get(mask, t) == 1) & (F.get(mask, t + 1) == 1), t)),
        lambda t: t.isNotNull(),
    )


def sampled_anchors(samples: DataFrame, id_: str, mask: str, n: int, seed: int) -> DataFrame:
    """``(id, anchors, keep_mask)``: up to ``n`` valid places, those of least random key, padded with 0."""
    key = lambda t: F.md5(F.concat(F.col(id_).cast("string"), F.lit(":"), t.cast("string"), F.lit(f":{seed}")).cast("binary"))
    ordered = F.array_sort(F.transform(valid_anchors(F.col(mask)), lambda t: F.struct(key(t).alias("k"), t.alias("t"))))
    chosen = samples.select(id_, F.transform(F.slice(ordered, 1, n), lambda x: x["t"]).alias("a"))
    missing = F.lit(n) - F.size("a")
    return chosen.select(id_, F.concat("a", F.array_repeat(F.lit(0), missing)).alias("anchors"), F.concat(F.transform("a", lambda x: F.lit(True)), F.array_repeat(F.lit(False), missing)).alias("keep_mask"))


def supervised_steps(samples: DataFrame, id_: str, mask: str, steps: int) -> DataFrame:
    """``(step, n)``: anchors whose place ``anchor + step + 1`` is supervised, for each step that has any.

    Each sample counts within itself; only ``steps`` numbers leave it.
    """
    at = samples.select(F.col(mask).alias("mask"), valid_anchors(F.col(mask)).alias("valid"))
    each = [F.size(F.filter("valid", lambda t: F.coalesce(F.get(F.col("mask"), t + k + 1), F.lit(0)) == 1)) for k in range(steps)]  # noqa: B023 - used at once
    sums = at.agg(*[F.sum(n).alias(f"_{k}") for k, n in enumerate(each)])
    rows = F.array(*[F.struct(F.lit(k).alias("step"), F.col(f"_{k}").cast("long").alias("n")) for k in range(steps)])
    return sums.select(F.explode(rows).alias("x")).select("x.step", "x.n").where("n > 0")


def anchors_for(mask: Column, skip: int, steps: int) -> Column:
    """Valid places but the first ``skip``, that leave ``steps`` and one more places after them."""
    return F.filter(F.slice(valid_anchors(mask), skip + 1, 1 << 30), lambda t: t < F.size(mask) - 1 - steps)
