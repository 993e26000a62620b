import random

import pytest
import tiktoken
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from loomspark.llm.bpe import PATTERN, Vocabulary
from loomspark.llm.packing import BestFit, fill_report, pack
from loomspark.llm.tokenize import canonical_language, encode, token_cube, with_token_counts


def test_languages(spark):
    values = ["en", "EN", " en", "en-GB", "en_x", "", None, "??", "fr-FR"]
    rows = spark.createDataFrame([(v,) for v in values], "x string").select(canonical_language(F.col("x")).alias("k")).collect()
    assert [r["k"] for r in rows] == ["en"] * 5 + [None] * 3 + ["fr"]


def test_ids_and_counts(spark):
    enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=Vocabulary().rank, special_tokens={})
    texts = ["hello world", None, "", "<|endoftext|>", "hello world", "日本"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in encode(df, "doc_id", "text").collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    counts = {r["doc_id"]: r["tokens"] for r in with_token_counts(df.withColumn("tokens", F.lit("clash")), "text").collect()}
    assert counts == {i: len(v) for i, v in got.items()}
    many = spark.createDataFrame([(1, ["hello", None, "world"]), (2, None), (3, [])], "r long, ts array<string>")
    assert {r["r"]: r["tokens"] for r in with_token_counts(many, "ts").collect()} == {1: 2, 2: 0, 3: 0}
    assert encode(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text").count() == 0


def test_cube(spark):
    df = spark.createDataFrame([("a", None, 3), ("a", "x", 4), ("b", "x", 5)], "l string, d string, tokens long")
    got = {(r["l"], r["d"]): (r["rows"], r["tokens"]) for r in token_cube(df, ["l", "d"], ["tokens"]).collect()}
    assert got[("(all)", "(all)")] == (3, 12) and got[("a", "(none)")] == (1, 3) and got[("a", "(all)")] == (2, 7) and got[("(all)", "x")] == (2, 9)
    assert token_cube(df.where("false"), ["l", "d"], ["tokens"]).where("rows > 0").count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=80), st.integers(1, 6))
def test_best_fit_is_best_among_the_open(sizes, open_bins):
    b, free = BestFit(20, open_bins), {}
    for s in sizes:
        fitting = [f for n, f in free.items() if n not in b.closed and f >= s]
        n = b.add(s)
        if fitting:
            assert free[n] == min(fitting)
        else:
            assert n not in free
        free[n] = free.get(n, 20) - s
        assert free[n] >= 0 and b.open <= open_bins


@pytest.mark.parametrize("parts", [1, 7])
def test_nothing_is_lost_and_nothing_overflows(spark, parts):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, None, 1, 5, 40, 100, 101, 350, rng.randrange(100)])) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, tokens long").repartition(parts)
    packed = pack(df, "doc_id", "tokens", [(1, 100), (2, 1000)], open_bins=8, tasks_per_group=2)
    by_doc = {(r["budget_id"], r["doc_id"]): r for r in packed.groupBy("budget_id", "doc_id").agg(F.sum("tokens").alias("n"), F.count("*").alias("pieces"), F.max("piece").alias("last")).collect()}
    for i, n in rows:
        for b, c in ((1, 100), (2, 1000)):
            assert by_doc[b, i]["n"] == (n or 0)
            assert by_doc[b, i]["pieces"] == by_doc[b, i]["last"] + 1 == max(1, -(-(n or 0) // c))
    full = packed.groupBy("budget_id", "container").agg(F.sum("tokens").alias("n"))
    assert full.where("(budget_id = 1 AND n > 100) OR (budget_id = 2 AND n > 1000)").count() == 0
    budgets = spark.createDataFrame([(1, 100), (2, 1000)], "budget_id int, capacity int")
    report = {r["budget_id"]: r for r in fill_report(packed, budgets, "tokens").collect()}
    assert report[1]["items"] == 600 and report[2]["filled"] > 0.85


def test_no_items(spark):
    assert pack(spark.createDataFrame([], "doc_id long, tokens long"), "doc_id", "tokens", [(1, 10)]).count() == 0
