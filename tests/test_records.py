from pyspark.sql import functions as F

from loomspark.functions.records import canonical_user, effective_id


def test_canonical_user(spark):
    values = ["u-daa6-6e4f", "UDAA66E4F\t", " udaa66e4f ", "null", "N/A", "-", "0", "", None, "Unknown", "u1"]
    rows = spark.createDataFrame([(v,) for v in values], "u string").select(canonical_user(F.col("u")).alias("k")).collect()
    assert [r["k"] for r in rows] == ["udaa66e4f"] * 3 + [None] * 7 + ["u1"]


def test_effective_id(spark):
    rows = spark.createDataFrame([("x", "l", "h"), ("", "l", "h"), (None, "l", None), (None, None, "h")], "id string, l string, h string")
    got = rows.select(effective_id(F.col("id"), F.col("l"), F.col("h")).alias("i")).collect()
    assert [r["i"] for r in got] == ["x", "l:h", None, None]
