import pytest

from loomspark.llm.groupsplit import linked_groups, split_groups
from tests.llm.test_components import brute


@pytest.mark.parametrize("most", [0, 10_000])
def test_groups_against_brute_force(spark, most):
    # A user with a third of all rows, links that carry on through ids, rows without keys, clashing extra columns.
    rows = [(i, "hot" if i % 3 == 0 else f"u{i % 17}" if i % 5 else None, f"i{i % 29}" if i % 7 else None, "x") for i in range(300)]
    df = spark.createDataFrame(rows, "row long, u string, i string, _key string")
    got = {r["row"]: (r["first_row"], r["size"]) for r in linked_groups(df, "row", ["u", "i"], most).collect()}
    edges = [(r, "u" + u) for r, u, _, _ in rows if u] + [(r, "i" + i) for r, _, i, _ in rows if i]
    groups = [{x for x in g if isinstance(x, int)} for g in brute(edges)]
    want = {r: (min(g), len(g)) for g in groups for r in g}
    want |= {r[0]: (r[0], 1) for r in rows if r[0] not in want}
    assert got == want


def test_no_rows(spark):
    df = spark.createDataFrame([], "row long, u string, i string")
    assert linked_groups(df, "row", ["u", "i"]).count() == 0


def test_split_proportions_and_wholeness(spark):
    rows = [(i, i // 3, "a" if i % 2 else "b") for i in range(6000)] + [(10_000 + i, 99_999, "a") for i in range(1500)]
    df = spark.createDataFrame(rows, "row long, g long, layer string")
    split = split_groups(df, "g", "layer", {"train": 80, "validation": 10, "test": 10})
    assert split.count() == df.select("g").distinct().count()
    counts = {(r["layer"], r["split"]): r["count"] for r in df.join(split, "g").groupBy("layer", "split").count().collect()}
    for layer, n in (("a", 4500), ("b", 3000)):
        assert abs(counts[layer, "train"] / n - 0.8) < 0.02 and abs(counts[layer, "test"] / n - 0.1) < 0.02


def test_split_of_nothing_and_null_layers(spark):
    empty = spark.createDataFrame([], "g long, layer string")
    assert split_groups(empty, "g", "layer", {"train": 1}).count() == 0
    one = spark.createDataFrame([(1, None), (1, "a")], "g long, layer string")
    assert split_groups(one, "g", "layer", {"train": 8, "test": 2}).count() == 1
