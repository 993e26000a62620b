import random

from hypothesis import HealthCheck, given, settings, strategies as st

from loomspark.llm.components import connected_components


def brute(edges):
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[root(a)] = root(b)
    groups = {}
    for v in parent:
        groups.setdefault(root(v), set()).add(v)
    return {frozenset(g) for g in groups.values()}


def found(spark, edges, most):
    df = spark.createDataFrame(edges, "src long, dst long")
    groups, rows = {}, connected_components(df, small_graph_edges=most).collect()
    for r in rows:
        groups.setdefault(r["component"], set()).add(r["vertex"])
    assert len(rows) == len({r["vertex"] for r in rows})
    assert all(k in v for k, v in groups.items())
    return {frozenset(g) for g in groups.values()}


def test_empty_null_loops_and_repeats(spark):
    assert found(spark, [], 0) == set()
    edges = [(1, 1), (None, 2), (3, None), (1, 2), (2, 1), (1, 2)]
    assert found(spark, edges, 0) == {frozenset({1, 2})} == found(spark, edges, 100)


def test_paths_stars_and_rings_by_frontiers(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    ring = [(2000 + i, 2000 + (i + 1) % 9) for i in range(9)]
    edges = path + star + ring + [(1005, 2003)]
    assert found(spark, edges, 0) == brute(edges)


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.integers(0, 10**6))
def test_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(rng.randrange(90))]
    assert found(spark, edges, 3) == brute(edges)


def test_strings(spark):
    df = spark.createDataFrame([("a", "b"), ("c", "b"), ("x", "y")], "src string, dst string")
    rows = {r["vertex"]: r["component"] for r in connected_components(df, 0).collect()}
    assert rows["a"] == rows["b"] == rows["c"] != rows["x"] == rows["y"]
