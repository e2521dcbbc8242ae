from hypothesis import given, settings
from hypothesis import strategies as st

from weftgraph.operators.components import connected_components


def expected(edges):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {n: find(n) for n in parent}


def found(spark, edges):
    rows = connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()
    assert len(rows) == len({r["node"] for r in rows})
    return {r["node"]: r["component"] for r in rows}


def test_shapes(spark):
    chain = [(i, i + 1) for i in range(40)]
    star = [(100, 100 + i) for i in range(1, 30)]
    cycle = [(200, 201), (201, 202), (202, 200)]
    loop = [(300, 300)]
    both = [(400, 401), (401, 400)]
    edges = chain + star + cycle + loop + both
    assert found(spark, edges) == expected(edges)
    assert found(spark, []) == {}


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=30))
def test_random_graphs(spark, edges):
    assert found(spark, edges) == expected(edges)
