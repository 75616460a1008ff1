"""The 2-core, and which range a vertex lies in."""

import pytest

from tests.test_msf import collected, plain, random_graph
from weald.operators import edges, order
from weald.plans import peeling
from weald.plans.engine import msf
from weald.schema import EDGE


def core_of(rows):
    while True:
        degree = {}
        for u, v, _ in rows:
            degree[u], degree[v] = degree.get(u, 0) + 1, degree.get(v, 0) + 1
        left = [r for r in rows if degree[r[0]] > 1 and degree[r[1]] > 1]
        if len(left) == len(rows):
            return sorted(rows)
        rows = left


GRAPHS = {
    "random": random_graph(41, 120, 130, 9),
    "path": [(i, i + 1, 1) for i in range(30)],
    "star": [(0, i, 1) for i in range(1, 9)],
    "pair": [(0, 1, 1)],
    "cycle with branches": [(0, 1, 1), (1, 2, 1), (0, 2, 1), (2, 3, 1), (3, 4, 1), (3, 5, 1)],
    "empty": [],
}


@pytest.mark.parametrize("name", GRAPHS)
@pytest.mark.parametrize("one_task", [0, 20, 10**6])
def test_two_core(spark, name, one_task):
    df = edges.lightest(edges.without_loops(edges.canonical(spark.createDataFrame(GRAPHS[name], EDGE))))
    rows = collected(df)
    core = peeling.two_core(df, one_task)
    assert collected(core) == core_of(rows)
    if name == "random":
        peeled = set(rows) - set(collected(core))
        assert peeled and peeled <= set(plain(rows))  # branches are in every forest
        assert sorted([*collected(msf(core)), *peeled]) == plain(rows)


def test_located(spark, monkeypatch):
    df = spark.createDataFrame([(5, "a"), (-1, "b"), (10, "c"), (None, "d"), (99, "e"), (0, "f")], "vertex bigint, `a.b` string")
    bounds = spark.createDataFrame([(10,), (0,), (50,), (10,), (None,)], "x bigint")
    found = order.located(df, "vertex", bounds)
    assert found.columns == ["vertex", "a.b", "lower"]
    assert {(r[1], r[2]) for r in found.collect()} == {("a", 0), ("b", None), ("c", 10), ("d", None), ("e", 50), ("f", 0)}
    assert {r[2] for r in order.located(df, "vertex", bounds.limit(0)).collect()} == {None}
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in text and "Exchange" not in text
    monkeypatch.setattr(order, "MOST_RANGES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        order.located(df, "vertex", bounds)
