"""Rounds over parts that stay where they are, and the parent table."""

import pytest

from tests.test_msf import collected, plain, random_graph
from weald.operators import contraction, edges, order
from weald.plans import rounds
from weald.plans.engine import Log, msf, msf_with_components
from weald.plans.staging import Stage
from weald.schema import EDGE


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def ranked(spark, rows):
    return order.ranked(edges.lightest(edges.without_loops(edges.canonical(spark.createDataFrame(rows, EDGE))))).df


def test_edges_are_not_exchanged_in_a_round(spark):
    parts = rounds.dealt(ranked(spark, random_graph(1)))
    best = parts.ends.selectExpr("vertex AS src", "other AS dst", "eid")
    hooks = Stage(contraction.hooked(contraction.lightest_arcs(best)), "hooks")
    stages = contraction.settled(hooks.df)
    text = plan(rounds.moved(parts, contraction.labels_of(stages), True))
    group = text[text.index("FlatMapCoGroupsInArrow") :]
    lines = group.split("\n")
    depth = lambda s: len(s) - len(s.lstrip(" :+-"))
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "Bucketed: true" in x)
    above = [x for i, x in enumerate(lines[:scan]) if depth(x) < depth(lines[scan]) and all(depth(y) > depth(x) for y in lines[i + 1 : scan + 1])]
    assert above and not any("Exchange" in x for x in above)
    assert "Exchange hashpartitioning(to" in group  # of the labels
    parts.drop()


def test_parts_hold_each_edge_once_and_split_hubs(spark, monkeypatch):
    monkeypatch.setattr(rounds, "PART_EDGES", 100)
    star = [(0, i, i) for i in range(1, 1500)]
    parts = rounds.dealt(ranked(spark, star), reduce=False)
    sizes = [r["count"] for r in parts.edges.groupBy("part").count().collect()]
    assert sum(sizes) == parts.size == 1499 and parts.buckets == 15 and max(sizes) < 300
    hub = parts.ends.where("vertex = 0").collect()
    assert len(hub) == len(sizes)  # its lightest edge in each part
    assert collected(msf(spark.createDataFrame(star, EDGE), base_edges=0, local_level=0, dense_vertices=0)) == sorted(star)


def test_labels_move_once_for_each_part(spark):
    parts = rounds.dealt(ranked(spark, random_graph(2)))
    labels = parts.ends.selectExpr("vertex", "0 AS parent").distinct()
    found = rounds.pushed(parts, labels)
    assert found.count() == found.distinct().count() == parts.ends.select("part", "vertex").distinct().count()


@pytest.mark.parametrize("depth", [1, 2, 9, 40])
def test_pointer_jumping_writes_unsettled_rows_only(spark, depth):
    rows = [(i, max(i - 1, 0)) for i in range(depth + 1)] + [(100, 100), (101, 100)]
    given = Stage(spark.createDataFrame(rows, "vertex bigint, parent bigint"), "given")
    stages = contraction.settled(given.df)
    got = {tuple(r) for r in contraction.labels_of(stages).collect()}
    assert got == {(i, 0) for i in range(1, depth + 1)} | {(101, 100)}
    written = [s.df.count() for s in stages]
    assert written[1:] == [s.counts["left"] for s in stages[:-1]]
    assert {tuple(r) for r in contraction.to_roots(given.df).df.collect()} == got | {(0, 0), (100, 100)}


@pytest.mark.parametrize("algorithm", ["boruvka", "filter_boruvka"])
@pytest.mark.parametrize("level,more", [(0, {}), (1, {}), (2, {"one_task_rows": 10**6}), (0, {"dense_vertices": 10**6}), (2, {"base_edges": 10**6})])
def test_parent_table_knows_the_components(spark, algorithm, level, more, monkeypatch):
    rows = random_graph(21, 200, 900, 50) + [(1000 + i, 1001 + i, 3) for i in range(40)]
    log = Log()
    monkeypatch.setattr(contraction, "components", None)  # not needed
    how = {"base_edges": 60, "filter_threshold": 2.0, "leftover_edges": 5, "dense_vertices": 0, "one_task_rows": 0, "least_share": 0.0} | more
    found, labels = msf_with_components(spark.createDataFrame(rows, EDGE), algorithm, level, log, **how)
    forest = plain(rows)
    assert collected(found) == forest
    label = {x: x for u, v, _ in rows if u != v for x in (u, v)}
    for _ in label:
        for u, v, _ in forest:
            label[u] = label[v] = min(label[u], label[v])
    assert sorted(tuple(r) for r in labels.collect()) == sorted(label.items())
    log.drop()


def test_steps_carry_shuffled_bytes(spark):
    log = Log()
    msf(spark.createDataFrame(random_graph(3, 300, 2000), EDGE), "boruvka", 0, log, base_edges=50, dense_vertices=0).collect()
    steps = [s for s in log.steps if s["step"] == "round"]
    assert len(steps) >= 2 and all(s["shuffled_bytes"] >= s["shuffled_bytes_most"] > 0 for s in log.steps)
    log.drop()
