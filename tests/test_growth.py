"""Steps whose cost must not grow faster than their input."""

import numpy as np

from tests.test_msf import collected, plain, random_graph
from tests.test_plans import SMALL, plan
from weald.functions import forest
from weald.operators import contraction, edges, order
from weald.plans import engine, local, queries
from weald.schema import EDGE
from weald.sources import tables


def test_pairs_of_suppliers_are_not_exchanged(spark, monkeypatch):
    lines = tables.read(spark, SMALL, "lineitem").select("l_suppkey", "l_partkey").distinct().collect()
    parts, expected = {}, {}
    for s, p in lines:
        parts.setdefault(p, set()).add(s)
    for p, of in parts.items():
        for u in of:
            for v in of:
                if u < v:
                    expected[u, v] = min(expected.get((u, v), 999), 1 + (p * 7919 + u * 104729 + v * 1299709) % 254)
    for bits, pairs in ((6, 2_000_000), (1, 100)):
        monkeypatch.setattr(tables, "BLOCK_BITS", bits)
        monkeypatch.setattr(tables, "TASK_PAIRS", pairs)
        got = tables.supplier_parts(spark, SMALL)
        text = plan(got)
        assert "Join" not in text and text.count("Exchange ") == 1  # of lists, by block
        assert "Generate" in text[: text.index("Exchange")]
        assert {(r["u"], r["v"]): r["weight"] for r in got.collect()} == expected and got.count() == len(expected)


def test_lightest_edges_are_hash_aggregates(spark):
    rows = random_graph(41, 30, 200, 4)
    df = spark.createDataFrame([r for r in rows if r[0] != r[1]], EDGE)  # either end may be the lesser
    best = {}
    for u, v, w in rows:
        for x in (u, v) if u != v else ():
            best[x] = min(best.get(x, (99, 0, 0)), (w, u, v))
    found = contraction.lightest_edge_per_vertex(df)
    assert {r["vertex"]: (r["weight"], r["u"], r["v"]) for r in found.collect()} == best
    text = plan(found)
    assert "SortAggregate" not in text and "HashAggregate" in text


def test_hooks_need_no_join_by_neighbour(spark):
    arcs = spark.createDataFrame([(i, 0, i) for i in range(1, 50)] + [(0, 1, 1), (100, 101, 60), (101, 100, 60)], "src bigint, dst bigint, eid bigint")
    found = contraction.hooked(arcs)
    expected = {(0, 0, 1, True), (1, 0, 1, False), (100, 100, 60, True), (101, 100, 60, False)} | {(i, 0, i, False) for i in range(2, 50)}
    assert {tuple(r) for r in found.collect()} == expected and found.count() == len(expected)
    assert "Join" not in plan(found)


def test_parts_dealt_by_ends_leave_few_edges(spark, monkeypatch):
    """Of 40 groups whose ends are near one another, ranked by weight: in place most edges stay, dealt out few do."""
    monkeypatch.setattr(local, "NEAR_EDGES", 500)
    rows = [(100 * k + u, 100 * k + v, w) for k in range(40) for u, v, w in random_graph(50 + k, 40, 300, 1000)]
    df = order.ranked(spark.createDataFrame(rows, EDGE).where("u <> v").selectExpr("least(u, v) AS u", "greatest(u, v) AS v", "weight").groupBy("u", "v").agg({"weight": "min"}).toDF("u", "v", "weight")).df
    df = df.repartition(24)
    vertices, size = 40 * 40, df.count()
    assert local.reduced(df).count() > 4 * vertices > 2 * local.reduced(local.near(df, size)).count()
    for how in ("kruskal", "filter_kruskal", "merge", "boruvka"):
        log = engine.Log()
        assert collected(engine.msf(spark.createDataFrame(rows, EDGE), how, log=log)) == plain(rows)
        assert any("reduced" in getattr(t, "path", "") for t in log.tables)
        log.drop()


def test_dense_graphs_are_reduced_before_any_exchange(spark):
    rows = [r for r in random_graph(61, 60, 4000, 9) if r[0] != r[1]]
    rows += rows[:50]  # equal parallels, that may lie in different partitions
    for shift in (0, 1 << 40):  # of the second kind an id can't pack weight and ends
        given = [(u + shift, v + shift, w) for u, v, w in rows]
        df = spark.createDataFrame(given, EDGE).repartition(4)
        for how in ("boruvka", "filter_boruvka", "merge", "kruskal", "filter_kruskal"):
            log = engine.Log()
            assert collected(engine.msf(df, how, log=log)) == plain(given)
            assert log.steps[0]["step"] == "prepare" and log.steps[0]["edges"] <= 4 * 60
            log.drop()
        found = engine.prepared(df, reduce=True)
        assert found.packed == (shift == 0)
        ids = [r["eid"] for r in found.df.distinct().orderBy("weight", "u", "v").collect()]
        assert ids == sorted(set(ids))
        # edges are read from their ids, without a join with all edges
        assert ("Join" in plan(found.edges_of(found.df.select("eid")))) == (shift > 0)
        found.drop()


def test_forests_of_suppliers_take_pairs_as_they_are_made(spark):
    log = engine.Log()
    got = collected(engine.msf(tables.supplier_pairs(spark, SMALL), "merge", log=log))
    assert got == collected(engine.msf(tables.supplier_parts(spark, SMALL), local_level=0))
    assert "Aggregate" not in plan(tables.supplier_pairs(spark, SMALL))
    log.drop()


def test_light_first_is_contract():
    rng = np.random.default_rng(5)
    for n, m in ((30, 2000), (300, 3000), (50, 100), (5, 0)):
        u, v, w = (rng.integers(0, k, m) for k in (n, n, 20))
        order = forest.order_of(u, v, w)
        assert [tuple(x) for x in np.stack([w, u, v], 1)[order].tolist()] == sorted(zip(w.tolist(), u.tolist(), v.tolist(), strict=True))
        far = 1 << 60
        assert (np.stack([w, u, v], 1)[forest.order_of(u + far, v + far, w)] == np.stack([w, u, v], 1)[order]).all()
        u, v = u[order], v[order]
        keep, label = forest.light_first(n, u, v)
        same, joined = forest.contract(n, u, v)
        assert keep.tolist() == same.tolist() and [list(label).index(x) for x in label] == [list(joined).index(x) for x in joined]
        names, (a, b) = forest.compact(u, v) if m else (np.empty(0, int), (u, v))
        assert (names[a] == u).all() and (names[b] == v).all() and names.tolist() == sorted(set(u.tolist()) | set(v.tolist()))


def test_lightest_edges_are_numbered_among_the_first_only(spark):
    rows = [(u, v, w) for u, v, w in random_graph(71, 40, 3000, 200) if u < v]
    df = spark.createDataFrame(rows + rows[:40], EDGE)
    whole = order.numbered(edges.lightest(df), *order.TOTAL_ORDER)
    light = contraction.up_to_lightest(df)
    assert light.count() < whole.count() / 4
    found, expected = (sorted(tuple(r) for r in contraction.lightest_arcs(edges.to_arcs(g.drop("weight"))).collect()) for g in (order.numbered(light, *order.TOTAL_ORDER), whole))
    assert found == expected and len(found) == 40
    lone = spark.createDataFrame([*rows, (100, 101, 500)], EDGE)  # heavy edges only: the whole graph
    assert contraction.up_to_lightest(lone).count() == edges.lightest(lone).count()
    assert contraction.up_to_lightest(df.limit(0)).count() == 0


def test_numbers_of_chosen_pairs_need_no_sort_of_all(spark, monkeypatch):
    every = sorted((r["weight"], r["u"], r["v"]) for r in tables.supplier_parts(spark, SMALL).collect())
    chosen = every[::7] + [every[-1]]
    for bits in (6, 1):
        monkeypatch.setattr(tables, "BLOCK_BITS", bits)
        asked = spark.createDataFrame([(u, v, w) for w, u, v in set(chosen)], EDGE)
        found = {(r["u"], r["v"]): r["eid"] for r in tables.supplier_numbers(spark, SMALL, asked).collect()}
        assert found == {(u, v): every.index((w, u, v)) for w, u, v in chosen}


def test_queries_of_dense_graphs_reduce_pairs_as_they_are_made(spark, monkeypatch):
    """no query of supplier pairs writes or exchanges all of them."""
    logs, solved = [], engine._solved
    monkeypatch.setattr(engine, "_solved", lambda given, config, log, parents: logs.append((log, given)) or solved(given, config, log, parents))
    every = tables.supplier_parts(spark, SMALL)
    least = collected(engine.msf(every, "merge"))
    logs.clear()
    for name in ("msf_sc_dense", "msf_sc_filter"):
        assert collected(queries.QUERIES[name](spark, SMALL)) == least
    labels = queries.QUERIES["component_labels_filter_sc"](spark, SMALL).collect()
    assert len(labels) == len({x for u, v, _ in least for x in (u, v)}) == len({r["vertex"] for r in labels})
    assert len({r["component"] for r in labels}) == len(labels) - len(least)
    assert len(logs) == 3
    for log, given in logs:
        assert "Aggregate" not in plan(given)  # parallel pairs are not put together by an exchange
        assert log.steps[0]["step"] == "prepare" and log.steps[0]["edges"] < given.count()
        log.drop()


def test_edges_without_locality_are_reduced_until_they_fit_a_task(spark, monkeypatch):
    """parts' forests keep most edges of a graph whose ends have no locality; their number is no error while the forest fits."""
    monkeypatch.setattr(local, "NEAR_EDGES", 50)
    monkeypatch.setattr(engine, "TASK_EDGES", 450)
    monkeypatch.setattr(engine.in_one_task, "__defaults__", (450,))
    rng = np.random.default_rng(8)
    rows = [(int(u), int(v) + 1000, int(w)) for u, v, w in zip(rng.integers(0, 200, 4000), rng.integers(0, 200, 4000), rng.integers(0, 50, 4000), strict=True)]
    for how in ("filter_kruskal", "kruskal"):
        log = engine.Log()
        assert collected(engine.msf(spark.createDataFrame(rows, EDGE).repartition(40), how, log=log)) == plain(rows)
        left = [t.counts["edges"] for t in log.tables if "reduced" in getattr(t, "path", "")]
        assert left[0] > 450 >= left[-1] and len(left) > 1
        log.drop()
