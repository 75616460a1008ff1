"""Forests of hand-made and random graphs by every strategy, and their invariants."""

import random

import pytest

from weald.checks import check, same
from weald.operators import contraction, edges, order, stats
from weald.plans.engine import ALGORITHMS, Log, msf
from weald.schema import EDGE
from weald.streaming.incremental import ForestKeeper, maintain

HAND = {
    "empty": ([], []),
    "single": ([(0, 1, 7)], [(0, 1, 7)]),
    "triangle": ([(0, 1, 1), (1, 2, 2), (0, 2, 3)], [(0, 1, 1), (1, 2, 2)]),
    "triangle, all equal": ([(0, 1, 5), (0, 2, 5), (1, 2, 5)], [(0, 1, 5), (0, 2, 5)]),
    "path": ([(i, i + 1, i + 1) for i in range(4)], [(i, i + 1, i + 1) for i in range(4)]),
    "star": ([(0, i, i) for i in range(1, 6)], [(0, i, i) for i in range(1, 6)]),
    "two components": ([(0, 1, 1), (1, 2, 1), (0, 2, 9), (10, 11, 4)], [(0, 1, 1), (1, 2, 1), (10, 11, 4)]),
    "parallel edges": ([(0, 1, 9), (0, 1, 2)], [(0, 1, 2)]),
    "self loop": ([(3, 3, 1), (3, 4, 2)], [(3, 4, 2)]),
    "even cycle": ([(0, 1, 1), (1, 2, 1), (2, 3, 1), (0, 3, 1)], [(0, 1, 1), (0, 3, 1), (1, 2, 1)]),
    "large ids": ([(5, 2**40, 1), (2**40, 2**41, 2)], [(5, 2**40, 1), (2**40, 2**41, 2)]),
    "wide weights": ([(0, 1, 1), (1, 2, 300), (0, 2, 2147483647)], [(0, 1, 1), (1, 2, 300)]),
    "one way": ([(1, 0, 3)], [(0, 1, 3)]),
}


def plain(rows):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    out = []
    for w, u, v in sorted((w, min(u, v), max(u, v)) for u, v, w in rows):
        if find(u) != find(v):
            up[find(u)] = find(v)
            out.append((u, v, w))
    return sorted(out)


def collected(df):
    return sorted(tuple(r) for r in df.select("u", "v", "weight").collect())


@pytest.mark.parametrize("name", HAND)
def test_hand_graphs(spark, name):
    rows, expected = HAND[name]
    df = spark.createDataFrame(rows, EDGE)
    for how in ({"algorithm": "boruvka", "local_level": 0, "base_edges": 0, "dense_vertices": 0}, {"algorithm": "boruvka", "local_level": 0, "base_edges": 0}, {"algorithm": "boruvka"}, {"algorithm": "merge"}, {"algorithm": "kruskal"}):
        assert collected(msf(df, **how)) == sorted(expected)


def random_graph(seed, n=60, m=240, most=9):
    rng = random.Random(seed)
    return [(rng.randrange(n), rng.randrange(n), rng.randint(1, most)) for _ in range(m)]


@pytest.mark.parametrize("algorithm", ALGORITHMS)
@pytest.mark.parametrize("level", [0, 1, 2])
def test_every_strategy_and_level_gives_the_same_edges(spark, algorithm, level):
    rows = random_graph(3)
    df = spark.createDataFrame(rows, EDGE).repartition(3)
    base = {"base_edges": 20, "least_share": 0.0, "dense_vertices": 0, "one_task_rows": 0 if level else 10**6} if algorithm.endswith("boruvka") else {}
    assert collected(msf(df, algorithm, level, **base)) == plain(rows)


def test_order_orientation_and_partitioning_do_not_matter(spark):
    rows = random_graph(4)
    expected = plain(rows)
    rng = random.Random(0)
    for parts in (1, 7):
        rng.shuffle(rows)
        df = spark.createDataFrame([(v, u, w) if rng.random() < 0.5 else (u, v, w) for u, v, w in rows], EDGE).repartition(parts)
        assert collected(msf(df)) == expected
    df = spark.createDataFrame(rows, EDGE)
    once = msf(df)
    assert same(msf(once), once)
    assert check(df, once).fine


def test_check_finds_faults(spark):
    rows = random_graph(5)
    df = spark.createDataFrame(rows, EDGE)
    right = plain(rows)
    assert check(df, spark.createDataFrame(right[1:], EDGE)).size == -1
    assert check(df, spark.createDataFrame([*right, right[0]], EDGE)).repeated == 1
    assert check(df, spark.createDataFrame([(u, v, w + 1) for u, v, w in right], EDGE)).foreign


@pytest.mark.parametrize("row", [(0, 1, None), (None, 1, 1), (0, 1, -1), (-1, 2, 1), (0, 2**62, 1)])
def test_bad_edges_are_rejected(spark, row):
    with pytest.raises(Exception, match="not an edge"):
        msf(spark.createDataFrame([(0, 1, 1), row], EDGE)).collect()


def test_wrong_options(spark):
    df = spark.createDataFrame([(0, 1, 1)], EDGE)
    for how in ({"algorithm": "prim"}, {"local_level": 3}):
        with pytest.raises(ValueError):
            msf(df, **how)
    with pytest.raises(ValueError, match="weight"):
        msf(df.select("u", "v"))


@pytest.mark.parametrize("base_edges", [0, 50, 10**6])
def test_components(spark, base_edges):
    rows = [(i, i + 1, 1) for i in range(100)] + [(200, 201, 1), (201, 150, 1), (300, 301, 1), (400, 400, 1)] + random_graph(6, 40, 30)
    got = {r["vertex"]: r["component"] for r in contraction.components(spark.createDataFrame(rows, EDGE), base_edges).collect()}
    forest = plain(rows)
    label = {x: x for e in rows for x in e[:2]}
    for _ in label:
        for u, v, _ in forest:
            label[u] = label[v] = min(label[u], label[v])
    assert got == label


def test_numbering_is_dense_and_ordered(spark):
    rows = random_graph(7)
    got = [tuple(r) for r in order.numbered(spark.createDataFrame(rows, EDGE).repartition(5), "weight", "u", "v").orderBy("eid").collect()]
    assert [r[3] for r in got] == list(range(len(rows))) and [(w, u, v) for u, v, w, _ in got] == sorted((w, u, v) for u, v, w in rows)


def test_packing_keeps_high_weights(spark):
    df = spark.createDataFrame([(3, 4, 254)], EDGE)
    p = df.select(edges.pack(df["weight"], df["u"], 56).alias("p"))
    assert p.select(*edges.unpack(p["p"], 56)).collect()[0][:] == (254, 3)


def test_histogram_counts_every_vertex(spark):
    got = {r["bucket"]: r["vertices"] for r in stats.degree_histogram(spark.createDataFrame(HAND["star"][0], EDGE)).collect()}
    assert got == {0: 5, 2: 1}


def test_stream_keeps_the_forest(spark, tmp_path):
    rows = random_graph(8)
    source = tmp_path / "in"
    for k in range(3):
        spark.createDataFrame(rows[k::3], EDGE).write.mode("append").parquet(str(source))
    keeper = ForestKeeper()
    query = maintain(spark.readStream.schema(EDGE).option("maxFilesPerTrigger", 2).parquet(str(source)), keeper, str(tmp_path / "state"))
    query.awaitTermination(120)
    assert collected(keeper.current) == plain(rows)
    more = random_graph(9)  # a new driver resumes from the checkpoint
    spark.createDataFrame(more, EDGE).write.mode("append").parquet(str(source))
    again = ForestKeeper()
    maintain(spark.readStream.schema(EDGE).parquet(str(source)), again, str(tmp_path / "state")).awaitTermination(120)
    assert collected(again.current) == plain(rows + more)


def test_aliases_and_guard(spark):
    from weald.plans import local
    from weald.plans.engine import ALIASES

    rows = random_graph(10)
    df = spark.createDataFrame(rows, EDGE).repartition(20)
    assert all(collected(msf(df, name)) == plain(rows) for name in ("hybridBoruvka", "local_kruskal"))
    assert set(ALIASES.values()) <= set(ALGORITHMS)
    ranked = order.ranked(edges.lightest(edges.canonical(edges.without_loops(df)))).df.repartition(20)
    assert collected(contraction.by_ids(ranked, local.merged(ranked, fan_in=3))) == plain(rows)
    plan = local.merged(ranked, fan_in=3)._jdf.queryExecution().executedPlan().toString()
    assert "Coalesce" not in plan and plan.count("hashpartitioning(_group") >= 2  # every level runs in tasks of its own
    with pytest.raises(ValueError, match="too large"):
        local.merged(ranked, most_vertices=10)


def test_unequal_splits_are_left_alone(spark):
    rows = random_graph(11, 40, 400)
    df = spark.createDataFrame(rows, EDGE)
    assert collected(msf(df, "filter_boruvka", 0, base_edges=20, stop_share=0.1, dense_vertices=0)) == plain(rows)


@pytest.mark.parametrize("leftover", [0, 10**6])
def test_leftovers_wait_for_the_split_around(spark, leftover):
    rows = random_graph(12, 40, 600, 50)
    log = Log()
    assert collected(msf(spark.createDataFrame(rows, EDGE), "filter_boruvka", 0, log, base_edges=10, filter_threshold=1.0, leftover_edges=leftover, dense_vertices=0)) == plain(rows)
    assert max(s["depth"] for s in log.steps if s["step"] == "split") >= 2
    log.drop()


def test_chunks_keep_the_forest(monkeypatch):
    import numpy as np

    from weald.plans import local

    rows = sorted({(min(u, v), max(u, v)) for u, v, _ in random_graph(14, 30, 300) if u != v})
    u, v = (np.array(x) for x in zip(*rows, strict=True))
    eid = np.random.default_rng(0).permutation(len(rows))
    whole = local.Chunks()
    whole.add(u, v, eid)
    monkeypatch.setattr(local, "CHUNK_EDGES", 20)
    chunks = local.Chunks()
    for at in range(0, len(rows), 7):
        chunks.add(u[at : at + 7], v[at : at + 7], eid[at : at + 7])
        assert sum(len(x[0]) for x in chunks.held) <= 20 + 29
    assert all((a == b).all() for a, b in zip(chunks.forest(), whole.forest(), strict=True))
    assert [len(x) for x in local.Chunks().forest()] == [0, 0, 0]


def test_local_contraction_by_blocks(spark):
    """Chains of near vertices contract within blocks; graphs without local edges are left alone."""
    rows = [(i, i + 1, i % 7 + 1) for i in range(400)] + [(i, i + 3, 9) for i in range(300)] + random_graph(13, 400, 60, 5)
    log = Log()
    df = spark.createDataFrame(rows, EDGE)
    assert collected(msf(df, "boruvka", 1, log, base_edges=0, dense_vertices=0)) == plain(rows)
    assert next(s for s in log.steps if s["step"] == "contract locally")["local_share"] > 0.5
    far = [(i, 1000 + i, i) for i in range(1, 50)]
    log = Log()
    assert collected(msf(spark.createDataFrame(far, EDGE), "boruvka", 1, log)) == plain(far)
    assert "no local contraction" in [s["step"] for s in log.steps]
