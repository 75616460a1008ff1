"""The base case over vertex arrays."""

import numpy as np
import pytest

from tests.test_msf import collected, plain, random_graph
from tests.test_rounds import plan, ranked
from weald.operators import contraction
from weald.plans import dense
from weald.plans.engine import Log, msf
from weald.schema import EDGE


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_forest_and_labels(spark, parts, monkeypatch):
    monkeypatch.setattr(dense, "SLICE", 16)
    monkeypatch.setattr(dense, "FAN_IN", 3)
    monkeypatch.setattr(dense, "TOGETHER", 50)
    rows = random_graph(31, 90, 700, 20) + [(500, 501, 1)]
    df = ranked(spark, rows).repartition(parts)
    ids, labels, stages = dense.dense_forest(df.select("u", "v", "eid"))
    forest = plain(rows)
    assert collected(contraction.by_ids(df, ids)) == forest
    label = {r["vertex"]: r["parent"] for r in labels.collect()}
    vertices = {x for e in rows if e[0] != e[1] for x in e[:2]}
    assert len({label.get(x, x) for x in vertices}) == len(vertices) - len(forest)
    for stage in stages:
        stage.drop()


def test_edges_are_not_exchanged(spark):
    df = ranked(spark, random_graph(32)).select("u", "v", "eid")
    names = spark.sparkContext.broadcast(dense.vertex_names(df))
    label = spark.sparkContext.broadcast(np.arange(len(names.value)))
    text = plan(dense.merged(dense.partition_minima(df, names, label), 64))
    assert text.count("Exchange hashpartitioning(part") == 2 and text.count("Exchange") == 2  # a level of the tree each
    assert "Exchange" not in text[text.index("MapInArrow") :]


def test_bound_on_vertices(spark):
    df = spark.createDataFrame([(0, 1, 1), (2, 3, 1)], EDGE)
    with pytest.raises(ValueError, match="more than 3"):
        dense.vertex_names(df, 3)
    assert len(dense.vertex_names(df, 4)) == 4


@pytest.mark.parametrize("algorithm", ["boruvka", "filter_boruvka"])
@pytest.mark.parametrize("level", [0, 1, 2])
def test_strategies_end_with_it(spark, algorithm, level):
    rows, log = random_graph(33, 100, 900), Log()
    assert collected(msf(spark.createDataFrame(rows, EDGE).repartition(3), algorithm, level, log, base_edges=20)) == plain(rows)
    assert "dense base case" in [s["step"] for s in log.steps]
    log.drop()
