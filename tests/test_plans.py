"""What the planner makes of the operators: pruned scans, hash aggregates, no products of tables."""

import re

import pytest

from weald.operators import contraction, edges, stats
from weald.plans.queries import QUERIES
from weald.schema import EDGE
from weald.sources import tables

SMALL = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_read_only_what_is_needed(spark):
    found = re.findall(r"ReadSchema: struct<([^>]*)>", df_plan := plan(tables.customer_suppliers(spark, SMALL)))
    assert {c.split(":")[0] for s in found for c in s.split(",")} == {"c_custkey", "l_orderkey", "l_suppkey", "l_quantity", "o_orderkey", "o_custkey"}
    assert "Cartesian" not in df_plan and "NestedLoop" not in df_plan


def test_filters_reach_the_scan(spark, tmp_path):
    spark.createDataFrame([(0, 1, 5), (1, 2, 9)], EDGE).write.parquet(str(tmp_path / "e"))
    light, _ = edges.light_and_heavy(spark.read.parquet(str(tmp_path / "e")), 7)
    assert "LessThanOrEqual(weight,7)" in plan(light)


def test_minima_are_hash_aggregates(spark):
    df = spark.createDataFrame([(0, 1, 5)], EDGE).selectExpr("u AS src", "v AS dst", "weight AS eid")
    for out in (contraction.lightest_arcs(df), edges.lightest(spark.createDataFrame([(0, 1, 5)], EDGE)), stats.degrees(spark.createDataFrame([(0, 1, 5)], EDGE))):
        text = plan(out)
        assert "HashAggregate" in text and "SortAggregate" not in text and text.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize("name", ["edges_sc", "edges_nt", "symmetrize_nt", "mutual_min_roots_sc", "cut_pruned_local_edges", "rgg2d", "rhg"])
def test_no_products_of_tables(spark, name):
    text = plan(QUERIES[name](spark, SMALL))
    assert "Cartesian" not in text and "BroadcastNestedLoop" not in text


def test_symmetrising_reads_its_input_once(spark, tmp_path):
    spark.createDataFrame([(0, 1, 5)], EDGE).write.parquet(str(tmp_path / "e"))
    assert plan(edges.to_arcs(spark.read.parquet(str(tmp_path / "e")))).count("FileScan") == 1


def test_sampled_dedupe_shuffles_fewer_rows(spark):
    """Of a multigraph, rows that a settled lighter edge outweighs don't reach the exchange."""
    df = spark.range(0, 200_000, 1, 8).selectExpr("id % 50 AS u", "100 + id * 7 % 60 AS v", "1 + id * 31 % 1009 AS weight").repartition(8)
    df.write.mode("overwrite").parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/multi")
    df = spark.read.parquet(path)
    expected = sorted(map(tuple, edges.lightest(df).collect()))
    found = edges.lightest_of_many(df)
    assert sorted(map(tuple, found.collect())) == expected
    text = plan(found)
    assert "BroadcastHashJoin" in text and "LeftAnti" in text
    settled = df.where("weight <= 252").select("u", "v").distinct()
    rest = df.where("weight > 252").join(settled, ["u", "v"], "left_anti")
    assert rest.count() < 0.05 * df.count()
    for more in ({"most_keys": 3}, {"share": 0.001}, {"share": 1.0}):
        assert sorted(map(tuple, edges.lightest_of_many(df, **more).collect())) == expected
    few = spark.createDataFrame([(0, 1, 5), (0, 2, 5)], EDGE)
    assert "LeftAnti" not in plan(edges.lightest_of_many(few)) and edges.lightest_of_many(few.limit(0)).count() == 0


def test_one_task_has_a_bound(spark):
    from weald.plans import engine

    with pytest.raises(ValueError, match="too many"):
        engine.in_one_task(spark.createDataFrame([(0, 1, 5), (0, 2, 6)], "u bigint, v bigint, eid bigint"), "kruskal", most_edges=1)
