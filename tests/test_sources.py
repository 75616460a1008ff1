"""Generators, files, the runner and the registered queries."""

import json
import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from weald import runner
from weald.operators import edges
from weald.schema import EDGE
from weald.sources import compressed, files, generators

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("family", ["GNM", "RMAT", "RGG_2D", "RGG_3D", "RHG", "GRID_2D", "GRID_3D"])
def test_generators_are_canonical_and_repeatable(spark, family):
    log_n = 3 if family.startswith("GRID") else 8
    a, b = (generators.generate(spark, family, log_n, 10, seed=1).orderBy("u", "v").collect() for _ in range(2))
    assert a == b and a
    assert all(r["u"] < r["v"] and 1 <= r["weight"] <= 254 for r in a) and len({r[:2] for r in a}) == len(a)


def test_sizes(spark):
    assert generators.grid_2d(spark, 3, 4).count() == 2 * 8 * 16
    assert generators.grid_3d(spark, 2).count() == 3 * 64
    for family in ("RGG_2D", "RGG_3D", "RHG"):
        assert 0.3 < generators.generate(spark, family, 11, 13).count() / (1 << 13) < 3


def test_geometric_graph_is_complete(spark):
    n, radius = 1 << 7, 0.15
    x = {r["id"]: (r["a"], r["b"]) for r in spark.range(n).select("id", generators.uniform(5, F.col("id"), 0).alias("a"), generators.uniform(5, F.col("id"), 1).alias("b")).collect()}
    expected = {(i, j) for i in x for j in x if i < j and math.dist(x[i], x[j]) <= radius}
    assert {(r["u"], r["v"]) for r in generators.rgg(spark, 2, 7, radius, seed=5).collect()} == expected


def test_hyperbolic_cells_lose_no_pair(spark):
    whole = generators.rhg(spark, 8, 10, seed=2, bands=1)  # one band: all pairs are compared
    assert edges.difference(whole, generators.rhg(spark, 8, 10, seed=2)).count() == 0


def test_binary_files(spark, tmp_path):
    rows = [(0, 1, 254), (2**32 - 1, 5, 1), (7, 7, 0)]
    df = spark.createDataFrame(rows, EDGE).coalesce(1)
    assert sorted(map(tuple, files.decode_records(files.to_records(df)).collect())) == sorted(rows)
    assert files.write_binary(df, str(tmp_path / "out")) == 3
    assert (tmp_path / "out/part-00000.bin").stat().st_size == 27
    assert sorted(map(tuple, files.read_binary(spark, str(tmp_path / "out/part-00000.bin")).collect())) == sorted(rows)
    np.array([(1, 2, 3)], files.RECORD).tofile(tmp_path / "b.bin")
    both = files.read_binary(spark, str(tmp_path / "out/part-00000.bin"), str(tmp_path / "b.bin"))
    assert both.count() == 4
    many = spark.range(5000).selectExpr("id AS u", "id + 1 AS v", "id % 256 AS weight").repartition(3)
    assert files.write_binary(many, str(tmp_path / "many")) == 5000
    assert files.write_binary(many, str(tmp_path / "many")) == 5000  # again over the same files
    assert sorted(map(tuple, files.read_binary(spark, str(tmp_path / "many")).collect())) == sorted(map(tuple, many.collect()))
    assert files.read_binary(spark, str(tmp_path / "many/*.bin")).count() == 5000
    (tmp_path / "short.bin").write_bytes(b"1234567890")
    with pytest.raises(ValueError, match="within a record"):
        files.read_binary(spark, str(tmp_path / "short.bin"))
    with pytest.raises(ValueError, match="no such file"):
        files.read_binary(spark, str(tmp_path / "none.bin"))
    with pytest.raises(Exception, match="does not fit"):
        files.to_records(spark.createDataFrame([(0, 1, 256)], EDGE)).collect()


def test_compressed_tables(spark):
    rows = [(i * 7 % 50, i, i * i) for i in range(300)] + [(2**61, 2**61 + 1, 0)]
    blobs = compressed.compressed(spark.createDataFrame(rows, EDGE), 3)
    assert sorted(map(tuple, compressed.decompressed(blobs).collect())) == sorted(rows)
    assert sum(len(r["data"]) for r in blobs.collect()) < 8 * len(rows)
    assert compressed.decompressed(compressed.compressed(spark.createDataFrame([], EDGE), 2)).count() == 0


def test_matrix_market(spark, tmp_path):
    (tmp_path / "g.mtx").write_text("%%MatrixMarket matrix coordinate pattern symmetric\n% comment\n4 4 3\n1 2\n3 2\n4 4\n")
    got = files.read_matrix_market(spark, str(tmp_path / "g.mtx")).orderBy("u").collect()
    assert [(r["u"], r["v"]) for r in got] == [(0, 1), (1, 2)]


def test_configs():
    assert files.read_configs("--graphtype GNM --log_n 5 # x\n\n--gamma=2.5") == [{"graphtype": "GNM", "log_n": 5}, {"gamma": 2.5}]
    for bad in ("log_n 5", "--log_n"):
        with pytest.raises(ValueError):
            files.read_configs(bad)


def test_runner(spark, tmp_path, capsys):
    (tmp_path / "c.txt").write_text("--graphtype GRID_2D --log_n 3\n--graphtype GNM --log_n 5 --log_m 7\n")
    got = runner.main(["--configfile", str(tmp_path / "c.txt"), "--algorithm", "boruvka", "merge", "--checks", "--outfile", str(tmp_path / "out")])
    assert len(got) == 4 and all(x["checked"] for x in got)
    assert all(x["shuffled_bytes"] >= x["shuffled_bytes_most"] >= 0 for x in got) and any(x["shuffled_bytes"] for x in got)
    assert got[0]["forest_edges"] == 63 and got[0]["forest_weight"] == got[1]["forest_weight"]
    assert len([json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]) == 4


@pytest.mark.parametrize("name", ["edges_nt", "relabel_after_round1_sc", "component_labels_ntr", "densified_cs", "mst_diff", "msf_ntr_rounds", "msf_size_by_component", "unpacked_keys_nt", "msf_hub_orders", "dedupe_sampled_lines", "owner_ranges_cs", "binary_files_nt", "matrix_market_cs", "component_labels_filter_sc", "grid3d", "gnm", "rmat", "rgg2d", "rgg3d", "rhg"])
def test_queries_equal_their_sql(spark, name):
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in "nation customer supplier orders lineitem embeddings".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    result = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect()))) == sorted(map(repr, result.fetchall()))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 24


def test_runner_options(spark, capsys):
    got = runner.main("--graphtype RMAT --log_n 4 --log_m 5 --weak_scaling_workers 4 --compression_level 1 --debug_level 1 --threads 2 --checks".split())
    assert got[0]["checked"] and got[0]["log_n"] == 4 and got[0]["graph_max_id"] >= 16  # two more bits of vertices
    assert "base case" in capsys.readouterr().err
    assert runner.sizes({"log_n": 4, "log_m": 5, "weak_scaling_level": 1, "weak_scaling_workers": 8}) == (8, 9)
    with pytest.raises(ValueError):
        runner.sizes({"log_n": 4, "log_m": 5, "weak_scaling_level": 0, "weak_scaling_workers": 3})
