"""Experiments: a grid of graphs, algorithms and options, measured and written as JSON lines.

python -m weald.runner --graphtype GNM --log_n 10 --log_m 14 --algorithm boruvka filter_boruvka --iterations 3 --checks
"""

from __future__ import annotations

import argparse
import itertools
import json
import sys
from time import perf_counter

from pyspark.sql import DataFrame, SparkSession

from weald.checks import check
from weald.operators import stats
from weald.plans.engine import ALGORITHMS, ALIASES, Log, msf
from weald.plans.metrics import shuffled
from weald.plans.staging import Stage
from weald.sources import compressed, files
from weald.sources.generators import DISTANCES, MAX_WEIGHT, generate

#: Options that may be given several values; runs are made for all combinations.
GRID = ("graphtype", "log_n", "log_m", "algorithm", "local_kernelization_level", "filter_threshold")
FAMILIES = ("GNM", "RGG_2D", "RGG_3D", "RMAT", "RHG", "GRID_2D", "GRID_3D", "INFILE_UNWEIGHTED", "INFILE_WEIGHTED")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--graphtype", nargs="+", default=["GNM"], choices=FAMILIES)
    p.add_argument("--log_n", nargs="+", type=int, default=[8])
    p.add_argument("--log_m", nargs="+", type=int, default=[12])
    p.add_argument("--algorithm", nargs="+", default=["boruvka"], choices=(*ALGORITHMS, *ALIASES))
    p.add_argument("--local_kernelization_level", nargs="+", type=int, default=[1], choices=(0, 1, 2))
    p.add_argument("--filter_threshold", nargs="+", type=float, default=[4.0])
    p.add_argument("--iterations", type=int, default=1)
    p.add_argument("--radius", type=float)
    p.add_argument("--gamma", type=float, default=3.0)
    p.add_argument("--distance_type", default="random", choices=DISTANCES, type=str.lower)
    p.add_argument("--max_edge_weight", type=int, default=MAX_WEIGHT)
    p.add_argument("--weak_scaling_level", type=int, default=0, help="adds so much to log_n and log_m")
    p.add_argument("--weak_scaling_workers", type=int, default=1, help="a power of two, by which vertices and edges are multiplied")
    p.add_argument("--threads", type=int, help="cores of an executor, where the session isn't started yet")
    p.add_argument("--compression_level", type=int, default=0, help="above 0: the graph is kept as difference-encoded blobs between iterations")
    p.add_argument("--debug_level", type=int, default=0, help="above 0: steps are written to standard error")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--infile", nargs="*", default=[])
    p.add_argument("--configfile", help="a file with the options of one run a line")
    p.add_argument("--outfile", help="folder for the results, appended as JSON")
    p.add_argument("--checks", action="store_true")
    p.add_argument("--print_input", action="store_true")
    return p


def graph(spark: SparkSession, run: dict) -> DataFrame:
    kind = run["graphtype"]
    if kind == "INFILE_WEIGHTED":
        return files.read_binary(spark, *run["infile"])
    if kind == "INFILE_UNWEIGHTED":
        return files.read_matrix_market(spark, run["infile"][0], run["seed"], run["max_edge_weight"])
    return generate(spark, kind, *sizes(run), run["radius"], run["gamma"], run["distance_type"], run["max_edge_weight"], run["seed"])


def sizes(run: dict) -> tuple[int, int]:
    """log_n and log_m of the whole graph under weak scaling, by one rule for all families."""
    workers = run["weak_scaling_workers"]
    if workers < 1 or workers & (workers - 1):
        raise ValueError("weak_scaling_workers is a power of two")
    up = run["weak_scaling_level"] + workers.bit_length() - 1
    return run["log_n"] + up, run["log_m"] + up


def runs(options: argparse.Namespace, lines: list[dict] | None = None) -> list[dict]:
    """All combinations of the grid's options; a configuration line overrides what it names."""
    base = vars(options)
    values = [base[k] if isinstance(base[k], list) else [base[k]] for k in GRID]
    out = []
    for line in lines or [{}]:
        unknown = set(line) - set(base)
        if unknown:
            raise ValueError(f"unknown options {sorted(unknown)}")
        for combination in itertools.product(*([line[k]] if k in line else v for k, v in zip(GRID, values, strict=True))):
            out.append(base | line | dict(zip(GRID, combination, strict=True)))
    return out


def measure(spark: SparkSession, run: dict) -> list[dict]:
    """One result an iteration. The graph is made once and read from a written table by all of them."""
    source = Stage(graph(spark, run), "graph")
    small = None
    if run["compression_level"]:
        small = Stage(compressed.compressed(source.df), "compressed")
        source.drop()
    edges = compressed.decompressed(small.df) if small else source.df
    if run["print_input"]:
        edges.orderBy("u", "v").show(100, truncate=False)
    totals = stats.totals(edges).collect()[0].asDict()
    out = []
    for i in range(run["iterations"]):
        log, before, begun = Log(), shuffled(spark), perf_counter()
        found = Stage(msf(edges, run["algorithm"], run["local_kernelization_level"], log, filter_threshold=run["filter_threshold"]), "forest")
        seconds = perf_counter() - begun
        sent = [n - before.get(k, 0) for k, n in shuffled(spark).items()]
        if run["debug_level"]:
            for step in log.steps:
                print(json.dumps(step), file=sys.stderr, flush=True)
        weight, size = stats.weight_sum(found.df).collect()[0]
        result = {k: run[k] for k in GRID} | {"iteration": i, "seconds": round(seconds, 3), "forest_weight": weight, "forest_edges": size, "shuffled_bytes": sum(sent), "shuffled_bytes_most": max(sent, default=0), "steps": log.steps} | {f"graph_{k}": v for k, v in totals.items()}
        if run["checks"]:
            report = check(edges, found.df)
            result["checked"] = report.fine
            if not report.fine:
                raise AssertionError(f"not a minimum spanning forest: {report}")
        out.append(result)
        found.drop()
        log.drop()
    (small or source).drop()
    return out


def main(args: list[str] | None = None) -> list[dict]:
    options = parser().parse_args(args)
    builder = SparkSession.builder.appName("weald")
    spark = (builder.config("spark.executor.cores", options.threads) if options.threads else builder).getOrCreate()
    lines = None
    if options.configfile:
        lines = files.read_configs("\n".join(r["value"] for r in spark.read.text(options.configfile).collect()))
    out = []
    for run in runs(options, lines):
        for result in measure(spark, run):
            print(json.dumps(result), flush=True)
            out.append(result)
    if options.outfile and out:
        spark.createDataFrame([(json.dumps(x),) for x in out], "value string").coalesce(1).write.mode("append").text(options.outfile)
    return out


if __name__ == "__main__":
    main()
