"""Columns of the user's with names that operators use inside: the same rows, and the columns untouched."""

import re

import pytest

pytest.importorskip("weald.llm")

from pyspark.sql import functions as F

import corpus_pipeline
from weald.llm import jaccard, lines, pii
from weald.llm.common import positional, scanned

PATH = "/root/testdata/sf0.001"
CLASHES = ["kept", "n_removed", "n_links", "n_lines", "score", "row", "_row", "_found", "_new", "_gone", "_links", "_text", "_id", "a.b", "pii", "k", "copies", "c0", "id", "base_failed"]


@pytest.mark.parametrize("stage", [s for s in corpus_pipeline.STAGES[:-1]], ids=lambda s: s[0])
def test_stages_leave_columns_of_any_name(spark, stage):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").where("doc_id < 60 or doc_id % 3 = 0")
    mine = docs.select("*", *(F.concat(F.lit(f"{c}:"), F.col("doc_id").cast("string")).alias(c) for c in CLASHES))
    plain, got = stage[1](spark, docs, PATH), stage[1](spark, mine, PATH)
    assert got.columns == mine.columns
    rows = [tuple(r) for r in got.collect()]
    assert sorted(r[: len(docs.columns)] for r in rows) == sorted(tuple(r) for r in plain.collect())
    assert all(r[len(docs.columns) :] == tuple(f"{c}:{r[0]}" for c in CLASHES) for r in rows)
    assert not any(re.search(r"\w@\w+\.\w", str(v)) for r in rows for v in r[len(docs.columns) :])


def test_verdicts_of_the_user_are_not_the_operators(spark):
    rows = [(1, "the same line of some length, twice in here\nand another", False, 0), (2, "the same line of some length, twice in here", True, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, kept boolean, n_removed int")
    assert [r[0] for r in lines.without_repeated_lines(spark, docs, PATH).collect()] == [1]
    assert sorted(r[0] for r in jaccard.one_of_each(spark, docs, PATH).collect()) == [1, 2]
    found = pii.pseudonymise(spark.createDataFrame([("me@example.org", "x", "y")], "text string, _found string, _new string"), "k").collect()[0]
    assert (found["_found"], found["_new"]) == ("x", "y") and found["text"] != "me@example.org"


def test_only_scans_count_as_stable(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    assert scanned(docs) and scanned(positional(docs.where("doc_id > 3")))
    for other in (docs.repartition(3), docs.orderBy("text"), docs.limit(5), docs.withColumn("r", F.rand()), docs.union(docs), docs.distinct()):
        assert not scanned(other)
