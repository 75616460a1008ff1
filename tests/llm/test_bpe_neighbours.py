"""BPE by the distinct-word shuffle against the library, nearest neighbours against brute force."""

import functools
import hashlib
import math

import numpy as np
import pytest

pytest.importorskip("weald.llm")

from pyspark.sql import functions as F

from tests.llm.data import DOCS, docs
from weald.llm import bpe, neighbours


def test_bpe_round_trip(spark, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    import tiktoken

    path = P.path("byte_bpe_multi_50k.tiktoken")
    plain = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.ranks_of(open(path, "rb").read()), special_tokens={})
    for blocks in (1 << 20, 40):
        monkeypatch.setattr(bpe, "BLOCK_BYTES", blocks)
        got = bpe.decode_ids(bpe.encode_texts(docs(spark), path, P.PATTERN), path).collect()
        expected = sorted((str(i), plain.encode_ordinary(t or ""), (t or "").encode()) for i, t in DOCS)
        assert sorted((str(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"])) for r in got) == expected
    assert bpe.encode_texts(docs(spark, []), path, P.PATTERN).count() == 0


def test_bpe_query_hashes(spark):
    r = {x["doc_id"]: x for x in __import__("weald.llm.bpe", fromlist=["x"]).op5_bpe(spark, "/root/testdata/sf0.001").collect()}
    for x in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        assert r[x["doc_id"]]["decoded_sha256"] == hashlib.sha256((x["text"] or "").encode()).hexdigest()


def brute(rows, k):
    fine = {(i, tuple(v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    rows = [(i, tuple(v)) for i, v in rows if i is not None and v and (i, tuple(v)) in fine]
    out = []
    for q in sorted({i for i, _ in rows if i % 100 == 0}):
        a = min(v for i, v in rows if i == q)
        best = sorted((math.sqrt(functools.reduce(float.__add__, ((x - y) * (x - y) for x, y in zip(a, b)))), i) for i, b in rows if i != q and len(b) == len(a))[:k]
        out += [(q, n + 1, i, d) for n, (d, i) in enumerate(best)]
    return out


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, np.round(rng.normal(size=5), 2).tolist()) for i in range(350)]
    rows += [(i, [0.5, 0.25, -1.0, 2.0, 0.0]) for i in range(390, 420)]  # ties
    rows += [(400, [0.5, 0.25, -1.0, 2.0, 0.0]), (17, rows[17][1]), (500, None), (600, []), (700, [0.0] * 5), (800, [1.0, None, 0.0, 0.0, 1.0]), (900, [float("nan")] * 5), (1000, [1.0, float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 5), (1100, [1.0, 2.0]), (1101, [1.0, 2.5]), (-100, [3.0] * 5)]
    rows += [(1200, [1e200, 0.0, 0.0]), (1201, [-1e200, 1.0, 0.0]), (1202, [5e-324, 0.0, 0.0]), (1300, [1e-320, 5e-324, 0.0]), (1204, [1.0, 0.0, 0.0]), (1205, [1e200, 0.0, 1.0])]  # beyond squares
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id bigint, embedding array<double>, score int")
    monkeypatch.setattr(neighbours, "CANDIDATE_ROWS", 64)
    monkeypatch.setattr(neighbours, "QUERY_ROWS", 16)
    got = sorted(tuple(r) for r in neighbours.search(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute(rows, 10)
    assert neighbours.search(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_bounds_hold():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(30, 64)) * 10.0 ** rng.integers(-3, 4, (30, 1)), rng.normal(size=(40, 64))
    low, high = neighbours.bounds(neighbours.quantise(a), neighbours.quantise(b))
    true = np.sqrt(((a[:, None] - b[None]) ** 2).sum(axis=2))
    assert (low <= true).all() and (true <= high).all()
