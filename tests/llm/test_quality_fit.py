"""Quality models come from all labelled rows."""

import numpy as np
import pytest

pytest.importorskip("weald.llm")

from pyspark.sql.functions import col as spark_col  # noqa: E402

from weald.llm import quality, trees  # noqa: E402

PATH = "/root/testdata/sf0.01"


def test_passes_grow_the_trees_of_one_array():
    rng = np.random.default_rng(3)
    x = np.round(rng.random((900, 4)), 2)
    y = (x[:, 0] + 0.4 * x[:, 1] + 0.3 * rng.random(900) > 0.8).astype(float)
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 49)[1:-1])) for j in range(4)]
    codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)
    for parts in (1, 7):
        passes = lambda *of: sum(trees.histograms(*of, codes[k::parts], y[k::parts]) for k in range(parts))  # noqa: B023, E731
        found = trees.boosted(passes, edges, 900, int(y.sum()), {0: 1}, trees=12)
        assert np.allclose(found.score(x), trees.train(x, y, {0: 1}, trees=12).score(x), atol=1e-4)


def test_every_labelled_row_counts(spark, monkeypatch):
    docs, labels = spark.read.parquet(f"{PATH}/documents.parquet"), spark.read.parquet(f"{PATH}/labels.parquet")
    seen = {}

    def boosted(passes, edges, rows, positive, monotonic, **more):
        first = passes({k: np.zeros(1, int) for k in ("feature", "cut", "left", "right", "value")}, [0], 0.0, 1, [0], max(len(e) + 1 for e in edges))
        seen.update(rows=rows, positive=positive, counted=int(first[0, 0, 2].sum()))
        return real(passes, edges, rows, positive, monotonic, trees=2)

    real = trees.boosted
    monkeypatch.setattr(trees, "boosted", boosted)
    quality.fit(docs, labels.unionByName(labels))  # repeated labels count once
    expected = labels.where("quality IS NOT NULL").join(docs.where("text IS NOT NULL"), "doc_id").select("doc_id", "quality").distinct()
    assert seen["rows"] == seen["counted"] == expected.count() and seen["positive"] == expected.where("quality > 0").count()
    copies = lambda df: df.crossJoin(spark.range(40).withColumnRenamed("id", "copy")).withColumn("doc_id", df["doc_id"] + 10_000_000 * spark_col("copy")).drop("copy")
    quality.fit(copies(docs), copies(labels))
    assert seen["rows"] == seen["counted"] == 40 * expected.count() > 6000
