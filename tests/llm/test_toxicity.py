"""Compression-distance toxicity: held-out accuracy and awkward texts."""

import pytest

pytest.importorskip("weald.llm")

from tests.llm.data import DOCS, docs
from weald.llm import toxicity


def test_held_out_accuracy(spark):
    """Trained on four fifths of the labels, it ranks toxic texts of the rest above ordinary ones."""
    path = "/root/testdata/sf0.1"
    got = toxicity.op3_toxicity(spark, path).where("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").select("score", "toxic").collect()
    good, bad = [r["score"] for r in got if r["toxic"] == 0], [r["score"] for r in got if r["toxic"] == 1]
    pairs = sum((b > g) + 0.5 * (b == g) for b in bad for g in good)
    assert pairs / (len(good) * len(bad)) > 0.95
    assert sum(g >= 0.5 for g in good) / len(good) < 0.02
    assert sum(b >= 0.5 for b in bad) / len(bad) > 0.7


def test_awkward_texts_and_no_labels(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    found = toxicity.score_toxicity(docs(spark), *toxicity.fit(docs(spark), labels)).collect()
    assert len(found) == len(DOCS) and all(0 <= r["score"] <= 1 for r in found)
    assert {r["windows"] for r in found if r["doc_id"] in (0, 1, 2)} == {0}
    assert toxicity.score_toxicity(docs(spark, []), *toxicity.fit(docs(spark, []), labels)).count() == 0


def test_scores_follow_a_plain_loop_over_windows(spark):
    """Differences of compressed lengths, counted window by window, and the nodes of the trees walked one by one."""
    import numpy as np

    from weald.llm import trees

    toxic, ordinary = b" vile nasty wretch rotten scoundrel " * 3, b" calm table window garden morning " * 3
    rng = np.random.default_rng(0)
    x = rng.random((300, len(toxicity.features(np.zeros(0))))) * 5
    model = trees.train(x, (x[:, 0] > 2).astype(float), {i: 1 for i in range(x.shape[1])}, trees=10)
    rows = [(1, "a vile wretch, the garden. " * 9), (2, "calm morning by the window"), (3, None), (4, "É vile é")]
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs(spark, rows), toxic, ordinary, model).collect()}
    distance = toxicity.Distance(toxic, ordinary)
    for i, text in rows:
        d = [len(distance.ordinary(w)) - len(distance.toxic(w)) for w in toxicity.windows(text)]
        assert got[i]["windows"] == len(d) and got[i]["worst"] == (max(d) if d else None)
        row, margin = toxicity.features(np.array(d, np.int64)), model.bias
        for at in model.roots:
            while model.left[at] != at:
                at = model.left[at] if row[model.feature[at]] <= model.threshold[at] else model.right[at]
            margin += model.value[at]
        assert abs(got[i]["score"] - 1 / (1 + np.exp(-margin))) < 1e-9
    assert toxicity.windows("É VILE") == toxicity.windows("é vile")


def test_held_out_is_never_null(spark):
    assert [r[0] for r in spark.createDataFrame([(None,), (5,)], "doc_id bigint").select(toxicity.held_out()).collect()][0] is True


def test_windows_keep_every_word():
    text = "Aa bb-cc " * 40 + "x" * 200 + " ñandú"
    assert b"".join(b" ".join(toxicity.windows(text)).split()) == b"".join(text.lower().replace("-", " ").encode().split())
    assert max(map(len, toxicity.windows(text))) <= toxicity.WINDOW + 2
