"""The pipeline's stages on a small table, each against what its operator's own test establishes."""

import pytest

pytest.importorskip("weald.llm")

import corpus_pipeline
from weald.llm import jaccard, lines, pii, quality

PATH = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.cache()
        docs = stage(spark, before, PATH)
        seen[name] = (before, docs)
        if name != "packing":
            assert docs.columns == columns and dict(docs.dtypes) == dict(before.dtypes)
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    a, b = seen["quality_rules"]
    model, threshold = quality.fit(spark.read.parquet(f"{PATH}/documents.parquet"), spark.read.parquet(f"{PATH}/labels.parquet"))
    assert ids(b) == ids(quality.judge_quality(a, model, threshold).where("kept")) and len(ids(b)) < len(ids(a))
    labels = spark.read.parquet(f"{PATH}/labels.parquet").where("quality = 1")
    passed = quality.judge_quality(a, model, threshold).where("not base_failed")
    good = passed.join(labels, "doc_id", "left_semi")
    assert len(set(ids(good)) & set(ids(b))) >= 0.97 * len(ids(good))
    a, b = seen["line_dedup"]
    texts = [x for r in b.collect() for x in r["text"].split("\n") if len(x) >= lines.EXACT_CHARS and x.strip()]
    assert len(texts) == len(set(texts)) and all(r["n_chars"] == len(r["text"]) for r in b.collect())
    a, b = seen["near_duplicates"]
    assert len(ids(b)) == len({r["class_id"] for r in jaccard.jaccard_join(a).collect()})
    a, b = seen["personal_data"]
    assert ids(a) == ids(b)
    import re

    assert not {m for r in a.collect() for m in re.findall(pii.PATTERNS["email"].replace("++", "+"), r["text"])} & {m for r in b.collect() for m in re.findall(pii.PATTERNS["email"].replace("++", "+"), r["text"])}
    a, b = seen["packing"]
    assert sorted({r["doc_id"] for r in b.collect()}) == ids(a)


def test_empty_table(spark):
    docs = spark.read.parquet(f"{PATH}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, PATH)
    assert docs.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, PATH).count() > 0


def test_awkward_rows_pass_every_stage(spark):
    from tests.llm.data import DOCS

    good = spark.read.parquet(f"{PATH}/documents.parquet").limit(5).collect()
    rows = [(i, t, None, "s", None) for i, t in DOCS] + [tuple(r) for r in good] * 2 + [(None, good[0]["text"], "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name, stage in corpus_pipeline.STAGES:
        if name == "quality_rules":  # all other stages see every row
            assert stage(spark, docs, PATH).count() <= len(rows)
            continue
        out = stage(spark, docs, PATH)
        assert out.count() > 0
        if name == "line_dedup":
            assert out.where("text IS NULL").count() == 1
        if name == "near_duplicates":
            assert out.where(out["text"] == good[0]["text"]).count() <= 1
            assert out.where("source = 's' AND doc_id IN (0, 1, 2, -9)").count() == 4
        if name == "personal_data":
            assert out.count() == len(rows)
