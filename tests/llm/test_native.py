"""The operators that are to run without Python do; narrow ones shuffle nothing."""

import pytest

pytest.importorskip("weald.llm")

from tests.llm.data import docs
from weald.llm import licenses, lines, packing, pii


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_in_native_operators(spark):
    found = plan(pii.pseudonymise(docs(spark), "k"))
    assert "Exchange" not in found and not any(x in found for x in ("Arrow", "Pandas", "Python"))
    texts = docs(spark).selectExpr("monotonically_increasing_id() AS row", "doc_id AS id", "text")
    for df in (lines.keyed(lines.occurrences(texts)), lines.similar_lines(lines.occurrences(texts).select("h", "line"))):
        assert not any(x in plan(df) for x in ("InArrow", "Pandas", "Python"))


def test_narrow_operators_shuffle_nothing(spark):
    P = pytest.importorskip("public_tokenizers")
    for df in (licenses.scan_licenses(docs(spark)), packing.pack_documents(docs(spark), P.path("word_bpe_49k.json"))):
        assert "Exchange" not in plan(df)
