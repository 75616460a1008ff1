"""Awkward rows that every operator over texts has to take."""

import pytest

pytest.importorskip("weald.llm")

LONG = "word " * 30_000 + "MIT License\n" * 500

DOCS = [
    (0, None), (1, ""), (2, " \n\t "), (3, "Released under the MIT License.\nA b c."), (4, "Released under the MIT License.\nA b c."), (4, "Released under the MIT License.\nA b c."),
    (None, "no id here, CC BY 4.0"), (5, LONG), (6, "naïve Ünïcode ΣΑΣ   x\x1cy z <|endoftext|> 𝔘𝔫𝔦"), (7, "don't  stop\n\n  it's 12345 ¿qué?   "), (8, "a a a a b b b a a a"), (-9, "\n\n\n"),
]


def docs(spark, rows=DOCS):
    """doc_id, text and columns whose names clash with what operators use inside."""
    return spark.createDataFrame([(a, b, "x", 1, "y") for a, b in rows], "doc_id bigint, text string, id string, n_words int, label string")
