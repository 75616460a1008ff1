"""Quality rules: gradient-boosted trees over document statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weald.llm import trees
from weald.llm.common import forget, map_slices, named, positional, table, tidy, written

#: Bins of a statistic, and rows that a training pass looks at together.
BINS, TOGETHER = 48, 4096
#: The share of the good training texts that the model's threshold must keep.
KEEP_GOOD = 0.998
#: Statistics the model sees, in order, and the direction in which quality may move as they grow.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "upper_share": 0,
    "digit_share": 0,
    "shouts_per_word": -1,
    "bars_per_word": -1,
    "log_words_per_line": 0,
    "distinct_share": 0,
    "stops_per_word": 0,
}
_SPACE, _SYMBOLS, _UPPER, _DIGITS = b" \t\n\r\x0b\x0c", b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58))


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more in the text, the first occurrence included."""
    if len(words) < 4:
        return 0
    seen = _Ids()
    ids = np.fromiter(map(seen.__getitem__, words), np.int64, len(words))
    v = len(seen)
    if v == len(words):
        return 0
    if v < 1 << 20:
        key = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # pairs are numbered first, so that the key stays within 64 bits
        pair = np.unique(ids[:-2] * v + ids[1:-1], return_inverse=True)[1]
        key = pair * v + ids[2:]
    order = np.argsort(key, kind="stable")
    same = np.diff(key[order]) == 0
    again = np.zeros(len(key), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= again
    return int(covered.sum())


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], tuple[float, ...]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and FEATURES of a whole text; null: the empty text."""
    text = text or ""
    data = text.encode()
    words = data.split()  # exactly the runs of bytes other than ASCII white space
    n = len(words)
    count = lambda chars: len(data) - len(data.translate(None, chars))
    symbols = count(_SYMBOLS)
    lines = [x for x in data.split(b"\n") if x and not x.isspace()]
    dup, rep = len(lines) - len(set(lines)), repeated_words(words)
    chars = len(text) - count(_SPACE)
    per = max(n, 1)
    features = (
        np.log1p(n), chars / per, symbols / per, dup / max(len(lines), 1), rep / per, count(_UPPER) / max(chars, 1), count(_DIGITS) / max(chars, 1),
        data.count(b"!") / per, data.count(b"|") / per, np.log1p(n / max(len(lines), 1)), len(set(words)) / per, data.count(b".") / per,
    )
    return (n, chars, symbols, dup, rep), features


def labelled_statistics(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(x, y): FEATURES and label of every labelled text. Texts are measured where they are; only their statistics are shuffled.

    Rows whose id, label or text is null take no part. If an id has several labels, its greatest counts; if it has several
    texts, the least by hash.
    """
    chosen = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [list(statistics(t)[1]) for t in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.float64()))], ["doc_id", "k", "x"])

    texts = docs.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.xxhash64("text").alias("k"), "text")
    measured = map_slices(texts, measure, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, k bigint, x array<double>", text=2)
    one = measured.join(chosen, "doc_id").groupBy("doc_id", "label").agg(F.min(F.struct("k", "x")).alias("t"))
    return one.select("t.x", (F.col("label") > 0).alias("y"))


def fit(docs: DataFrame, labels: DataFrame, keep: float = KEEP_GOOD) -> tuple[trees.Forest, float]:
    """The model and its threshold, from all labelled rows. They stay in their partitions: a level of a tree takes one pass, of
    which only histograms come to the driver.

    The threshold is the largest one up to 0.5 that keeps `keep` of the good texts. Without labels: keep all.
    """
    rows = written(labelled_statistics(docs, labels), "quality-statistics")
    m, shares = len(FEATURES), np.linspace(0, 1, BINS + 1)[1:-1].tolist()
    cuts = [F.percentile_approx(F.get("x", F.lit(j)), shares, 10_000).alias(f"q{j}") for j in range(m)]
    n, good, *bounds = rows.agg(F.count("*"), F.count_if("y"), *cuts).collect()[0]
    edges = [np.unique(np.array(b or [], float)) for b in bounds]

    def code(batches):
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), float).reshape(-1, m)
            codes = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], ["codes", "y"])

    coded = written(rows.mapInArrow(code, "codes binary, y boolean"), "quality-codes")

    def passes(*of) -> np.ndarray:
        def run(batches):
            total = None
            for batch in batches:
                for at in range(0, batch.num_rows, TOGETHER):
                    part = batch.slice(at, TOGETHER)
                    codes = np.frombuffer(b"".join(part.column(0).to_pylist()), np.uint8).reshape(-1, m)
                    sums = trees.histograms(*of, codes, part.column(1).to_numpy(zero_copy_only=False).astype(float))
                    total = sums if total is None else total + sums
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

        found = coded.mapInArrow(run, "sums binary").collect()
        return sum(np.frombuffer(r[0], np.int64) for r in found).reshape(len(of[4]), m, 3, of[5])

    model = trees.boosted(passes, edges, n, good, {i: d for i, d in enumerate(FEATURES.values()) if d})
    threshold = 0.0
    if 0 < good < n:
        # the least good scores, a share 1 - keep of them, of which the last two meet at the quantile
        place = (good - 1) * (1 - keep)

        def score(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(model.score(np.array(batch.column(0).to_pylist(), float).reshape(-1, m)))], ["score"])

        low = [r[0] for r in rows.where("y").select("x").mapInArrow(tidy(score), "score double").orderBy("score").limit(int(place) + 2).collect()]
        threshold = min(0.5, low[int(place)] + (place - int(place)) * (low[-1] - low[int(place)]))
    for old in (rows, coded):
        forget(old)
    return model, float(threshold)


def judge_quality(df: DataFrame, model: trees.Forest, threshold: float, id_col: str = "doc_id", text_col: str = "text", columns: list[str] | None = None) -> DataFrame:
    """Statistics, score and verdict of every whole text, in a narrow map: one row per input row.

    base_failed: fewer than 50 words, or more than half of the words in repeated 3-word windows. kept: not base_failed
    and score >= threshold. Null and empty texts have no words and so fail. `columns`: input columns to carry along
    (all of them under their own names); others, whatever their names, are not read.
    """
    carried = [id_col] if columns is None else columns

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        counts, features = zip(*map(statistics, batch.column(0).to_pylist()), strict=True)
        counts, x = np.array(counts, np.int64), np.array(features)
        failed = (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])
        score = model.score(x)
        own = [pa.array(counts[:, i]) for i in range(5)] + [pa.array(failed), pa.array(score), pa.array(~failed & (score >= threshold))]
        return pa.RecordBatch.from_arrays([*batch.columns[1:], *own], [f"c{i}" for i in range(len(carried) + 8)])

    given = ", ".join(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(carried))
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]
    kinds = ["bigint"] * 5 + ["boolean", "double", "boolean"]
    schema = ", ".join([given, *(f"c{len(carried) + i} {k}" for i, k in enumerate(kinds))])
    out = map_slices(df.select(F.col(f"`{text_col}`").cast("string").alias("_text"), *(F.col(f"`{c}`") for c in carried)), judge, schema, text=0)
    return out.toDF(*carried, *(f"quality.{c}" if c in carried else c for c in own))


def op4_quality(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents, a row each: a null or empty text has no words and fails; repeated rows are judged alike."""
    docs = table(spark, sf_dir, "documents")
    model, threshold = fit(docs, table(spark, sf_dir, "labels"))
    found = judge_quality(docs, model, threshold)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the quality rules keep, with their own columns. Null and empty texts go, as they
    have no words; repeated rows are kept or go together."""
    model, threshold = fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    plain = positional(docs)
    found = judge_quality(plain, model, threshold, text_col=named(docs, "text"), columns=plain.columns)
    return found.where("kept").select(*plain.columns).toDF(*docs.columns)
