"""Toxicity by compression distance: two zstandard dictionaries, one of toxic and one of ordinary text.

A window of text that shares wording with toxic texts compresses better with the toxic dictionary. Both dictionaries
end in a part of equal size trained on their own class (for the toxic one: what stands in many more toxic than ordinary
texts; for the ordinary one: the ordinary wording next in rank) behind one common part of frequent ordinary wording.
Ordinary windows therefore compress alike with both, and a difference of a byte or two already tells.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weald.llm import trees
from weald.llm.common import labelled_sample, map_slices, table, written

#: At most so many labelled texts train the dictionaries and thresholds (least hash of the id first).
TRAIN_ROWS = 12_000
#: Bytes of a window, words of the common part, most words of a class's own part.
WINDOW, COMMON_WORDS, OWN_WORDS = 64, 2500, 2000
#: A word belongs to the toxic part if it follows on at least so many different words in toxic texts (that many, and that
#: many a toxic text), and on so many times as many as in ordinary ones. Words of one text that has many copies follow on
#: the same words in all of them.
LEAST_CONTEXTS, CONTEXTS_A_TEXT, LEAST_RATIO = 5, 0.01, 6.0
#: Byte differences at which windows are counted.
STEPS = (1, 2, 3, 4, 5)

#: Turns ASCII other than letters and digits of a lower-cased text into spaces.
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
_CUT = re.compile(rb"(?:[^ ]{%d}|.{1,%d}(?= |$)) ?" % (WINDOW, WINDOW - 1))


def windows(text: str | None) -> list[bytes]:
    """The text, lower-cased as in training, in windows of up to WINDOW bytes, cut between words where a word isn't longer itself."""
    return [b" " + w.rstrip() + b" " for w in _CUT.findall(b" ".join((text or "").lower().encode().translate(_FOLD).split()))]


class Distance:
    """Compression lengths with the ordinary dictionary less those with the toxic one."""

    def __init__(self, toxic: bytes, ordinary: bytes):
        import zstandard as z

        def of(data: bytes):
            how = z.ZstdCompressionParameters(strategy=z.STRATEGY_BTLAZY2, min_match=3, window_log=18, hash_log=16, chain_log=16, search_log=6, target_length=16, write_content_size=False, write_checksum=False, write_dict_id=False)
            return z.ZstdCompressor(dict_data=z.ZstdCompressionDict(data, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how).compress

        self.toxic, self.ordinary = of(toxic), of(ordinary)

    def __call__(self, text: str | None) -> np.ndarray:
        return np.array([len(self.ordinary(w)) - len(self.toxic(w)) for w in windows(text)], np.int64)


def features(d: np.ndarray) -> list[float]:
    """What the thresholds are calibrated on, all of it from the windows' differences; of a text without windows: zeros."""
    if not len(d):
        return [0.0] * (3 + 2 * len(STEPS))
    top = np.sort(d)[::-1]
    counts = [(d >= k).sum() for k in STEPS]
    return [float(x) for x in (top[0], top[:3].mean(), d.mean(), *np.log1p(counts), *(c / len(d) for c in counts))]


def train_dictionaries(sample: DataFrame) -> tuple[bytes, bytes]:
    """(toxic, ordinary) from a bounded sample (text, label). Only bounded lists of words come to the driver."""
    folded = F.split(F.regexp_replace(F.lower("text"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "), " ")
    texts = sample.groupBy(F.sha2("text", 256).alias("copy")).agg(F.max("label").alias("label"), F.first(folded).alias("words"))
    totals = texts.agg(F.count_if(F.col("label") == 1).alias("t"), F.count_if(F.col("label") == 0).alias("o")).collect()[0]
    follows = F.transform(F.slice("words", 2, F.greatest(F.size("words") - 1, F.lit(0))), lambda w, i: F.struct(w.alias("w"), F.get("words", i).alias("before")))
    pairs = texts.select("label", F.explode(follows).alias("p")).select("label", "p.w", "p.before").where(F.length("w").between(1, 40))
    contexts = pairs.groupBy("w", "before").agg(F.max((F.col("label") == 1).cast("int")).alias("t"), F.max((F.col("label") == 0).cast("int")).alias("o"))
    counted = written(contexts.groupBy("w").agg(F.sum("t").alias("t"), F.sum("o").alias("o")).where("t >= 3 OR o >= 3"), "toxicity-words")
    ratio = (F.col("t") / max(totals["t"], 1)) / ((F.col("o") + 0.5) / max(totals["o"], 1))
    least = max(LEAST_CONTEXTS, CONTEXTS_A_TEXT * totals["t"])
    toxic = counted.where((F.col("t") >= least) & (F.length("w") >= 4) & (ratio >= LEAST_RATIO)).orderBy(F.desc("t"), "w").limit(OWN_WORDS).collect()
    ranked = counted.where(F.col("o") >= 3).orderBy(F.desc(F.col("o") * F.log1p(F.length("w"))), "w").limit(COMMON_WORDS + OWN_WORDS).collect()
    joined = lambda rows: b" ".join(r["w"].encode() for r in reversed(rows))  # noqa: E731  the most frequent stand last, where they are cheapest
    common, own = joined(ranked[:COMMON_WORDS]), joined(toxic)
    other = joined(ranked[COMMON_WORDS:])
    other = (other or common)[-len(own) :].rjust(len(own)) if own else b""
    return b" %s %s " % (common, own), b" %s %s " % (common, other)


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, where=None) -> tuple[bytes, bytes, trees.Forest]:
    """Dictionaries and calibrated thresholds, from at most `rows` labelled texts for which `where` holds."""
    sample = written(labelled_sample(docs, labels, "toxic", rows, where), "toxicity-sample")
    toxic, ordinary = train_dictionaries(sample)

    def measure(batch: pa.RecordBatch) -> pa.RecordBatch:
        distance = Distance(toxic, ordinary)
        x = [features(distance(t)) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(x, pa.list_(pa.float64()))], ["id", "label", "x"])

    got = map_slices(sample.select(F.col("doc_id").cast("string"), "text", "label"), measure, "id string, label int, x array<double>", text=1).collect()
    got.sort(key=lambda r: (r["id"], r["x"]))
    width = len(features(np.zeros(0)))
    x, y = np.array([r["x"] for r in got], float).reshape(-1, width), np.array([r["label"] > 0 for r in got], float)
    return toxic, ordinary, trees.train(x, y, {}, trees=80)


def score_toxicity(df: DataFrame, toxic: bytes, ordinary: bytes, model: trees.Forest, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, windows, worst): for every whole text the calibrated probability, its number of windows and the
    greatest difference, in a narrow map. Null and empty texts have no windows and the score of such texts; ids may be
    null or repeat; only these two columns are read."""
    kept: list[Distance] = []

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not kept:
            kept.append(Distance(toxic, ordinary))
        d = [kept[0](t) for t in batch.column(1).to_pylist()]
        score = model.score(np.array([features(x) for x in d]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array(map(len, d), pa.int64()), pa.array([int(x.max()) if len(x) else None for x in d], pa.int64())], ["id", "score", "windows", "worst"])

    id_type = df.schema[id_col].dataType.simpleString()
    return map_slices(df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")), judge, f"id {id_type}, score double, windows bigint, worst bigint", text=1).withColumnRenamed("id", id_col)


def held_out(doc_id: str = "doc_id"):
    """Whether the row's labels are kept from training; a row without an id has none, and so is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """The contract's columns for all documents; null and empty texts get the score of a text without windows, repeated
    rows are scored each, a null id is held out."""
    docs = table(spark, sf_dir, "documents")
    found = score_toxicity(docs, *fit(docs, table(spark, sf_dir, "labels"), where=~held_out()))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
