"""A corpus pipeline: quality rules, line deduplication, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, all but the last with the columns of documents.
Documents with null ids or texts, repeated rows and empty tables pass as the stages' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weald.llm.common import table, written
from weald.llm.jaccard import one_of_each
from weald.llm.lines import without_repeated_lines
from weald.llm.packing import pack_stage
from weald.llm.pii import without_personal_data
from weald.llm.quality import keep_good

STAGES = [
    ("quality_rules", keep_good),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each),
    ("personal_data", without_personal_data),
    ("packing", pack_stage),
]

#: The trained rules, the keyed permutations and the packing are no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of documents; every stage's result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
