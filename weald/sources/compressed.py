"""Edge tables as difference-encoded blobs: for interchange, and to hold a pristine copy in little room."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weald.functions import varint


def compressed(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(edges, data): one blob for each Arrow batch of edges sorted within ranges of u. Ids and weights are non-negative."""
    dealt = edges.repartitionByRange(parts, "u") if parts else edges.repartitionByRange("u")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data = varint.encode_edges(*(b.column(c).to_numpy() for c in ("u", "v", "weight")))
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([data], pa.binary())], ["edges", "data"])

    return dealt.select("u", "v", "weight").sortWithinPartitions("u", "v", "weight").mapInArrow(encode, "edges bigint, data binary")


def decompressed(blobs: DataFrame) -> DataFrame:
    """(u, v, weight) of compressed()."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x)) for x in varint.decode_edges(data)], ["u", "v", "weight"])

    return blobs.select("data").mapInArrow(decode, "u bigint, v bigint, weight bigint")
