"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Texts are cut into blocks of some 6 MB. In each block every pre-token gets a number in order of first appearance and
the texts become rows of those numbers (the positions). The distinct pre-tokens of all blocks are shuffled by their
hash, so that equal ones meet: each is encoded once there. Their ids go back to the blocks that asked, where the texts
are put together again by position. Words, numbers and ids travel in compressed packs, one per block and bucket,
instead of a row each.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weald.llm.common import map_slices, slices, table, written

#: Characters of a block, unless a single text is longer; bounds what a task holds.
BLOCK_BYTES = 6 << 20
#: Distinct pre-tokens whose ids an encoding task remembers, at most; then it starts anew.
CACHE_ENTRIES = 400_000


def squeeze(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers, compressed by byte planes."""
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x, "<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unsqueeze(data: bytes) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(flat.reshape(4, -1).T).view("<u4").ravel()


def spread(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Indexes of the runs [start, start + length) in a row."""
    length = length.astype(np.int64)
    ends = np.cumsum(length)
    return np.repeat(start - ends + length, length) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def ranks_of(data: bytes) -> dict[bytes, int]:
    """The ranks of a .tiktoken file's content."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def splitter(pattern: str):
    """The pattern's findall, with white space as the Unicode property has it."""
    import regex

    return regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall


class Blocks:
    """The rows of one partition in blocks. Where a block ends depends on the rows' order only, not on Arrow's batches."""

    def __init__(self, pattern: str):
        self.split = splitter(pattern)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Array | None, list[np.ndarray], _Numbers]]:
        """Block's number, row ids, the pre-tokens' numbers of each text, and the numbering."""
        block = TaskContext.get().partitionId() << 28
        ids: list = []
        rows: list[np.ndarray] = []
        numbers, size = _Numbers(), 0
        for batch in batches:
            for part in slices(batch, 1):
                ids += part.column(0).to_pylist()
                for text in part.column(1).to_pylist():
                    words = self.split(text or "")
                    rows.append(np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words)))
                    size += len(text or "")
                    if size >= BLOCK_BYTES:
                        at, rest = len(rows), ids[len(rows) :]
                        yield block, pa.array(ids[:at], batch.column(0).type), rows, numbers
                        block += 1
                        ids, rows, numbers, size = rest, [], _Numbers(), 0
        if rows:
            yield block, pa.array(ids, batch.column(0).type), rows, numbers


def encode_texts(df: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", stable: bool = False) -> DataFrame:
    """(id, ids): every whole text's token ids, little-endian unsigned 32-bit, one row per input row.

    The pattern's matches are encoded separately by the ranks in the file `vocabulary`, without special tokens. Null and
    empty texts have no ids (an empty binary). Ids of rows may be null or repeat; other columns are not read.
    `stable`: df's rows come in the same partitions and order whenever it is computed, as a table scan's do; else df is
    first written to the shared folder, because it is passed over twice. Skew: a block holds at most BLOCK_BYTES and a
    longest text; a frequent word reaches its bucket once per block, in packs spread over all buckets alike.
    """
    spark = df.sparkSession
    id_type = df.schema[id_col].dataType.simpleString()
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if not stable:
        texts = written(texts, "bpe-texts")
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())  # a vocabulary: about 1 MB, whatever the corpus
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = 2 * partitions

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        press = zstandard.ZstdCompressor(level=3)
        for block, _, _, numbers in Blocks(pattern)(batches):
            own = [w.encode() for w in numbers]
            goes = np.fromiter((zlib.crc32(w) % buckets for w in own), np.int64, len(own))
            order = np.argsort(goes, kind="stable")
            cuts = np.flatnonzero(np.diff(goes[order], prepend=-1))
            rows = []
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                at = order[a:b]
                mine = [own[i] for i in at]
                rows.append((int(goes[at[0]]), block, squeeze(np.diff(at, prepend=0)), squeeze(np.fromiter(map(len, mine), np.uint32, len(mine))), press.compress(b"".join(mine))))
            if rows:
                bucket, of, at, length, data = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(of, pa.int64()), *(pa.array(x, pa.binary()) for x in (at, length, data))], ["bucket", "block", "at", "length", "data"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        import zstandard

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks_of(ranks.value), special_tokens={})
        piece = encoding._encode_single_piece
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            for block, at, length, data in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True):
                sizes, text = unsqueeze(length), zstandard.ZstdDecompressor().decompress(data)
                if len(known) > CACHE_ENTRIES:
                    known = {}
                found, begin = [], 0
                for end in np.cumsum(sizes).tolist():
                    word = text[begin:end]
                    if (ids := known.get(word)) is None:
                        ids = known[word] = piece(word)
                    found.append(ids)
                    begin = end
                counts = np.fromiter(map(len, found), np.uint32, len(found))
                flat = np.fromiter((i for x in found for i in x), np.uint32, int(counts.sum()))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in (at, squeeze(counts), squeeze(flat)))], ["block", "at", "counts", "flat"])

    row_ids = f"ids array<{id_type}>"

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, ids, rows, _ in Blocks(pattern)(batches):
            lengths = squeeze(np.fromiter(map(len, rows), np.uint32, len(rows)))
            data = squeeze(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.ListArray.from_arrays([0, len(ids)], ids), pa.array([lengths], pa.binary()), pa.array([data], pa.binary())], ["block", "ids", "lengths", "data"])

    def assemble(texts: pa.Table, packs: pa.Table) -> pa.Table:
        at = [np.cumsum(unsqueeze(x).astype(np.int64)) for x in packs["at"].to_pylist()]
        counts = [unsqueeze(x) for x in packs["counts"].to_pylist()]
        flat = [unsqueeze(x) for x in packs["flat"].to_pylist()]
        n = sum(map(len, at))
        length, start = np.zeros(n, np.int64), np.zeros(n, np.int64)
        base = 0
        for a, c, f in zip(at, counts, flat, strict=True):
            length[a] = c
            start[a] = base + np.cumsum(c.astype(np.int64)) - c
            base += len(f)
        tokens = np.concatenate(flat) if flat else np.empty(0, "<u4")
        out_ids, out = [], []
        for ids, lengths, data in zip(texts["ids"].to_pylist(), texts["lengths"].to_pylist(), texts["data"].to_pylist(), strict=True):
            numbers, begin = unsqueeze(data), 0
            for end in np.cumsum(unsqueeze(lengths).astype(np.int64)).tolist():
                own = numbers[begin:end]
                out.append(tokens[spread(start[own], length[own])].astype("<u4").tobytes())
                begin = end
            out_ids += ids
        return pa.table([pa.array(out_ids, texts.schema.field("ids").type.value_type), pa.array(out, pa.binary())], names=["id", "ids"])

    packs = texts.mapInArrow(words, "bucket int, block bigint, at binary, length binary, data binary")
    packs = packs.repartition(partitions, "bucket").mapInArrow(encode, "block bigint, at binary, counts binary, flat binary")
    rows = texts.mapInArrow(numbered, f"block bigint, {row_ids}, lengths binary, data binary")
    return rows.groupBy("block").cogroup(packs.groupBy("block")).applyInArrow(assemble, f"id {id_type}, ids binary").withColumnRenamed("id", id_col)


def decode_ids(df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """df's rows with the bytes that their ids (little-endian unsigned 32-bit) stand for, from the token-byte table.

    The table is bounded by the vocabulary and held in every task. Null ids give null; an id outside it is an error.
    """
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    names = [c for c in df.columns if c != out_col]
    at = names.index(ids_col)
    schema = ", ".join([*(f"c{i} {df.schema[c].dataType.simpleString()}" for i, c in enumerate(names)), f"c{len(names)} binary"])
    tables: dict = {}

    def decode(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not tables:
            by_id = sorted((i, b) for b, i in ranks_of(ranks.value).items())
            length = np.zeros(by_id[-1][0] + 1, np.int64)
            length[[i for i, _ in by_id]] = [len(b) for _, b in by_id]
            tables.update(data=np.frombuffer(b"".join(b for _, b in by_id), np.uint8), length=length, start=np.cumsum(length) - length)
        out = []
        for x in batch.column(at).to_pylist():
            if x is None:
                out.append(None)
                continue
            ids = np.frombuffer(x, "<u4")
            if len(ids) and (ids.max() >= len(tables["length"]) or not tables["length"][ids].all()):
                raise ValueError("an id is not in the vocabulary")
            out.append(tables["data"][spread(tables["start"][ids], tables["length"][ids])].tobytes())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [f"c{i}" for i in range(len(names) + 1)])

    return map_slices(df.select(*names), decode, schema, text=at).toDF(*names, out_col)


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    """Number and hashes of every whole text's ids and of what they decode to; a null or empty text has none, repeated rows a row each."""
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    ids = encode_texts(table(spark, sf_dir, "documents"), path, P.PATTERN, stable=True)
    out = decode_ids(ids, path)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
