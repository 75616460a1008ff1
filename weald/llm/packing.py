"""Packing documents into token sequences by Karmarkar-Karp multiway differencing."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weald.llm.common import slices, table, tidy

#: Tokens of a sequence, windows of a differencing group, and the id that ends a document.
CAPACITY, GROUP_WINDOWS, END_ID = 2048, 128, 1
#: Pieces of text that a worker remembers the ids of, at most; and the text bytes it looks at together.
CACHE_ENTRIES, TOGETHER_BYTES = 200_000, 2 << 20

#: ASCII punctuation, which a pre-token never shares with the letters and digits below.
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = pa.array(list("0123456789abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"))


#: Words that are one pre-token whatever stands around them, and that no normalisation changes.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")
_END = b"\xff"  # in no UTF-8 text: stands for the end of a word


def byte_symbols() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def rank_table(definition: str) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """(ranks, ids, sure) of a BPE definition with word ends, for merging by the rank of the joined bytes.

    A word is its bytes and _END, which its last byte takes up first. Merging by joined bytes can join parts that are no
    pair of the definition. A token is `sure` if its own derivation takes pairs of the definition only; as what is
    merged inside a token of the result is what its derivation merges, a result of sure tokens is the definition's.
    """
    model = json.loads(definition)["model"]
    symbols = byte_symbols()
    raw = lambda t: bytes(symbols[c] for c in t.removesuffix("</w>")) + (_END if t.endswith("</w>") else b"")
    ranks = {bytes([b]) + _END: b for b in range(255)} | {bytes([b]): 256 + b for b in range(256)}
    pairs: set[tuple[bytes, bytes]] = {(bytes([b]), _END) for b in range(255)}
    for m in model["merges"]:
        x, y = map(raw, m.split(" ") if isinstance(m, str) else m)
        pairs.add((x, y))
        ranks.setdefault(x + y, 512 + len(ranks))
    size = max(ranks.values()) + 1
    ids, sure = np.zeros(size, np.uint32), np.zeros(size, bool)
    known = {raw(t): i for t, i in model["vocab"].items() if not t.startswith("<|")}
    for token, rank in ranks.items():
        if token not in known:
            continue
        ids[rank] = known[token]
        parts, fine = [token[i : i + 1] for i in range(len(token))], True
        while len(parts) > 1 and fine:
            best = min(range(len(parts) - 1), key=lambda i: (ranks.get(parts[i] + parts[i + 1], size), i))
            fine = (parts[best], parts[best + 1]) in pairs
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        sure[rank] = fine
    return ranks, ids, sure


class CachedTokenizer:
    """Ids of texts by a tokenizer that drops white space and lower-cases: pieces are encoded once and remembered.

    Texts are cut at ASCII white space, which no pre-token holds and no normalisation looks across; then, behind a
    letter or digit, at trailing ASCII punctuation, where pre-tokens end as well. The ids of a text are those of its
    pieces in a row. Cutting and finding the distinct pieces is Arrow's work. Plain words are merged by rank where that
    is known to be the same (rank_table); all other pieces go through the tokenizer itself.
    """

    def __init__(self, definition: str, table: tuple[dict[bytes, int], np.ndarray, np.ndarray]):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True  # such strings in a text are ordinary text
        ranks, self.rank_ids, self.rank_sure = table
        self.merge = tiktoken.Encoding("ranks", pat_str=".", mergeable_ranks=ranks, special_tokens={})._encode_single_piece
        self.clear()

    def clear(self) -> None:
        self.pieces: dict[str, int] = {"": 0}
        self.new: list[str] = []
        self.flat, self.used = np.empty(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(1, np.int64), np.zeros(1, np.int64)

    def _numbers(self, pieces: pa.Array) -> np.ndarray:
        coded = pieces.dictionary_encode()
        get, numbers = self.pieces.get, []
        for piece in coded.dictionary.to_pylist():
            if (n := get(piece)) is None:
                n = self.pieces[piece] = len(self.pieces)
                self.new.append(piece)
            numbers.append(n)
        return np.array(numbers, np.int64)[coded.indices.to_numpy()]

    def _encode(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, length of each)."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum())), length

    def _learn(self) -> None:
        new, self.new = self.new, []
        if not new:
            return
        plain = np.fromiter((_PLAIN.fullmatch(x) is not None for x in new), bool, len(new))
        at = np.flatnonzero(plain)
        merged = [self.merge(new[i].encode() + _END) for i in at.tolist()]
        length = np.fromiter(map(len, merged), np.int64, len(merged))
        ranks = np.fromiter(chain.from_iterable(merged), np.int64, int(length.sum()))
        begin = np.cumsum(length) - length
        sure = np.logical_and.reduceat(self.rank_sure[ranks], begin) if len(at) else np.empty(0, bool)
        plain[at[~sure]] = False
        rest = np.flatnonzero(~plain)
        other, other_length = self._encode([new[i] for i in rest.tolist()])
        flat = np.concatenate([self.rank_ids[ranks], other])
        start, size = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        start[at], size[at] = begin, length
        start[rest], size[rest] = len(ranks) + np.cumsum(other_length) - other_length, other_length
        if self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat[: self.used], np.empty(max(len(self.flat), len(flat)), np.uint32)])
        self.flat[self.used : self.used + len(flat)] = flat
        self.start, self.length = np.concatenate([self.start, self.used + start]), np.concatenate([self.length, size])
        self.used += len(flat)

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, null like empty."""
        if len(self.pieces) > CACHE_ENTRIES:
            self.clear()
        pieces = pc.ascii_split_whitespace(texts.fill_null(""))
        coded = pieces.flatten().dictionary_encode()
        low = pc.ascii_lower(coded.dictionary)
        core = pc.utf8_rtrim(low, _PUNCTUATION)
        cut = pc.and_(pc.not_equal(pc.binary_length(low), pc.binary_length(core)), pc.is_in(pc.utf8_slice_codeunits(core, -1), _LETTERS))
        tails = [piece[len(x) :] for piece, x in zip(low.filter(cut).to_pylist(), core.filter(cut).to_pylist(), strict=True)]
        parts = np.zeros((len(low), 2), np.int64)
        parts[:, 0] = self._numbers(pc.if_else(cut, core, low))
        parts[cut.to_numpy(zero_copy_only=False), 1] = self._numbers(pa.array(tails, pa.string()))
        self._learn()
        at = parts[coded.indices.to_numpy()].ravel()
        length = self.length[at]
        ends = np.concatenate([[0], np.cumsum(length)])
        flat = self.flat[np.repeat(self.start[at] - ends[:-1], length) + np.arange(ends[-1])]
        bounds = ends[2 * np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy())])]
        return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


def differencing(sizes: list[int], windows: int) -> list[list[int]]:
    """Items (indexes into sizes) of each of `windows` sets with nearly equal sums, by Karmarkar-Karp differencing.

    Each item begins as a partial partition with one filled set. The two partial partitions with the widest imbalance
    are merged, the fullest sets of one with the emptiest of the other, until one partition is left.
    """
    if windows == 1 or not sizes:
        return [list(range(len(sizes))), *([] for _ in range(windows - 1))]
    joined: list[tuple[int, int]] = []  # node len(sizes) + i holds these two nodes
    heap = []
    for i, size in enumerate(sizes):
        sums, nodes = np.zeros(windows, np.int64), np.full(windows, -1, np.int64)
        sums[0], nodes[0] = size, i
        heap.append((-size, i, sums, nodes))
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a, na = heapq.heappop(heap)
        _, _, b, nb = heapq.heappop(heap)
        sums, other = a + b[::-1], nb[::-1]  # both are in falling order
        nodes = np.where(na < 0, other, na)
        for k in np.flatnonzero((na >= 0) & (other >= 0)):
            nodes[k] = len(sizes) + len(joined)
            joined.append((int(na[k]), int(other[k])))
        order = np.argsort(-sums, kind="stable")
        sums, nodes = sums[order], nodes[order]
        heapq.heappush(heap, (int(sums[-1] - sums[0]), turn, sums, nodes))
        turn += 1
    out = []
    for node in heap[0][3]:
        items, stack = [], [int(node)]
        while stack:
            x = stack.pop()
            if x >= len(sizes):
                stack.extend(joined[x - len(sizes)])
            elif x >= 0:
                items.append(x)
        out.append(sorted(items))
    return out


def pack_lengths(lengths: list[int], capacity: int = CAPACITY) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length); every token of every item lies in exactly one piece, none exceeds capacity.

    Whole capacities are cut from longer items first; nothing else is cut. Of what is left, neighbours that are shorter than
    a SMALL-th of the capacity are joined as far as they stay below it together, and stay together, so that there are fewer
    than 2 * SMALL partial partitions a window, however short items are. These are differenced into the least number of
    windows that could hold them, and the number rises as long as a window exceeds the capacity. (With a window for each
    all fit, so that ends; ones of more than half a capacity need a window each from the start.)
    """
    out, items = [], []
    for i, n in enumerate(lengths):
        whole = n // capacity
        out += [[(i, k * capacity, capacity)] for k in range(whole)]
        if n % capacity:
            items.append((i, whole * capacity, n % capacity))
    joined: list[list[tuple[int, int, int]]] = []
    sizes: list[int] = []
    last = -1  # where short items go at present
    for one in items:
        if one[2] * SMALL >= capacity:
            joined.append([one])
            sizes.append(one[2])
        elif last >= 0 and (sizes[last] + one[2]) * SMALL < capacity:
            joined[last].append(one)
            sizes[last] += one[2]
        else:
            last = len(sizes)
            joined.append([one])
            sizes.append(one[2])
    windows = max(-(-sum(sizes) // capacity), sum(2 * n > capacity for n in sizes))
    while items:
        sets = differencing(sizes, windows)
        over = sum(max(0, sum(sizes[j] for j in x) - capacity) for x in sets)
        if not over:
            return out + [[piece for j in x for piece in joined[j]] for x in sets if x]
        windows += max(1, over // (4 * capacity))
    return out


#: Items shorter than this part of a capacity are joined before they are differenced.
SMALL = 32

PIECES = "start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset): the pieces of every document, each id in exactly one.

    A document's ids are the tokenizer's and END_ID; `ids` are a piece's, little-endian unsigned 32-bit. Documents are
    packed with their neighbours of the same partition, GROUP_WINDOWS windows at a time: no shuffle, and memory is
    bounded by a group and the longest document. sequence_id is the partition's number above a counter, so it is the
    same if a lost partition is packed again. A null or empty text is the single id END_ID; repeated and null document
    ids are packed as rows of their own; further columns are not read. An empty table gives no rows.
    """
    with open(vocabulary, encoding="utf-8") as f:
        text = f.read()
    given = df.sparkSession.sparkContext.broadcast((text, rank_table(text)))  # a vocabulary: a few MB, whatever the corpus
    id_type = df.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = CachedTokenizer(*given.value)
        sequence = TaskContext.get().partitionId() << 33
        kind = None
        names, docs, held = [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            rows = []
            for pieces in pack_lengths([len(x) for x in docs], capacity):
                offset = 0
                for i, start, n in pieces:
                    rows.append((names[i], start, n, docs[i][start : start + n].tobytes(), len(docs[i]), sequence, offset))
                    offset += n
                sequence += 1
            columns = list(zip(*rows, strict=True))
            kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for batch in batches:
            kind = batch.column(0).type
            for part in slices(batch, 1, TOGETHER_BYTES, batch.num_rows):
                for name, ids in zip(part.column(0).to_pylist(), tokenizer.ids(part.column(1)), strict=True):
                    names.append(name)
                    docs.append(np.append(ids, np.uint32(END_ID)).astype("<u4"))
                    held += len(docs[-1])
                    if held >= capacity * GROUP_WINDOWS:
                        yield flush()
                        names, docs, held = [], [], 0
        if docs:
            yield flush()

    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(pack), f"id {id_type}, {PIECES}").withColumnRenamed("id", id_col)


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns, derived from the pieces' ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """The contract's digest of all documents' pieces; null and empty texts are the end id alone, repeated rows pieces of their own."""
    import public_tokenizers

    return digest(pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


def pack_stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents' pieces, with their ids. Nulls, empty texts and repeated rows as pack_documents has them."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))
