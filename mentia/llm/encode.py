"""Problem 8: a corpus encoded with a public byte-level tokenizer.

A text is cut into pieces by the tokenizer's pattern and each piece is merged by rank. The ranks of a
piece's adjacent pairs are the leaves of a segment tree whose root holds the leftmost lowest rank: a
merge reads the root and updates at most three leaves, each in logarithmic time, until no pair of the
piece can be merged. Pieces repeat, so each Python worker remembers a bounded number of them.
"""

from __future__ import annotations

import base64
import os
from array import array
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

#: Folder of the public vocabularies; a parameter of every function, never copied.
TOKENIZERS = os.environ.get("MENTIA_TOKENIZERS", "/opt/tokenizers")
#: Pieces that one worker remembers, and the longest one it does.
CACHE, CACHED_BYTES = 300_000, 64
# Fixed value: the published pattern of the 50k byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
NONE = 1 << 30


class SegmentTreeBPE:
    """Byte-pair encoding of pieces by ``ranks`` (token bytes to id, the id being the rank of its merge)."""

    def __init__(self, ranks: dict[bytes, int]):
        self.single = [ranks[bytes([b])] for b in range(256)]
        # pair of ids -> id of the merged token
        self.pairs: dict[tuple[int, int], int] = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left, right] = rank

    def encode(self, piece: bytes) -> list[int]:
        ids = [self.single[b] for b in piece]
        n = len(ids)
        if n < 2:
            return ids
        pairs, size = self.pairs, 1
        while size < n:
            size *= 2
        # node: rank * 2^31 + position, so that the minimum is the lowest rank and of these the leftmost
        shift, empty = 31, NONE << 31
        tree = [empty] * (2 * size)
        for i in range(n - 1):
            rank = pairs.get((ids[i], ids[i + 1]))
            if rank is not None:
                tree[size + i] = (rank << shift) | i
        for k in range(size - 1, 0, -1):
            a, b = tree[2 * k], tree[2 * k + 1]
            tree[k] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(at: int, value: int) -> None:
            k = size + at
            tree[k] = value
            k >>= 1
            while k:
                a, b = tree[2 * k], tree[2 * k + 1]
                low = a if a < b else b
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        while tree[1] < empty:
            rank, i = tree[1] >> shift, tree[1] & 0x7FFFFFFF
            j = after[i]
            k = after[j]
            ids[i], ids[j], after[i] = rank, -1, k
            put(j, empty)
            if k < n:
                before[k] = i
                right = pairs.get((rank, ids[k]))
                put(i, empty if right is None else (right << shift) | i)
            else:
                put(i, empty)
            h = before[i]
            if h >= 0:
                left = pairs.get((ids[h], rank))
                put(h, empty if left is None else (left << shift) | h)
        return [x for x in ids if x >= 0]


class Encoder:
    """Texts to ids, with a bounded memory of pieces."""

    def __init__(self, vocabulary: str):
        import regex

        with open(vocabulary, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.bpe, self.cut, self.known = SegmentTreeBPE(ranks), regex.compile(PATTERN).findall, {}

    def pieces(self, text: str) -> list[list[int]]:
        known, out = self.known, []
        for piece in self.cut(text):
            ids = known.get(piece)
            if ids is None:
                data = piece.encode("utf-8", "surrogatepass")
                ids = self.bpe.encode(data)
                if len(data) <= CACHED_BYTES:
                    if len(known) >= CACHE:
                        known.clear()
                    known[piece] = ids
            out.append(ids)
        return out

    def encode(self, text: str | None) -> list[int]:
        return [x for ids in self.pieces(text) for x in ids] if text else []


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    """The worker's encoder: a Python worker that is used again keeps it."""
    return Encoder(vocabulary)


def shipped(df: DataFrame, path: str) -> str:
    """Send a vocabulary of the driver to the executors once; where the driver has none, they must have it at ``path``."""
    if os.path.exists(path):
        df.sparkSession.sparkContext.addFile(path)
    return path


def local(path: str) -> str:
    """Where an executor finds a vocabulary."""
    from pyspark import SparkFiles

    sent = SparkFiles.get(os.path.basename(path))
    return sent if os.path.exists(sent) else path


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(key, ids array<int>): one row per row of ``df``, without special tokens.

    Null and empty texts have the empty list. The strings of special tokens are ordinary text. Texts of
    any length are encoded whole; repeated rows each come out; other columns are ignored.
    """
    import pyarrow as pa

    vocabulary = shipped(df, f"{folder}/{name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(local(vocabulary))
        for batch in batches:
            flat, ends = array("i"), array("i", [0])
            for value in batch.column(1).to_pylist():
                if value:
                    for ids in enc.pieces(value):
                        flat.extend(ids)
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """Columns ``keep`` of ``df`` and ``n_tokens`` bigint, 0 for null and empty texts."""
    import pyarrow as pa

    vocabulary = shipped(df, f"{folder}/{name}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(local(vocabulary))
        for batch in batches:
            n = [sum(map(len, enc.pieces(value))) if value else 0 for value in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    return df.select(*keep, text).mapInArrow(run, f"{fields}, n_tokens bigint")
