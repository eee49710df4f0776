"""Problem 7: token ids of every text under a public byte-level BPE vocabulary.

A text is cut by the vocabulary's pattern; the bytes of a piece are merged by rank. A segment tree over the
piece's byte positions holds in each node the least (rank, position) of the pairs below it, so its root names the
leftmost pair of least rank. A merge joins two live neighbours and changes at most three leaves, each in
logarithmic time; a piece of n bytes costs O(n log n), however long it is. Pieces repeat, so a worker keeps the
ids of those it has met.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import spread

TOKENIZERS = "/opt/tokenizers"
#: Fixed value: the splitting pattern that belongs to the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT = 400_000  # pieces whose ids a worker keeps; beyond that it starts over
KEPT_LENGTH = 64  # longer pieces are not kept

_NONE = 1 << 62
_SHIFT = 32
_MASK = (1 << _SHIFT) - 1


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: again and again the leftmost pair of least rank is merged."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    size = 1 << (n - 2).bit_length() if n > 2 else 1
    tree = [_NONE] * (2 * size)
    for i in range(n - 1):
        r = ranks.get(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << _SHIFT | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b
    after = list(range(1, n + 1))  # start of the next live part
    before = list(range(-1, n))  # start of the part before; one entry more for the end

    def put(i: int, value: int) -> None:
        i += size
        tree[i] = value
        while i > 1:
            i >>= 1
            a, b = tree[2 * i], tree[2 * i + 1]
            m = a if a < b else b
            if tree[i] == m:
                return
            tree[i] = m

    while tree[1] != _NONE:
        i = tree[1] & _MASK
        j = after[i]
        k = after[j]
        after[i] = k
        before[k] = i
        if j < n - 1:
            put(j, _NONE)
        r = ranks.get(piece[i : after[k]]) if k < n else None
        put(i, _NONE if r is None else r << _SHIFT | i)
        h = before[i]
        if h >= 0:
            r = ranks.get(piece[h:k])
            put(h, _NONE if r is None else r << _SHIFT | h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts with one rank file; keeps the ids of short pieces it has met."""

    def __init__(self, rank_file: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in rank_file.splitlines() if line)}
        self.find = regex.compile(PATTERN).findall
        self.kept: dict[str, list[int]] = {}

    def piece(self, s: str) -> list[int]:
        b = s.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(b)
        ids = [whole] if whole is not None else merge(b, self.ranks)
        if len(s) <= KEPT_LENGTH:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            self.kept[s] = ids
        return ids

    def extend(self, text: str, out: list[int]) -> None:
        kept = self.kept
        for s in self.find(text):
            ids = kept.get(s)
            out.extend(self.piece(s) if ids is None else ids)

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if text:
            self.extend(text, out)
        return out


_encoders: dict[int, Encoder] = {}


def _encoder(rank_file: bytes) -> Encoder:
    key = hash(rank_file)
    if key not in _encoders:
        _encoders[key] = Encoder(rank_file)
    return _encoders[key]


def read_ranks(name: str, folder: str = TOKENIZERS) -> bytes:
    """The rank file of a vocabulary; a few hundred kB, read by the driver and broadcast."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def _encoded(df: DataFrame, keep: list[str], text: Column, name: str, folder: str, only_length: bool) -> DataFrame:
    spark = df.sparkSession
    ranks = spark.sparkContext.broadcast(read_ranks(name, folder))
    src = spread(df.select(*keep, text.alias("__text")))
    kind = "bigint" if only_length else "array<int>"
    out = "n_tokens" if only_length else "ids"
    fields = ", ".join(f"`{c}` {t}" for c, t in src.dtypes if c != "__text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(ranks.value)
        for b in batches:
            at, flat, ends = b.schema.get_field_index("__text"), [], [0]
            n = []
            for text in b.column(at).to_pylist():
                before = len(flat)
                if text:
                    enc.extend(text, flat)
                ends.append(len(flat))
                n.append(len(flat) - before)
                if only_length:
                    flat.clear()
            made = pa.array(n, pa.int64()) if only_length else pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.array(flat, dtype=np.int32)))
            cols = [c for i, c in enumerate(b.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, made], names=[*keep, out])

    return src.mapInArrow(work, f"{fields}, {out} {kind}" if fields else f"{out} {kind}")


def encode(df: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns `keep` and ids array<int>: the text's token ids, without special tokens.

    A null and an empty text have no ids: the empty list. Strings that look like special tokens are plain text.
    Every byte has an id, so no text fails, however long or odd.
    """
    return _encoded(df, keep, F.col(text), name, folder, False)


def count_tokens(df: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """The columns `keep` and n_tokens: how many ids encode() gives, 0 for null and empty texts."""
    return _encoded(df, keep, F.col(text), name, folder, True)
