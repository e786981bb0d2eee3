"""Byte-level BPE encoding and decoding by a public rank file.

A text is split by the tokenizer's pattern; each match is merged on its own.  Within a
match a segment tree over the byte positions holds the leftmost least pair rank: the
root names the next merge, and a merge touches the leaves of the merged pair and of its
live neighbours only, each with a logarithmic update, so a match of n bytes takes
O(n log n) however long it is.

Workers keep the ids of the matches they met in a table of bounded size, emptied when
full, because words repeat.  Everything is a narrow pass: no shuffle, no state between
tasks.  Edge cases: a null text is empty and has no ids; any valid UTF-8 has ids, as all
single bytes are in the file; a very long text is one row of a piece of its own and takes
memory in proportion to itself; repeated rows are encoded alike; an empty table gives no
rows; other columns pass through unchanged, but for one with an output's name, which the
output replaces.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import packed as P

#: Matches whose ids a worker keeps at most (about 85 MB).
CACHE = 400_000

_NONE = 1 << 60
_coders: dict[tuple, Coder] = {}


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The lines 'base64 rank' of a rank file."""
    out = {}
    for line in data.splitlines():
        if line.strip():
            token, rank = line.split()
            out[base64.b64decode(token)] = int(rank)
    return out


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match: repeatedly merge the leftmost pair of least rank."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    rank_of = ranks.get
    size = 1 << (n - 1).bit_length()
    tree = [_NONE] * (2 * size)
    tree[size : size + n - 1] = [rank_of(piece[i : i + 2], _NONE) for i in range(n - 1)]
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a <= b else b
    after = list(range(1, n + 1))  # where the live token at i ends
    before = list(range(-1, n))  # where the live token left of i begins
    least = tree[1]
    while least != _NONE:
        i = 1
        while i < size:
            i += i
            if tree[i] != least:
                i += 1
        i -= size
        gone = after[i]
        end = after[gone]
        after[i] = end
        before[end] = i
        left = before[i]
        changed = [(gone, _NONE), (i, rank_of(piece[i : after[end]], _NONE) if end < n else _NONE)]
        if left >= 0:
            changed.append((left, rank_of(piece[left:end], _NONE)))
        for k, value in changed:  # point updates, up to the first node that stays
            k += size
            if tree[k] == value:
                continue
            tree[k] = value
            while k > 1:
                other = tree[k ^ 1]
                if other < value:
                    value = other
                k >>= 1
                if tree[k] == value:
                    break
                tree[k] = value
        least = tree[1]
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : after[i]]])
        i = after[i]
    return out


class _Known(dict):
    """Match -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode()
        whole = self.ranks.get(data)
        ids = np.array(merge(data, self.ranks) if whole is None else [whole], "<u4").tobytes()
        if len(self) >= CACHE:
            self.clear()
        if len(data) <= 64:
            self[piece] = ids
        return ids


class Coder:
    """Encoder and decoder of one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.known = _Known(ranks)
        self.split = regex.compile(pattern).findall
        tokens = [b""] * (max(ranks.values()) + 1 if ranks else 0)
        for token, rank in ranks.items():
            tokens[rank] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.begin = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int64)

    def encode(self, text: str) -> bytes:
        return b"".join(map(self.known.__getitem__, self.split(text)))

    def decode(self, ids: bytes) -> bytes:
        out = []
        for k in range(0, len(ids), 1 << 18):
            i = np.frombuffer(ids[k : k + (1 << 18)], "<u4")
            sizes = self.begin[i + 1] - self.begin[i]
            ends = np.cumsum(sizes)
            at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.begin[i] - ends + sizes, sizes)
            out.append(self.bytes[at].tobytes())
        return b"".join(out)


def _coder(shared) -> Coder:
    """The worker's coder for a broadcast (rank file, pattern)."""
    data, pattern = shared.value
    key = (len(data), hash(data), pattern)
    if key not in _coders:
        _coders.clear()
        _coders[key] = Coder(read_ranks(data), pattern)
    return _coders[key]


def _share(df: DataFrame, path: str, pattern: str):
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast((file.read(), pattern))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", into: str = "ids", decoded: str | None = None) -> DataFrame:
    """df with the ids of its texts, as bytes of little-endian unsigned 32-bit integers.

    With ``decoded`` the ids are decoded again in the same pass, into a column of that name:
    one Python worker a task instead of two.
    """
    shared = _share(df, path, pattern)

    def make(texts):
        coder = _coder(shared)
        ids = [coder.encode(x) if x else b"" for x in texts.to_pylist()]
        made = [pa.array(ids, pa.binary())]
        if decoded:
            made.append(pa.array([coder.decode(x) for x in ids], pa.binary()))
        return made

    return P.add_columns(df, text, [(name, T.BinaryType()) for name in (into, decoded) if name], make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """df with the bytes that its ids stand for."""
    shared = _share(df, path, pattern)

    def make(column):
        coder = _coder(shared)
        return [pa.array([coder.decode(x) if x else b"" for x in column.to_pylist()], pa.binary())]

    return P.add_columns(df, ids, [(into, T.BinaryType())], make)
