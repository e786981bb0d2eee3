"""Benchmark passages in documents, with edits, by the q-gram lemma and banded alignment.

Texts are compared in lower case with white space made single spaces.  A passage of L
characters leaks if some region of the document is within e = floor(edit_rate L) edits
of the whole passage.  Such a region shares at least L - q + 1 - q e q-grams with it, all
on diagonals (document position less passage position) that span at most e.  So shared
q-grams are counted in overlapping bands of 2 (e + 1) diagonals, each q-gram of the passage
once; only bands that meet the bound are kept, and each run of them is verified by an edit-distance alignment confined
to its diagonals and e either side.  A document is searched in overlapping slices, and of a q-gram that a slice repeats
one position a band step counts, so memory depends on the slice and the passages and not on how a text repeats itself.  q is 8, or less for passages too short for the bound.

The benchmark is a query set: it is taken in blocks of at most BLOCK_CHARS characters, each
broadcast and run against all documents in one narrow pass.  Nothing about documents is
collected or shuffled.

Edge cases: null or blank passages never leak, null or blank documents have no leaks; a
passage of fewer than 10 characters must occur exactly; of regions with equal edits the first
found is told; equal rows give equal leaks, and repeated passages are each reported; a null
doc_id or item_id is reported as such; a very long text is searched whole, in memory that
grows with it; an empty table gives no rows; other columns pass through, but for one with
the output's name, which the output replaces.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed as P

U64 = np.uint64
Q = 8

#: Characters of benchmark passages that are broadcast at once (about 40 bytes each).
BLOCK_CHARS = 4 << 20

#: Characters of a document that are searched at once, beside the longest passage.
SLICE = 1 << 16

#: Positions of one q-gram in a slice beyond which only one a step counts.
REPEATED = 32

#: Entries (position, posting) that are held before repeats are left out; bands are numbered from _ORIGIN.
ENTRIES, _ORIGIN = 1 << 20, 1 << 24

#: Diagonals that one alignment takes on at most, where many bands in a row meet the bound.
WIDE = 1 << 14

LEAK = pa.struct([("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())])
LEAKS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("item_id", "start", "end", "edits")]))


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _folded(codes: np.ndarray) -> np.ndarray:
    """Eight bits a character; wide ones are folded, which only adds candidates."""
    return (codes ^ codes >> np.uint32(8) ^ codes >> np.uint32(16)).astype(np.uint8)


def _grams(folded: np.ndarray, q: int) -> np.ndarray:
    """The q-grams at every position, as 8 q bits."""
    eight = np.ndarray((max(0, len(folded) - q + 1),), "<u8", np.concatenate((folded, np.zeros(8, np.uint8))), strides=(1,))
    return eight if q == 8 else eight & U64((1 << 8 * q) - 1)


def bound(length: int, edit_rate: float, q: int = Q) -> tuple[int, int, int]:
    """(q, edits, least shared q-grams) of a passage; the largest q whose bound filters."""
    edits = int(math.floor(edit_rate * length + 1e-9))
    for size in range(min(q, length), 0, -1):
        shared = length - size + 1 - size * edits
        if shared >= 1:
            return size, edits, shared
    return 1, 0, length


def align(item: np.ndarray, region: np.ndarray, low: int, high: int, most: int, anchored: bool = False) -> tuple[int, int]:
    """(edits, end in the region) of the best alignment of the whole item on diagonals low..high.

    The alignment may begin anywhere, or at the region's first character if anchored.
    Edits above ``most`` are given as most + 1.
    """
    n, width = len(region), high - low + 1
    far = most + 1
    diag = np.arange(low, high + 1)
    steps = np.arange(width)
    row = np.where((diag == 0) if anchored else (diag >= 0) & (diag <= n), 0, far)
    if anchored:
        row = np.where((diag >= 0) & (diag <= n), np.minimum(diag, far), row)
    padded = np.full(width + 1, far)
    for i in range(1, len(item) + 1):
        j = i + diag
        inside = (j >= 1) & (j <= n)
        same = np.zeros(width, bool)
        same[inside] = region[j[inside] - 1] == item[i - 1]
        padded[:width] = row
        now = np.minimum(row + ~same, padded[1:] + 1)
        now[~inside] = np.where(j[~inside] == 0, padded[1:][~inside] + 1, far)
        now = np.minimum.accumulate(now - steps) + steps
        now[j > n] = far
        now[j < 0] = far
        row = np.minimum(now, far)
        if row.min() >= far:
            return far, 0
    best = int(row.argmin())
    return int(row[best]), len(item) + low + best


class _Shared:
    """Distinct (item, band, place) of the q-grams that a slice shares with passages; bands count from _ORIGIN."""

    def __init__(self, item: np.ndarray, place: np.ndarray, steps: np.ndarray):
        self.item, self.place, self.steps = item, place, steps
        self.found: list[tuple[np.ndarray, np.ndarray]] = []

    def _put(self, which: np.ndarray, low: np.ndarray, twice: bool) -> None:
        """Entries of postings ``which`` whose positions, less their place, begin at ``low``; ``twice``: and may lie a band further."""
        items = self.item[which]
        band = (low - self.place[which]) // self.steps[items] + _ORIGIN
        keys, places = items.astype(np.int64) << 40 | band, self.place[which]
        if twice:
            keys, places = np.concatenate((keys, keys + 1)), np.tile(places, 2)
        self.found.append(_distinct(keys, places))

    def add(self, at: np.ndarray, slot: np.ndarray, first: np.ndarray, twice: bool = False) -> None:
        """Each position against each posting of its q-gram, some million entries at a time."""
        self._spread(at, first[slot], first[slot + 1] - first[slot], None, twice)

    def _spread(self, at, begins, many, order, twice):
        ends = np.cumsum(many)
        done = 0
        while done < len(at):
            before = int(ends[done - 1]) if done else 0
            upto = max(done + 1, int(np.searchsorted(ends, before + ENTRIES, side="right")))
            part, n = slice(done, upto), many[done:upto]
            which = np.arange(int(n.sum())) + np.repeat(begins[part] - (ends[part] - n - before), n)
            self._put(which if order is None else order[which], np.repeat(at[part], n), twice)
            done = upto

    def add_repeated(self, at: np.ndarray, slot: np.ndarray, first: np.ndarray) -> None:
        """Q-grams at many positions: of the positions of one step only one is kept, and its entries count in both bands that they can lie in."""
        slots, at_of = np.unique(slot, return_inverse=True)
        many = first[slots + 1] - first[slots]
        which = np.arange(int(many.sum())) + np.repeat(first[slots] - np.cumsum(many) + many, many)
        owner, step = np.repeat(np.arange(len(slots)), many), self.steps[self.item[which]]
        for s in np.unique(step).tolist():
            mine = step == s
            begins = np.searchsorted(owner[mine], np.arange(len(slots) + 1))
            quanta = np.unique(at_of.astype(np.int64) << 40 | at // s)
            of, low = quanta >> 40, (quanta & (1 << 40) - 1) * s
            self._spread(low, begins[of], begins[of + 1] - begins[of], which[mine], s > 1)

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """(item << 40 | band, place), sorted and distinct."""
        return _distinct(*(np.concatenate(x) for x in zip(*self.found, strict=True)))


def _distinct(keys: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((places, keys))
    keys, places = keys[order], places[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (places[1:] != places[:-1])
    return keys[new], places[new]


class Index:
    """Postings of the q-grams of a block of passages."""

    def __init__(self, items: list[tuple[int | None, str | None]], edit_rate: float):
        self.items = [(i, t) for i, t in ((i, normalise(t)) for i, t in items) if t]
        self.codes = [_codes(t) for _, t in self.items]
        bounds = [bound(len(c), edit_rate) for c in self.codes]
        self.edits = np.array([b[1] for b in bounds], np.int64)
        self.longest = max((len(c) + b[1] for c, b in zip(self.codes, bounds, strict=True)), default=0)
        self.need = np.array([b[2] for b in bounds], np.int64)
        self.by_q = {}
        for q in sorted({b[0] for b in bounds}):
            which = [k for k, b in enumerate(bounds) if b[0] == q]
            grams = [_grams(_folded(self.codes[k]), q) for k in which]
            gram = np.concatenate(grams)
            item = np.repeat(which, [len(g) for g in grams])
            place = np.concatenate([np.arange(len(g)) for g in grams])
            order = np.argsort(gram, kind="stable")
            names, first = np.unique(gram[order], return_index=True)
            maybe = np.zeros(1 << 20, bool)
            maybe[self._slot(names)] = True
            self.by_q[q] = names, np.append(first, len(gram)), item[order], place[order], maybe

    @staticmethod
    def _slot(grams: np.ndarray) -> np.ndarray:
        slots = grams * U64(P.MULT_A)
        slots >>= U64(44)
        return slots.view(np.int64)

    def candidates(self, codes: np.ndarray):
        """(item, first diagonal, last diagonal) of every run of bands that meet the bound, in order.

        The text is worked on in overlapping slices, each of which holds every region that begins in it.
        """
        folded = _folded(codes)
        reach = self.longest + Q
        step = max(SLICE, reach)
        for begin in range(0, max(1, len(folded)), step):
            yield from self._in_slice(folded[begin : begin + step + reach], begin)

    def _in_slice(self, folded: np.ndarray, begin: int):
        for q, (names, first, item, place, maybe) in self.by_q.items():
            if len(folded) < q:
                continue
            grams = _grams(folded, q)
            at = np.flatnonzero(maybe[self._slot(grams)])
            slot = np.searchsorted(names, grams[at])
            slot[slot == len(names)] = 0
            hit = names[slot] == grams[at]
            at, slot = at[hit], slot[hit]
            if not len(at):
                continue
            shared = _Shared(item, place, self.edits + 1)
            often = np.bincount(slot) > REPEATED
            if often.any():
                again = often[slot]
                shared.add_repeated(at[again], slot[again], first)
                at, slot = at[~again], slot[~again]
            shared.add(at, slot, first)
            keys, places = shared.bands()
            starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            ends, keys = np.append(starts[1:], len(keys)), keys[starts]
            next_one = np.concatenate((keys[1:] == keys[:-1] + 1, [False]))
            upto = np.where(next_one, np.append(ends[1:], 0), ends)
            items = keys >> 40
            open_: tuple[int, int, int] | None = None
            for j in np.flatnonzero(upto - starts >= self.need[items]).tolist():
                k = int(items[j])
                # a q-gram of the passage counts once, however often the document repeats it
                if len(np.unique(places[starts[j] : upto[j]])) < self.need[k]:
                    continue
                s = int(self.edits[k]) + 1
                low = (int(keys[j] & (1 << 40) - 1) - _ORIGIN) * s + begin
                if open_ and open_[0] == k and low <= open_[2] and low - open_[1] < WIDE:
                    open_ = (k, open_[1], low + 2 * s - 1)
                    continue
                if open_:
                    yield open_
                open_ = (k, low, low + 2 * s - 1)
            if open_:
                yield open_

    def leaks(self, text: str, codes: np.ndarray) -> list[dict]:
        """The best region of each passage that leaks into a normalised text."""
        best: dict[int, tuple[int, int, int]] = {}
        for k, low, high in self.candidates(codes):
            have = best.get(k)
            if have and have[0] == 0:
                continue
            item, e = self.codes[k], int(self.edits[k])
            begin, end = max(0, low - e), min(len(codes), high + e + len(item) + e)
            if begin >= end:
                continue
            found = text.find(self.items[k][1], begin, end)
            if found >= 0:
                best[k] = (0, found, found + len(item))
                continue
            if e == 0:
                continue
            region = codes[begin:end]
            edits, stop = align(item, region, low - e - begin, high + e - begin, e)
            if edits > e or (have and have[0] <= edits):
                continue
            back, length = align(item[::-1], region[:stop][::-1], -e, e, e, anchored=True)
            best[k] = (edits, begin + stop - (length if back <= e else len(item)), begin + stop)
        return [{"item_id": self.items[k][0], "start": a, "end": b, "edits": d} for k, (d, a, b) in sorted(best.items())]


def with_leaks(docs: DataFrame, benchmark: DataFrame, edit_rate: float = 0.1, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "leaks") -> DataFrame:
    """docs with an array of (item_id, start, end, edits); places are in the normalised text."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").cast("long").alias("id"), F.col(f"`{item_text}`").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    names = [into] + [P.free_name(docs, f"{into}_{b}") for b in range(1, blocks)]
    out = docs
    if blocks > 1:  # rows are dealt by number, so that repeats of a passage spread over blocks
        items = P.saved(items.withColumn("row", F.monotonically_increasing_id()), P.scratch(spark, "passages") + "/items")
    for b, name in enumerate(names):
        block = items if blocks == 1 else items.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast(([(r.id, r.text) for r in block.collect()], edit_rate))
        out = P.add_columns(out, text, [(name, LEAKS)], _finder(shared))
    if blocks > 1:
        out = out.select(*(F.concat(*(F.col(f"`{n}`") for n in names)).alias(into) if c == into else F.col(f"`{c}`") for c in out.columns if c not in names[1:]))
    return out


_indexes: dict[int, Index] = {}


def _finder(shared):
    number = shared._jbroadcast.id() if shared._jbroadcast is not None else 0

    def make(texts):
        if number not in _indexes:
            _indexes.clear()
            _indexes[number] = Index(*shared.value)
        index, found = _indexes[number], []
        for raw in texts.to_pylist():
            clean = normalise(raw)
            found.append(index.leaks(clean, _codes(clean)) if clean else [])
        return [pa.array(found, pa.list_(LEAK))]

    return make
