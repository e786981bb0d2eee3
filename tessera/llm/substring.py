"""Removal of long passages that repeat across documents.

Two finders share one exact verification:

* ``fixed_anchor_dedup`` indexes the non-overlapping 25-word blocks of every document
  and probes the index with every rolling 25-word window.  A window of 50 words always
  holds one whole block of the document it is compared with, so no repeat is missed.
* ``suffix_dedup`` keeps the suffixes that begin at content-selected minimisers.  Those
  of equal first words meet in one bucket, where they are sorted by what follows, chunk
  by chunk of ten words in hash order, and again by what precedes; comparing neighbours
  in both orders gives how far each suffix can extend to the right and to the left.

Hits are then extended, the first to whole windows, the second as far as its neighbours
agree: the 50-word windows inside are compared by their whole word sequence (96 bits of two
independent hashes), and adjoining windows make up the maximal repeats.  The last step is
an exchange of windows for both finders, as a suffix's farthest left and right neighbours
may be different ones, and as a passage that a third of all documents hold then costs one
entry a batch, while its suffixes with their contexts would all meet in one task.  A word
goes if a window that covers it also starts in a document with a smaller id; windows are
judged on the input.

Nothing is paired: each exchange carries a batch's distinct hashes once and brings
back one bit for each, so a group of k copies costs k, not k squared.

Edge cases: a null text has no words; texts of fewer words than a window keep all;
a null doc_id counts as the largest; equal ids are one document, so a window that
occurs only under one id stays, and a repeated row counts as that document again; a very
long text is a batch of its own, taken whole; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packed as P

U64 = np.uint64

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, removed array<struct<first_word: long, last_word: long>>"
_SENT = "bucket int, batch long, keys binary, flags binary"
_REPLY = "batch long, bucket int, keys binary"


def _runs(sorted_values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    if not len(sorted_values):
        return np.zeros(0, np.int64)
    new = np.ones(len(sorted_values), bool)
    new[1:] = sorted_values[1:] != sorted_values[:-1]
    return np.flatnonzero(new)


# ------------------------------------------------------------------ anchors of both finders


def _block_anchors(batch: P.Batch, words: P.Words, block: int, window: int):
    """(position, hash, is it a reference block) of every rolling window of block words."""
    pos, key = P.rolling(words.hashes(), words.first, block)
    doc = np.searchsorted(words.first, pos, side="right") - 1
    return pos, key >> U64(16) << U64(16), (pos - words.first[doc]) % block == 0, doc


def _sliding(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of width values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[:-step], out[step:])
        have += step
    return out


def _minimiser_anchors(batch: P.Batch, words: P.Words, kmer: int, window: int):
    """Suffixes that begin at minimisers: any window shared by two documents holds a shared one."""
    hashes = words.hashes()
    span = window - kmer + 1
    counts = np.maximum(words.counts() - kmer + 1, 0)
    pos, key = P.rolling(hashes, words.first, kmer)
    doc = np.repeat(np.arange(len(counts)), counts)
    bounds = np.concatenate(([0], np.cumsum(counts)))
    chosen = np.zeros(len(pos), bool)
    if len(key) >= span:
        order = P.mix(key ^ U64(0x5DEECE66D))
        least = _sliding(order, span, np.minimum)
        inside = doc[: len(least)] == doc[span - 1 :]  # windows of k-mers inside one text
        least = np.where(inside, least, U64(0))
        # a k-mer is chosen if it is the least of any window that holds it
        padded = np.concatenate((np.zeros(span - 1, U64), least, np.zeros(span - 1, U64)))
        chosen = _sliding(padded, span, np.maximum) == order
        chosen &= np.diff(bounds)[doc] >= span
    at = np.flatnonzero(chosen)
    return pos[at], key[at] >> U64(16) << U64(16), np.ones(len(at), bool), doc[at]


def _ladders(words: P.Words, pos: np.ndarray, doc: np.ndarray, kmer: int, steps: int) -> np.ndarray:
    """16-bit codes of the chunks of kmer words after each suffix's first (steps columns) and before it
    (steps more, from the nearest); 0 past the text's bounds."""
    ladder = np.zeros((len(pos), 2 * steps), np.uint16)
    all_pos, key = P.rolling(words.hashes(), words.first, kmer)
    if not len(all_pos):
        return ladder
    for s in range(2 * steps):
        at = pos + kmer * (s + 1 if s < steps else steps - 1 - s)
        there = (at >= words.first[doc]) & (at + kmer <= words.first[doc + 1])
        found = np.searchsorted(all_pos, at[there])
        ladder[there, s] = (key[found] >> U64(8)).astype(np.uint16) | 1
    return ladder


def _agreeing(key: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by key and codes; per row whether a neighbour has its key, and the most leading codes in common with one."""
    order = np.lexsort([*code.T[::-1], key])
    k, c = key[order], code[order]
    run = k[1:] == k[:-1]
    same = np.zeros(len(k) + 1, bool)
    same[1 : len(k)] = run
    depth = np.zeros(len(k) + 1, np.int64)
    run = run.copy()
    for s in range(code.shape[1]):
        run &= (c[1:, s] == c[:-1, s]) & (c[1:, s] != 0)
        depth[1 : len(k)] += run
    met, most = np.zeros(len(k), bool), np.zeros(len(k), np.int64)
    met[order], most[order] = same[:-1] | same[1:], np.maximum(depth[:-1], depth[1:])
    return met, most


# ------------------------------------------------------------------ the shared exchanges


def _send(batch_no: int, key: np.ndarray, extra: list[np.ndarray], buckets: int):
    """Rows of _SENT for ascending keys with equal-length extra arrays."""
    cuts = P.bucket_cuts(key, buckets)
    out: dict[str, list] = {"bucket": [], "batch": [], "keys": [], "flags": []}
    for b in np.flatnonzero(np.diff(cuts)):
        lo, hi = cuts[b], cuts[b + 1]
        out["bucket"].append(int(b))
        out["batch"].append(batch_no)
        out["keys"].append(P.pack_sorted(key[lo:hi]))
        out["flags"].append(b"".join(np.ascontiguousarray(x[lo:hi]).tobytes() for x in extra))
    return pa.RecordBatch.from_pydict(out, schema=_sent_arrow())


def _sent_arrow() -> pa.Schema:
    return pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("flags", pa.binary())])


def _reply_arrow() -> pa.Schema:
    return pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("keys", pa.binary())])


def _grouped(table: pa.Table):
    """The keys of all batches of a bucket with the batch's index, and each batch's flag bytes."""
    rows = table.select(["bucket", "batch", "keys", "flags"]).to_pylist()
    keys = [P.unpack_sorted(r["keys"]) for r in rows]
    whose = np.repeat(np.arange(len(rows)), [len(k) for k in keys])
    return rows, keys, (np.concatenate(keys) if keys else np.zeros(0, U64)), whose


def _reply(rows, keys, hit: np.ndarray) -> pa.Table:
    """For each batch those of its keys that hit."""
    out: dict[str, list] = {"batch": [], "bucket": [], "keys": []}
    begin = 0
    for r, k in zip(rows, keys, strict=True):
        mine = hit[begin : begin + len(k)]
        begin += len(k)
        if mine.any():
            out["batch"].append(r["batch"])
            out["bucket"].append(r["bucket"])
            out["keys"].append(P.pack_sorted(k[mine]))
    return pa.Table.from_pydict(out, schema=_reply_arrow())


def _replied(table: pa.Table) -> np.ndarray:
    """All keys of a batch's replies, ascending."""
    parts = [(r["bucket"], P.unpack_sorted(r["keys"])) for r in table.select(["bucket", "keys"]).to_pylist()]
    return np.concatenate([k for _, k in sorted(parts, key=lambda x: x[0])]) if parts else np.zeros(0, U64)


def _member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    if not len(among):
        return np.zeros(len(values), bool)
    at = np.searchsorted(among, values)
    at[at == len(among)] = 0
    return among[at] == values


def _dedup(docs: DataFrame, anchors, anchor_width: int, window: int, ladder_steps: int, text: str, doc_id: str) -> DataFrame:
    spark = docs.sparkSession
    buckets = 2 * P.partitions(spark)
    packed = P.pack_documents(docs, text, doc_id)
    steps = ladder_steps

    def per_key(batch: P.Batch, words: P.Words):
        """Distinct anchors of a batch: key, is a reference among them, are they of several documents, ladder."""
        pos, key, ref, doc = anchors(batch, words)
        ladder = _ladders(words, pos, doc, anchor_width, steps) if steps else None
        ids = batch.ids[doc] if len(doc) else np.zeros(0, np.int64)
        order = np.lexsort([*(ladder.T[::-1] if steps else []), key]) if steps else np.argsort(key, kind="stable")
        key, ref, ids = key[order], ref[order], ids[order]
        same = key if not steps else None
        if steps:
            ladder = ladder[order]
            new = np.ones(len(key), bool)
            if len(key):
                new[1:] = (key[1:] != key[:-1]) | (ladder[1:] != ladder[:-1]).any(axis=1)
            at = np.flatnonzero(new)
        else:
            at = _runs(same)
        if not len(at):
            return key, np.zeros(0, bool), np.zeros(0, bool), ladder
        several = np.maximum.reduceat(ids, at) != np.minimum.reduceat(ids, at)
        return key[at], np.logical_or.reduceat(ref, at), several, (ladder[at] if steps else None)

    def send_anchors(stream):
        for rows in stream:
            for batch in P.batches(rows):
                words = batch.words()
                key, ref, several, ladder = per_key(batch, words)
                extra = ([ladder] if steps else []) + [ref.astype(np.uint8) | several.astype(np.uint8) << 1]
                yield _send(batch.batch, key, extra, buckets)

    def find_blocks(table: pa.Table) -> pa.Table:
        """A key hits if a reference block has it and documents of two ids, or two batches, hold it."""
        rows, keys, key, whose = _grouped(table)
        flags = np.concatenate([np.frombuffer(r["flags"], np.uint8)[: len(k)] for r, k in zip(rows, keys, strict=True)])
        order = np.argsort(key, kind="stable")
        at = _runs(key[order])
        sizes = np.diff(np.append(at, len(key)))
        any_flag = np.bitwise_or.reduceat(flags[order], at)
        good = (any_flag & 1 > 0) & ((any_flag & 2 > 0) | (sizes > 1))
        hit = np.zeros(len(key), bool)
        hit[order] = np.repeat(good, sizes)
        return _reply(rows, keys, hit)

    def find_suffixes(table: pa.Table) -> pa.Table:
        """Sort the suffixes both ways, compare neighbours, and keep those that may extend to a window.

        The reply names a key once, with its suffixes' chunks in common to the right (the first
        included) and to the left in its low 16 bits.  A key that a batch itself holds in two
        documents may extend all the way.
        """
        rows, keys, key, whose = _grouped(table)
        flags, codes = [], []
        for r, k in zip(rows, keys, strict=True):
            codes.append(np.frombuffer(r["flags"], np.uint16, 2 * len(k) * steps).reshape(len(k), 2 * steps))
            flags.append(np.frombuffer(r["flags"], np.uint8, offset=4 * len(k) * steps))
        flag, code = np.concatenate(flags), np.concatenate(codes)
        met, right = _agreeing(key, code[:, :steps])
        _, left = _agreeing(key, code[:, steps:])
        several = flag & 2 > 0
        right, left = np.where(several, steps, right) + 1, np.where(several, steps, left)
        far = (right + 1) * anchor_width - 1 + (left + 1) * anchor_width - 1 >= window
        hit = (met | several) & far
        out: dict[str, list] = {"batch": [], "bucket": [], "keys": []}
        begin = 0
        for r, k in zip(rows, keys, strict=True):
            mine = slice(begin, begin + len(k))
            begin += len(k)
            if not hit[mine].any():
                continue
            k, x, y = k[hit[mine]], right[mine][hit[mine]], left[mine][hit[mine]]
            at = _runs(k)
            reach = np.maximum.reduceat(y, at) << 8 | np.maximum.reduceat(x, at)
            out["batch"].append(r["batch"])
            out["bucket"].append(r["bucket"])
            out["keys"].append(P.pack_sorted(k[at] | reach.astype(U64)))
        return pa.Table.from_pydict(out, schema=_reply_arrow())

    def windows(words: P.Words):
        pos, key = P.rolling(words.hashes(), words.first, window)
        return pos, key, np.searchsorted(words.first, pos, side="right") - 1

    def send_windows(key_, left: pa.Table, right: pa.Table) -> pa.Table:
        """Extend a batch's hits: all windows that hold one, by their whole sequence, with their least id."""
        for batch in P.batches(left):
            hits = _replied(right)
            if not len(hits):
                return _sent_arrow().empty_table()
            words = batch.words()
            pos, key, _, _ = anchors(batch, words)
            if steps:
                names = hits >> U64(16) << U64(16)
                at = np.searchsorted(names, key)
                at[at == len(names)] = 0
                found = names[at] == key
                reach = (hits[at[found]] & U64(0xFFFF)).astype(np.int64)
                # chunks in common, so this many words at most to the right of the suffix's begin and to its left
                right, left = ((reach & 255) + 1) * anchor_width - 1, ((reach >> 8) + 1) * anchor_width - 1
            else:
                found = _member(key, hits)
                right = left = np.full(int(found.sum()), window)
            # windows that hold the anchor and lie inside its reach
            p = pos[found]
            begin = np.maximum(p - np.minimum(left, window - anchor_width), 0)
            end = p + np.minimum(right, window) - window + 1
            some = end > begin
            mark = np.zeros(len(words) + 1, np.int64)
            np.add.at(mark, begin[some], 1)
            np.add.at(mark, end[some], -1)
            wpos, wkey, wdoc = windows(words)
            take = np.cumsum(mark)[wpos] > 0
            wpos, wkey, ids = wpos[take], wkey[take], batch.ids[wdoc[take]]
            _, check = P.rolling(words.hashes(P.MULT_B), words.first, window, P.MULT_A)
            check = (check[take] >> U64(32)).astype(np.uint32)
            order = np.lexsort((check, wkey))
            wkey, check, ids = wkey[order], check[order], ids[order]
            at = _runs(wkey)
            if not len(at):
                return _sent_arrow().empty_table()
            least = np.minimum.reduceat(ids, at)
            return pa.Table.from_batches([_send(batch.batch, wkey[at], [check[at], least], buckets)])
        return _sent_arrow().empty_table()

    def judge_windows(table: pa.Table) -> pa.Table:
        """Windows that another batch holds under a smaller id."""
        rows, keys, key, whose = _grouped(table)
        check = np.concatenate([np.frombuffer(r["flags"], np.uint32, len(k)) for r, k in zip(rows, keys, strict=True)])
        ids = np.concatenate([np.frombuffer(r["flags"][4 * len(k) :], np.int64) for r, k in zip(rows, keys, strict=True)])
        order = np.lexsort((check, key))
        k, c = key[order], check[order]
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
        at = np.flatnonzero(new)
        least = np.repeat(np.minimum.reduceat(ids[order], at), np.diff(np.append(at, len(k))))
        hit = np.zeros(len(key), bool)
        hit[order] = least < ids[order]
        return _reply(rows, keys, hit)

    def finish(key_, left: pa.Table, right: pa.Table) -> pa.Table:
        columns: list[list] = [[], [], [], []]
        ids: list[pa.Array] = []
        for batch in P.batches(left):
            words = batch.words()
            pos, key, doc = windows(words)
            gone = _member(key, _replied(right))
            order = np.lexsort((batch.ids[doc], key)) if len(key) else np.zeros(0, np.int64)
            at = _runs(key[order])
            if len(at):
                own = batch.ids[doc][order]
                least = np.repeat(own[at], np.diff(np.append(at, len(key))))
                gone[order] |= own > least
            mark = np.zeros(len(words) + 1, np.int32)
            np.add.at(mark, pos[gone], 1)
            np.add.at(mark, pos[gone] + window, -1)
            removed = np.cumsum(mark[:-1]) > 0
            n_gone = np.concatenate(([0], np.cumsum(removed)))
            for i in range(len(batch.ids)):
                a, b = int(words.first[i]), int(words.first[i + 1])
                lost = int(n_gone[b] - n_gone[a])
                kept = batch.text(i).split()
                spans = []
                if lost:
                    keep = ~removed[a:b]
                    kept = [w for w, k in zip(kept, keep.tolist(), strict=True) if k]
                    edge = np.flatnonzero(np.diff(np.concatenate(([True], keep, [True])).astype(np.int8)))
                    spans = [{"first_word": int(x), "last_word": int(y) - 1} for x, y in edge.reshape(-1, 2)]
                columns[0].append(b - a)
                columns[1].append(lost)
                columns[2].append(hashlib.sha256(b" ".join(kept)).hexdigest())
                columns[3].append(spans)
            ids.append(batch.id_column())
        return pa.Table.from_arrays([pa.chunked_array(ids, pa.int64()), *(pa.array(c, t) for c, t in zip(columns, _RESULT_TYPES, strict=True))], names=_RESULT_NAMES)

    sent = packed.mapInArrow(send_anchors, _SENT)
    hits = sent.groupBy("bucket").applyInArrow(find_suffixes if steps else find_blocks, _REPLY)
    extended = packed.groupBy("batch").cogroup(hits.groupBy("batch")).applyInArrow(send_windows, _SENT)
    judged = extended.groupBy("bucket").applyInArrow(judge_windows, _REPLY)
    return packed.groupBy("batch").cogroup(judged.groupBy("batch")).applyInArrow(finish, RESULT)


_RESULT_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64())]))]
_RESULT_NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256", "removed"]


def fixed_anchor_dedup(docs: DataFrame, window: int = 50, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per document the words left after removing repeated windows, found by fixed-block anchors.

    ``removed`` lists the maximal repeats as word ranges, both ends included.
    """
    block = max(1, (window + 1) // 2) if window % 2 else window // 2

    def anchors(batch, words):
        return _block_anchors(batch, words, block, window)

    return _dedup(docs, anchors, block, window, 0, text, doc_id)


def suffix_dedup(docs: DataFrame, window: int = 50, kmer: int = 10, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The same removal, its candidates found by sorting sparse suffixes at minimiser positions."""

    def anchors(batch, words):
        return _minimiser_anchors(batch, words, kmer, window)

    return _dedup(docs, anchors, kmer, window, max(0, window // kmer - 1), text, doc_id)
