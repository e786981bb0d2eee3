"""Removal of lines that many distinct sites share.

Each batch sends, per distinct line hash, a HyperLogLog sketch of the sites it saw the
line on, in sparse form (register, rank, sites); a bucket merges the sketches of a line by
register maximum.  Lines whose estimate is ``band`` standard errors above ``min_sites`` are
settled by it; lines whose batches together name fewer sites, counting shared ones again, lie
on fewer for certain and are left.  For all others the batches send the distinct (line, site)
pairs, which are counted exactly.  At 256 registers the estimate of fewer than ten sites is
below 9.4 (linear counting, registers used never exceed the sites), far under the band's upper
end of 12.6, so no line is settled wrongly at the default threshold.  Lines on at least
``min_sites`` sites are cross-site boilerplate: their first occurrence (smallest doc_id, then
first line) stays, all others go.

A line that a third of all documents hold is one entry per batch and register, so no
bucket grows with a line's copies.

Edge cases: lines are compared with outer white space trimmed, by 64-bit hash; lines
without a word are never removed; a null text has no lines; a null site is one site; a
null doc_id counts as the largest; rows of equal id both keep a first occurrence that is
theirs, and so do repeated rows; a very long text is a batch of its own, taken whole; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import packed as P

U64 = np.uint64

#: Bits of a sketch's register number: 256 registers, a standard error of 6.5 %.
PRECISION = 8

_SENT = "bucket int, batch long, keys binary, values binary"
_SENT_ARROW = pa.schema([("bucket", pa.int32()), ("batch", pa.int64()), ("keys", pa.binary()), ("values", pa.binary())])
_REPLY = "batch long, bucket int, kind int, keys binary, values binary"
_REPLY_ARROW = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("kind", pa.int32()), ("keys", pa.binary()), ("values", pa.binary())])
_SURE, _NEAR = 0, 1

RESULT = "doc_id long, n_lines long, n_removed long, kept string"


def estimate(zeros: np.ndarray, harmonic: np.ndarray) -> np.ndarray:
    """Distinct counts from the number of empty registers and the sum of 2^-rank over all registers."""
    m = 1 << PRECISION
    raw = 0.7213 / (1 + 1.079 / m) * m * m / harmonic
    linear = m * np.log(m / np.maximum(zeros, 1))
    return np.where((raw <= 2.5 * m) & (zeros > 0), linear, raw)


def _lines(data: np.ndarray, offsets: np.ndarray):
    """(start, end, doc, trimmed start, trimmed end, has a word) of every line."""
    n = len(offsets) - 1
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((offsets[1:], breaks)), kind="stable")
    first = np.searchsorted(breaks, offsets) + np.arange(n + 1)
    first[-1] = len(starts)
    words = P.Words(data, offsets)
    a, b = np.searchsorted(words.starts, starts), np.searchsorted(words.starts, ends)
    has = b > a
    left, right = starts.copy(), ends.copy()
    left[has], right[has] = words.starts[a[has]], words.ends[b[has] - 1]
    return starts, ends, first, left, right, has


def _hashes(data, offsets):
    """Hash, document and line number of every line with a word."""
    _, _, first, left, right, has = _lines(data, offsets)
    at = np.flatnonzero(has)
    doc = np.searchsorted(first, at, side="right") - 1
    return P.span_hashes(data, left[at], right[at]), doc, at


def _sketch(sites: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Register and rank of each site's hash."""
    h = P.mix(sites ^ U64(0xA5A5A5A55A5A5A5A))
    rest = h >> U64(PRECISION)
    # place of the lowest one bit, from 1
    low = rest & (~rest + U64(1))
    rank = np.bitwise_count(low - U64(1)) + 1
    return (h & U64((1 << PRECISION) - 1)).astype(np.uint8), np.minimum(rank, 64 - PRECISION + 1).astype(np.uint8)


def _send(batch: int, buckets: int, keys: np.ndarray, values: np.ndarray):
    cuts = P.bucket_cuts(keys, buckets)
    for b in np.flatnonzero(np.diff(cuts)):
        lo, hi = cuts[b], cuts[b + 1]
        yield {"bucket": int(b), "batch": batch, "keys": P.pack_sorted(keys[lo:hi]), "values": np.ascontiguousarray(values[lo:hi]).tobytes()}


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where rows of sorted columns change."""
    new = np.ones(len(columns[0]), bool)
    if len(new):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(new)


def spread_dedup(docs: DataFrame, min_sites: int = 10, band: float = 4.0, text: str = "text", doc_id: str = "doc_id", site: str = "source", carry: list[str] | None = None) -> DataFrame:
    """(doc_id, n_lines, n_removed, kept): each text without its cross-site lines.

    n_lines counts lines with a word; kept is the text's other lines, unchanged, joined by
    newlines.  Columns named in ``carry`` come along in a struct ``carried``.
    """
    spark = docs.sparkSession
    buckets = 2 * P.partitions(spark)
    packed = P.pack_documents(docs, text, doc_id, site, carry)
    names_out = ["doc_id", "n_lines", "n_removed", "kept"] + (["carried"] if carry else [])
    fields = ", ".join(f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in carry or ())
    result = RESULT + (f", carried struct<{fields}>" if carry else "")
    margin = band * 1.04 / math.sqrt(1 << PRECISION) * min_sites

    def send_sketches(stream):
        for table in stream:
            for batch in P.batches(table):
                key, doc, _ = _hashes(batch.data, batch.offsets)
                if not len(key):
                    continue
                register, rank = _sketch(batch.sites)
                site, register, rank = batch.sites[doc], register[doc], rank[doc]
                order = np.lexsort((site, rank, register, key))
                order = order[_starts(key[order], register[order], rank[order], site[order])]
                k, g, r = key[order], register[order], rank[order]
                at = _starts(k, g)
                ends = np.append(at[1:], len(k))
                sites = np.minimum(ends - at, 255).astype(np.uint8)
                rows = list(_send(batch.batch, buckets, k[at], np.stack((g[at], r[ends - 1], sites), axis=1)))
                yield pa.RecordBatch.from_pylist(rows, schema=_SENT_ARROW)

    def merge(table: pa.Table) -> pa.Table:
        sent = table.to_pylist()
        keys = [P.unpack_sorted(r["keys"]) for r in sent]
        key = np.concatenate(keys)
        values = np.concatenate([np.frombuffer(r["values"], np.uint8).reshape(-1, 3) for r in sent])
        order = np.lexsort((values[:, 1], values[:, 0], key))
        k, g, r = key[order], values[order, 0], values[order, 1]
        # the sites of all batches, shared ones counted again: never less than the sites; 255 stands for any number
        seen = np.where(values[order, 2] == 255, min_sites, values[order, 2].astype(np.int64))
        seen = np.add.reduceat(seen, _starts(k))
        at = _starts(k, g)
        k, r = k[at], r[np.append(at[1:], len(key)) - 1].astype(np.float64)
        at = _starts(k)
        used = np.diff(np.append(at, len(k)))
        zeros = (1 << PRECISION) - used
        guess = estimate(zeros, zeros + np.add.reduceat(np.exp2(-r), at))
        names = k[at]
        sure, near = names[guess >= min_sites + margin], names[(guess < min_sites + margin) & (seen >= min_sites)]
        return _answer(sent, keys, ((_SURE, sure), (_NEAR, near)))

    def _answer(sent, keys, kinds) -> pa.Table:
        out = []
        for row, mine in zip(sent, keys, strict=True):
            mine = mine[_starts(mine)]
            for kind, names in kinds:
                got = np.intersect1d(mine, names, assume_unique=True)
                if len(got):
                    out.append({"batch": row["batch"], "bucket": row["bucket"], "kind": kind, "keys": P.pack_sorted(got), "values": b""})
        return pa.Table.from_pylist(out, schema=_REPLY_ARROW)

    def _named(replies: list[dict], kind: int) -> np.ndarray:
        parts = [P.unpack_sorted(r["keys"]) for r in sorted(replies, key=lambda r: r["bucket"]) if r["kind"] == kind]
        return np.unique(np.concatenate(parts)) if parts else np.zeros(0, U64)

    def send_pairs(left: pa.Table, right: pa.Table) -> pa.Table:
        """For lines that may go: each one's least (id, line) here, and near the threshold its sites."""
        replies, out = right.to_pylist(), []
        sure, near = _named(replies, _SURE), _named(replies, _NEAR)
        names = np.union1d(sure, near)
        if len(names):
            for batch in P.batches(left):
                key, doc, _ = _hashes(batch.data, batch.offsets)
                mine = np.isin(key, names)
                key, doc = key[mine], doc[mine]
                ids, sites = batch.ids[doc], np.where(np.isin(key, near), batch.sites[doc], U64(0))
                order = np.lexsort((ids, sites, key))
                k, s, i = key[order], sites[order], ids[order]
                at = _starts(k, s)
                values = np.stack((s[at], i[at].view(U64)), axis=1)
                out += _send(batch.batch, buckets, k[at], values)
        return pa.Table.from_pylist(out, schema=_SENT_ARROW)

    def settle(table: pa.Table) -> pa.Table:
        """Lines to remove, each with the least id of all batches; site 0 marks those already sure."""
        sent = table.to_pylist()
        keys = [P.unpack_sorted(r["keys"]) for r in sent]
        key = np.concatenate(keys)
        values = np.concatenate([np.frombuffer(r["values"], U64).reshape(-1, 2) for r in sent])
        order = np.lexsort((values[:, 0], key))
        k, s = key[order], values[order, 0]
        ids = np.ascontiguousarray(values[order, 1]).view(np.int64)
        at = _starts(k)
        sites = np.add.reduceat((np.bincount(_starts(k, s), minlength=len(k)) > 0).astype(np.int64), at)
        certain = s[at] == 0
        go = certain | (sites >= min_sites)
        names, least = k[at][go], np.minimum.reduceat(ids, at)[go]
        out = []
        for row, mine in zip(sent, keys, strict=True):
            mine = mine[_starts(mine)]
            slot = np.searchsorted(names, mine)
            slot[slot == len(names)] = 0
            hit = names[slot] == mine if len(names) else np.zeros(len(mine), bool)
            if hit.any():
                out.append({"batch": row["batch"], "bucket": row["bucket"], "kind": _SURE, "keys": P.pack_sorted(mine[hit]), "values": least[slot[hit]].tobytes()})
        return pa.Table.from_pylist(out, schema=_REPLY_ARROW)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        replies = sorted(right.to_pylist(), key=lambda r: r["bucket"])
        names = np.concatenate([P.unpack_sorted(r["keys"]) for r in replies]) if replies else np.zeros(0, U64)
        least = np.concatenate([np.frombuffer(r["values"], np.int64) for r in replies]) if replies else np.zeros(0, np.int64)
        tables = []
        for batch in P.batches(left):
            data, offsets = batch.data, batch.offsets
            starts, ends, first, lo, hi, has = _lines(data, offsets)
            at = np.flatnonzero(has)
            key = P.span_hashes(data, lo[at], hi[at])
            doc = np.searchsorted(first, at, side="right") - 1
            gone = np.zeros(len(starts), bool)
            if len(names):
                slot = np.searchsorted(names, key)
                slot[slot == len(names)] = 0
                hit = names[slot] == key
                # the first occurrence is the first such line of the document with the least id
                order = np.lexsort((at, doc, key))
                opens = np.zeros(len(at), bool)
                opens[order[_starts(key[order], doc[order])]] = True
                gone[at] = hit & ~(opens & (batch.ids[doc] == least[slot]))
            n = len(batch.ids)
            lost = np.bincount(np.searchsorted(first, np.flatnonzero(gone), side="right") - 1, minlength=n)
            n_lines = np.bincount(doc, minlength=n)
            kept, raw = [], data.tobytes()
            for i in range(n):
                a, b = int(offsets[i]), int(offsets[i + 1])
                if lost[i]:
                    f, l = int(first[i]), int(first[i + 1])
                    keep = np.flatnonzero(~gone[f:l]) + f
                    kept.append(b"\n".join([raw[x:y] for x, y in zip(starts[keep].tolist(), ends[keep].tolist(), strict=True)]))
                else:
                    kept.append(raw[a:b])
            tables.append(pa.table([batch.id_column(), pa.array(n_lines.astype(np.int64)), pa.array(lost.astype(np.int64)), pa.array(kept, pa.binary()).cast(pa.string()), *([pa.StructArray.from_arrays(batch.extra.columns, carry)] if carry else [])], names=names_out))
        return pa.concat_tables(tables)

    sketches = packed.mapInArrow(send_sketches, _SENT)
    merged = sketches.groupBy("bucket").applyInArrow(merge, _REPLY)
    pairs = packed.groupBy("batch").cogroup(merged.groupBy("batch")).applyInArrow(send_pairs, _SENT)
    settled = pairs.groupBy("bucket").applyInArrow(settle, _REPLY)
    return packed.groupBy("batch").cogroup(settled.groupBy("batch")).applyInArrow(finish, result)
