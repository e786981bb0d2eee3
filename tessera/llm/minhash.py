"""Near-duplicate components by min-max hashing.

1. A text is the set of its five-word shingles.  Every permutation is evaluated once per shingle
   and keeps two values of the set, its least and its greatest, so SLOTS values of a signature
   take half as many evaluations.
2. ROWS values make a band; sets that share a band's values meet in a bucket.  Two sets of
   similarity J share some of the BANDS bands with chance 1 - (1 - J^ROWS)^BANDS: at 0.85 all but
   6 in 10^9 pairs do.  In a bucket those are candidates whose signatures, one bit a value, differ
   in at most LIMIT of 240 bits (at 0.85 the mean is 18 and the limit 6 standard deviations above it).
   A bucket answers with a spanning forest.  Values that over HOT documents of a batch share are
   sent once a batch, and their whole bucket is one candidate group.
3. Candidates form groups, and every link in them is confirmed or refused on the whole sets
   (``shingles.linked_parts``).

Equal sets are one set to all of this: a group of copies is one entry a batch.

Edge cases: null texts and texts without words have no shingle, link with nothing and are kept; a
text of fewer words than a shingle is one shingle; a very long text is one set, worked on whole;
a null doc_id belongs to its component but never names it, and is kept only where no id is; equal
ids are separate rows; an empty table gives no rows; other columns are ignored, whatever their names.
Sets are told apart by 64-bit ids: of N distinct sets two share one with chance N^2 / 2^65.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import packed as P
from . import shingles as S

U64 = np.uint64

BANDS, ROWS = 40, 6
SLOTS = BANDS * ROWS

#: Bits of 240 in which candidates may differ.
LIMIT = 44

#: Documents of a batch that share a band's values, beyond which they are sent as one.
HOT = 256

_SEEDS = P.mix(np.arange(1, SLOTS + 1, dtype=U64) * U64(P.MULT_A))


def signatures(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """SLOTS values of each set: the least and the greatest of each permutation, side by side."""
    sizes = np.diff(cuts)
    out = np.zeros((len(sizes), SLOTS), U64)
    full = np.flatnonzero(sizes)
    ends = cuts[1:][full]
    i = 0
    while i < len(full):  # sets of about 32,768 hashes at a time stay in the cache
        lo = cuts[full[i]]
        j = max(i + 1, int(np.searchsorted(ends, lo + (1 << 15), side="right")))
        x, at, mine = hashes[lo : ends[j - 1]], cuts[full[i:j]] - lo, full[i:j]
        for k in range(SLOTS // 2):
            y = (x ^ _SEEDS[2 * k]) * (_SEEDS[2 * k + 1] | U64(1))
            out[mine, 2 * k] = np.minimum.reduceat(y, at)
            out[mine, 2 * k + 1] = np.maximum.reduceat(y, at)
        i = j
    return out


def bands(signature: np.ndarray) -> np.ndarray:
    """A hash of each band's values."""
    rows = signature.reshape(len(signature), BANDS, ROWS)
    out = np.zeros((len(signature), BANDS), U64) + np.arange(BANDS, dtype=U64)
    for r in range(ROWS):
        out = P.mix(out * U64(P.MULT_B) + rows[:, :, r])
    return out


def bits(signature: np.ndarray) -> np.ndarray:
    """One bit a value, as four words."""
    flags = np.zeros((len(signature), 256), np.uint8)
    flags[:, :SLOTS] = (P.mix(signature) & U64(1)).astype(np.uint8)
    return np.packbits(flags, axis=1, bitorder="little").view("<u8").astype(U64)


def signed(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, n, sid, bands, bits) of (doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("bands", pa.binary()), ("bits", pa.binary())])

    def run(stream):
        for batch in stream:
            for part in P.pieces(batch, "text"):
                hashes, cuts = S.shingle_sets(part.column("text"), words)
                made = signatures(hashes, cuts)
                n = np.diff(cuts).astype(np.int64)
                packed = ([x.tobytes() if size else None for x, size in zip(f(made).astype("<u8"), n.tolist(), strict=True)] for f in (bands, bits))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(S.set_ids(hashes, cuts).view(np.int64)), *(pa.array(x, pa.binary()) for x in packed)], schema=schema)

    return rows.mapInArrow(run, "doc_id long, n long, sid long, bands binary, bits binary")


def run_links(sketches: np.ndarray, limit: int) -> np.ndarray:
    """Labels of some sketches under links within the limit: the first member of each component."""
    label, left = np.full(len(sketches), -1), np.arange(len(sketches))
    while len(left):
        first, todo, left = left[0], [left[0]], left[1:]
        label[first] = first
        while todo and len(left):
            near = np.bitwise_count(sketches[left] ^ sketches[todo.pop()]).sum(axis=1, dtype=np.int64) <= limit
            label[left[near]] = first
            todo += left[near].tolist()
            left = left[~near]
    return label


def bucket_links(values: np.ndarray, sids: np.ndarray, sketches: np.ndarray, hot: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the candidates of one band: pairs of sids."""
    order = np.lexsort((~hot, sids, values))
    values, sids, sketches, hot = values[order], sids[order], sketches[order], hot[order]
    new = np.append(True, (values[1:] != values[:-1]) | (sids[1:] != sids[:-1]))  # a set once
    values, sids, sketches, hot = values[new], sids[new], sketches[new], hot[new]
    start = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    size = np.diff(np.append(start, len(values)))
    run = np.repeat(np.arange(len(start)), size)
    many = np.maximum.reduceat(hot.astype(np.int8), start) > 0
    lead = start[run]
    apart = np.bitwise_count(sketches ^ sketches[lead]).sum(axis=1, dtype=np.int64)
    near = (apart <= limit) | many[run]
    far = np.add.reduceat((~near).astype(np.int64), start)
    tie = near & (lead != np.arange(len(lead))) & ((far == 0) | (size == 2))[run]
    a, b = [sids[lead[tie]]], [sids[tie]]
    for k in np.flatnonzero((far > 0) & (size > 2)).tolist():
        mine = slice(start[k], start[k] + size[k])
        label = run_links(sketches[mine], limit)
        tied = np.flatnonzero(label != np.arange(size[k]))
        a.append(sids[mine][label[tied]])
        b.append(sids[mine][tied])
    return np.concatenate(a), np.concatenate(b)


def candidate_links(sets: DataFrame) -> DataFrame:
    """(a, b): candidate pairs of (sid, bands, bits) that join all candidates."""
    buckets = max(1, 4 * P.partitions(sets.sparkSession) // BANDS)
    schema = pa.schema([("slot", pa.int32()), ("values", pa.binary()), ("sids", pa.binary()), ("bits", pa.binary()), ("hot", pa.binary())])

    def dealt(rows: pa.Table) -> pa.RecordBatch:
        sids, first = np.unique(rows.column("sid").to_numpy(), return_index=True)
        keys = np.frombuffer(b"".join(rows.column("bands").to_pylist()), "<u8").reshape(-1, BANDS)[first]
        sketches = np.frombuffer(b"".join(rows.column("bits").to_pylist()), "<u8").reshape(-1, 4)[first]
        out: dict[str, list] = {n: [] for n in schema.names}

        def put(*row):
            for name, value in zip(schema.names, row, strict=True):
                out[name].append(value)

        for band in range(BANDS):
            order = np.argsort(keys[:, band], kind="stable")
            v = keys[order, band]
            start = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            size = np.diff(np.append(start, len(v)))
            for k in np.flatnonzero(size > HOT).tolist():
                mine = order[start[k] : start[k] + size[k]]
                put(BANDS * buckets + int(v[start[k]] % U64(buckets)), np.full(len(mine) - 1, sids[mine[0]]).tobytes(), sids[mine[1:]].tobytes(), b"", b"")
            many = np.repeat(size > HOT, size)
            stay = ~many
            stay[start] = True
            order, v, many = order[stay], v[stay], many[stay]
            cuts = P.bucket_cuts(v, buckets)
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                mine = slice(cuts[k], cuts[k + 1])
                put(band * buckets + k, v[mine].tobytes(), sids[order[mine]].tobytes(), sketches[order[mine]].tobytes(), many[mine].tobytes())
        return pa.RecordBatch.from_pydict(out, schema=schema)

    def deal(stream):
        held, n = [], 0
        for rows in stream:
            held.append(rows)
            n += rows.num_rows
            if n >= 1 << 16:
                yield dealt(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield dealt(pa.Table.from_batches(held))

    def search(table: pa.Table) -> pa.Table:
        v, sids, sketches, hot = (np.frombuffer(b"".join(table.column(c).to_pylist()), kind) for c, kind in (("values", "<u8"), ("sids", "<i8"), ("bits", "<u8"), ("hot", bool)))
        if table.column("slot")[0].as_py() >= BANDS * buckets:
            a, b = v.view(np.int64), sids
        else:
            a, b = bucket_links(v, sids, sketches.reshape(-1, 4), hot)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    packed = sets.select("sid", "bands", "bits").mapInArrow(deal, "slot int, values binary, sids binary, bits binary, hot binary")
    return packed.groupBy("slot").applyInArrow(search, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 85, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the smallest doc_id that links reach from each document, as the module says.

    The bands are laid out for ``percent`` of 85 or more.
    """
    if percent < 85:
        raise ValueError("the bands find pairs of a similarity of 85 percent or more")
    spark = docs.sparkSession
    folder = P.scratch(spark, "minhash")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    with P.fleeting_shuffles(spark):
        marked = P.saved(signed(rows, words), f"{folder}/signed")
        worded = marked.where("n > 0")
        links = P.saved(candidate_links(worded), f"{folder}/links")
        groups = P.saved(connected_components(links).select(F.col("component").alias("key"), F.col("node").alias("sid")), f"{folder}/groups")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id")).alias("first")
        one = P.saved(worded.groupBy("sid").agg(first).select("sid", "first.no_id", "first.doc_id"), f"{folder}/one")
        ids = one.join(groups, "sid", "left_semi").select(F.col("doc_id").alias("id")).distinct()
        texts = rows.join(ids.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")), "left_semi").select("text")
        sets = P.saved(S.whole_sets(texts, words).join(groups, "sid", "left_semi").dropDuplicates(["sid"]), f"{folder}/sets")
        parts = S.linked_parts(groups, sets, percent, f"{folder}/parts")
        rooted = one.join(parts, one.sid == parts.node, "left").select("sid", "doc_id", F.coalesce("component", "sid").alias("root"))
        named = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        by_sid = P.saved(rooted.join(named, "root").select(F.col("sid").alias("of"), "component_id"), f"{folder}/by-sid")
    found = worded.join(by_sid, worded.sid == by_sid["of"]).select("doc_id", "n", "component_id")
    alone = marked.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"))
    return found.unionAll(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
