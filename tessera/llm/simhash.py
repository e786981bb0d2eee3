"""SimHash fingerprints and their near-duplicate components.

Links are found among distinct fingerprints only, by a Gray-order hierarchical index:

1. By the pigeonhole rule two fingerprints that differ in at most d bits agree on some
   m - d of m bit blocks.  Each choice of m - d blocks is a table; a fingerprint goes,
   per table, to the bucket of its chosen bits.
2. In a bucket the bits are arranged with the chosen blocks leading, and the fingerprints
   are sorted by Gray rank, which keeps those that share bits together.  Groups of eight
   make a node whose shared bits (mask and pattern) are factored out; eight nodes make
   the next level.  A node stores only what its parent does not share already.
3. All queries descend together.  The differences found on a node's own bits add up, and a
   whole group is pruned once they pass d (a difference in the leading bits prunes at
   once, as another table answers for that pair).  A group whose free bits can no longer
   exceed d is taken whole, and a group known to be in the query's component is left out,
   so a dense cluster costs nearly linear time.

A bucket answers with a spanning forest, never with all pairs, and the forests are
joined by connected components.  Equal fingerprints meet by pre-aggregation, so a group
of copies is one fingerprint to the index whatever its size.

Edge cases: a null text has no words; no words give fingerprint 0, which links like any
other; one or two words are one shingle; a null doc_id belongs to its component but never
names it; equal ids and repeated rows are separate rows, equal texts have equal results; a very
long text is hashed in slices of 32,768 shingles; an empty table gives no rows; other columns
are ignored, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import packed as P

SEED = 42
FAN = 8
U64 = np.uint64

#: Block counts by the number of distinct fingerprints: more blocks, longer keys, more tables.
PLANS = ((1 << 26, 4), (1 << 32, 5), (1 << 64, 6))


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """Majority bits of the XXH64 of the word shingles of a text, A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(starts), 1 << 15):
        pairs = zip(starts[k : k + (1 << 15)].tolist(), ends[k : k + (1 << 15)].tolist(), strict=True)
        h = np.array([digest(joined[a:b], SEED) for a, b in pairs], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", shingle: int = 3) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long."""

    def run(stream):
        for rows in stream:
            for part in P.pieces(rows, "text"):
                data, offsets = P.utf8(part.column("text"))
                data = data.tobytes()
                made = [fingerprint(data[a:b], shingle) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.array(made, U64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


# ------------------------------------------------------------------ the index


def arrange(values: np.ndarray, widths: list[int], chosen: tuple[int, ...]) -> tuple[np.ndarray, int]:
    """The values with the chosen bit blocks leading, and the number of leading bits."""
    lows = [sum(widths[i + 1 :]) for i in range(len(widths))]
    out = np.zeros(len(values), U64)
    for i in [*chosen, *(i for i in range(len(widths)) if i not in chosen)]:
        out = out << U64(widths[i]) | (values >> U64(lows[i])) & U64((1 << widths[i]) - 1)
    return out, sum(widths[i] for i in chosen)


def gray_rank(values: np.ndarray) -> np.ndarray:
    """The place of each value in the Gray code sequence."""
    out = values.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> U64(s)
    return out


def _forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Labels after uniting a[i] with b[i]: the least member of each component."""
    while True:
        la, lb = label[a], label[b]
        differ = la != lb
        if not differ.any():
            return label
        a, b, la, lb = a[differ], b[differ], la[differ], lb[differ]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


class GrayIndex:
    """The hierarchy over fingerprints sorted by Gray rank."""

    def __init__(self, values: np.ndarray):
        self.levels = []  # from the leaves up: (and, or) of each group
        both, either = values, values
        while True:
            self.levels.append((both, either))
            if len(both) <= FAN:
                break
            at = np.arange(0, len(both), FAN)
            both, either = np.bitwise_and.reduceat(both, at), np.bitwise_or.reduceat(either, at)
        self.nodes = []  # from the top down: pattern, own mask, free bits
        above = np.zeros(1, U64)
        for depth, (both, either) in enumerate(reversed(self.levels)):
            shared = ~(both ^ either)
            parents = above[np.arange(len(both)) // FAN] if depth else np.zeros(len(both), U64)
            self.nodes.append((both, shared & ~parents, np.bitwise_count(~shared).astype(np.int64)))
            above = shared

    def members(self, depth: int) -> int:
        """How many leaves a node of this depth holds at most."""
        return FAN ** (len(self.nodes) - 1 - depth)


def link(values: np.ndarray, lead: int, distance: int, accept=None, block: int = 1024, most: int = 1 << 21) -> np.ndarray:
    """Component labels (indices) of Gray-sorted values under links within the distance
    that agree on the leading bits; pairs that do not are another table's.

    With ``accept``, a function of two index arrays, only the pairs that it takes are links.
    """
    n = len(values)
    label = np.arange(n)
    index = GrayIndex(values)
    leading = ~U64(0) << U64(64 - lead) if lead else U64(0)
    deepest = len(index.nodes) - 1
    uniform: list[np.ndarray] = []

    def refresh():
        """Per node the component that all its leaves are in, or -1."""
        uniform.clear()
        low = high = label
        out = [label]
        for _ in range(deepest):
            at = np.arange(0, len(low), FAN)
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            out.append(np.where(low == high, low, -1))
        uniform.extend(reversed(out))

    a, b = _near_groups(index, distance) if accept is None else ((), ())
    if len(a):
        label = _forest(n, a, b, label)
    refresh()
    todo = [(i, min(i + block, n)) for i in range(0, n, block)][::-1]
    while todo:
        lo, hi = todo.pop()
        queries = np.arange(lo, hi)
        top = len(index.nodes[0][0])
        q, node = np.repeat(queries, top), np.tile(np.arange(top), len(queries))
        acc = np.zeros(len(q), np.int64)
        found_a, found_b = [], []
        for depth in range(deepest + 1):
            pattern, own, free = index.nodes[depth]
            size = index.members(depth)
            keep = (node + 1) * size - 1 > q  # each pair once, by its first member
            same = uniform[depth][node]
            keep &= same != label[q]
            q, node, acc = q[keep], node[keep], acc[keep]
            diff = (values[q] ^ pattern[node]) & own[node]
            acc = acc + np.bitwise_count(diff)
            keep = (acc <= distance) & (diff & leading == 0)
            q, node, acc = q[keep], node[keep], acc[keep]
            whole = (acc + free[node] <= distance) & (node * size > q)
            if accept is not None:
                if depth == deepest and len(q):
                    taken = accept(q, node)
                    found_a.append(q[taken])
                    found_b.append(node[taken])
            elif whole.any():  # every leaf is near, and so near to the others
                first = node[whole] * size
                found_a.append(q[whole])
                found_b.append(first)
                q, node, acc = q[~whole], node[~whole], acc[~whole]
            if depth == deepest:
                break
            if len(q) * FAN > most and hi - lo > 1:
                found_a = None
                break
            below = len(index.nodes[depth + 1][0])
            q, acc = np.repeat(q, FAN), np.repeat(acc, FAN)
            node = (node[:, None] * FAN + np.arange(FAN)).reshape(-1)
            there = node < below
            q, node, acc = q[there], node[there], acc[there]
        if found_a is None:  # too many at once: fewer queries
            middle = (lo + hi) // 2
            todo += [(middle, hi), (lo, middle)]
            continue
        if found_a:
            label = _forest(n, np.concatenate(found_a), np.concatenate(found_b), label)
            refresh()
    return label


def _near_groups(index: GrayIndex, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside groups whose free bits cannot exceed the distance."""
    a, b = [], []
    n = len(index.levels[0][0])
    for depth, (_, _, free) in enumerate(index.nodes[:-1]):
        size = index.members(depth)
        for g in np.flatnonzero(free <= distance):
            rest = np.arange(g * size + 1, min((g + 1) * size, n))
            a.append(np.full(len(rest), g * size))
            b.append(rest)
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def links(fps: DataFrame, distance: int = 3, blocks: int | None = None, fp: str = "fp") -> DataFrame:
    """(a, b): a spanning forest of the fingerprints within the distance."""
    spark = fps.sparkSession
    distinct = fps.select(F.col(fp).alias("fp")).where("fp is not null").distinct()
    if blocks is None:
        n = distinct.count()
        blocks = next(m for most, m in PLANS if n <= most)
    widths = [64 // blocks + (i < 64 % blocks) for i in range(blocks)]
    tables = list(combinations(range(blocks), blocks - distance))
    buckets = max(4, P.partitions(spark) // 2)

    def deal(stream):
        for rows in stream:
            v = np.unique(rows.column(0).to_numpy(zero_copy_only=False).view(U64))
            out: dict[str, list] = {"slot": [], "fps": []}
            for t, chosen in enumerate(tables):
                key, lead = arrange(v, widths, chosen)
                b = P.bucket_of(P.mix((key >> U64(64 - lead)) + U64(1)), buckets)
                order = np.argsort(b, kind="stable")
                cuts = np.searchsorted(b[order], np.arange(buckets + 1, dtype=U64))
                for k in np.flatnonzero(np.diff(cuts)):
                    out["slot"].append(t * buckets + int(k))
                    out["fps"].append(P.pack_sorted(v[order[cuts[k] : cuts[k + 1]]]))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("slot", pa.int32()), ("fps", pa.binary())]))

    def search(table: pa.Table) -> pa.Table:
        chosen = tables[table.column("slot")[0].as_py() // buckets]
        v = np.unique(np.concatenate([P.unpack_sorted(x) for x in table.column("fps").to_pylist()]))
        key, lead = arrange(v, widths, chosen)
        order = np.argsort(gray_rank(key), kind="stable")
        label = link(key[order], lead, distance)
        at = np.flatnonzero(label != np.arange(len(label)))
        v = v[order].view(np.int64)
        return pa.table({"a": pa.array(v[at]), "b": pa.array(v[label[at]])})

    return distinct.mapInArrow(deal, "slot int, fps binary").groupBy("slot").applyInArrow(search, "a long, b long")


def word_links(sketches: DataFrame, key: str, words: list[str], limit: int, distance: int = 3, blocks: int = 4) -> DataFrame:
    """(a, b): a spanning forest of the keys whose sketches are alike.

    A sketch is some columns of 64 bits, each two fingerprints of 32.  Two are alike if some
    fingerprint of theirs is within the distance, found by the Gray-order index of that
    fingerprint, and the first 128 bits of the sketches differ in at most ``limit``.  Every
    fingerprint has a table for each choice of blocks; a table's row takes 28 bytes.
    """
    spark = sketches.sparkSession
    widths = [32 // blocks] * blocks
    tables = [(w, chosen) for w in range(2 * len(words)) for chosen in combinations(range(blocks), blocks - distance)]
    buckets = max(4, P.partitions(spark) // 2)
    schema = pa.schema([("slot", pa.int32()), ("names", pa.binary()), ("prints", pa.binary()), ("checks", pa.binary())])

    def dealt(names: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
        out: dict[str, list] = {n: [] for n in schema.names}
        checks = bits.view("<u8")[:, :2]
        for t, (w, chosen) in enumerate(tables):
            value = bits[:, w].astype(U64)
            lead, width = arrange(value, widths, chosen)
            b = P.bucket_of(P.mix((lead >> U64(32 - width)) + U64(1)), buckets)
            order = np.argsort(b, kind="stable")
            cuts = np.searchsorted(b[order], np.arange(buckets + 1, dtype=U64))
            for k in np.flatnonzero(np.diff(cuts)):
                mine = order[cuts[k] : cuts[k + 1]]
                for name, value in (("slot", t * buckets + int(k)), ("names", names[mine].tobytes()), ("prints", bits[mine, w].tobytes()), ("checks", checks[mine].tobytes())):
                    out[name].append(value)
        return pa.RecordBatch.from_pydict(out, schema=schema)

    def deal(stream):
        held, n = [], 0
        for rows in stream:
            held.append(rows)
            n += rows.num_rows
            if n >= 1 << 16:
                yield dealt(*_sketch_arrays(held))
                held, n = [], 0
        if n:
            yield dealt(*_sketch_arrays(held))

    def search(table: pa.Table) -> pa.Table:
        _, chosen = tables[table.column("slot")[0].as_py() // buckets]
        names = np.frombuffer(b"".join(table.column("names").to_pylist()), "<i8")
        prints = np.frombuffer(b"".join(table.column("prints").to_pylist()), "<u4").astype(U64)
        checks = np.frombuffer(b"".join(table.column("checks").to_pylist()), "<u8").reshape(-1, 2)
        value, lead = arrange(prints, widths, chosen)
        value <<= U64(32)
        order = np.lexsort((names, gray_rank(value)))
        names, checks = names[order], checks[order]

        def accept(a, b):
            return np.bitwise_count(checks[a] ^ checks[b]).sum(axis=1, dtype=np.int64) <= limit

        label = link(value[order], lead, distance, accept)
        # all name the least of their component, so that the tables of one group agree in most pairs
        least = names.copy()
        np.minimum.at(least, label, names)
        at = np.flatnonzero(names != least[label])
        return pa.table({"a": pa.array(names[at], pa.int64()), "b": pa.array(least[label[at]], pa.int64())})

    slim = sketches.select(F.col(key).alias("name"), *words)
    return slim.mapInArrow(deal, "slot int, names binary, prints binary, checks binary").groupBy("slot").applyInArrow(search, "a long, b long").distinct()


def _sketch_arrays(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Names, and a row of 32-bit fingerprints for each."""
    name, *words = pa.Table.from_batches(batches).columns
    return name.to_numpy(), np.stack([w.to_numpy() for w in words], axis=1).astype("<i8").view("<u4")


def near_duplicates(docs: DataFrame, distance: int = 3, shingle: int = 3, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id that links reach from each document."""
    P.ensure_checkpoint_dir(docs.sparkSession)
    prints = fingerprints(docs, text, doc_id, shingle).checkpoint()
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    parts = connected_components(links(prints.select("fp"), distance))
    rooted = first.join(parts, first.fp == parts.node, "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = rooted.join(named, "root").select(F.col("fp").alias("fp_"), "component_id")
    return prints.join(by_fp, prints.fp == by_fp.fp_).select("doc_id", "fp", "component_id")
