"""Sets of word shingles, and the exact links between the sets of candidate groups.

A candidate group is any set of texts that holds both ends of each link to be found.  All its
pairs are settled on the whole sets, in blocks of bounded size:

1. A group of one block is compared at once.  A larger one is dealt into blocks by a hash, each
   compared within itself; sets of one part are then stood for by one of them, and what is left
   is dealt again, as long as that shrinks the group by a third.  A dense group of any size
   takes a few rounds of a fixed number of comparisons a member.
2. Where a group still has several parts, its largest part and the rest are dealt into blocks,
   and each block of the rest meets each block of the group.  Only this sweep of what nothing
   linked can cost a block pair for each two blocks, and then a set is sent once a block.

A block pair counts its intersections shingle by shingle: rare shingles by their pairs, common
ones by matrix products over slices of the vocabulary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import packed as P

U64 = np.uint64

#: Sets, and hashes of sets, of a block; a larger single set is a block of its own.
BLOCK, BLOCK_HASHES = 512, 1 << 20

#: A shingle of this many sets of a block or fewer is counted by its pairs, one of more by matrix products.
RARE = 32


def shingle_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each text, one after another, and the n+1 cuts between texts."""
    w = P.Words(*P.utf8(texts), lower=True)
    counts, owners, hashes = w.counts(), w.doc_of(), w.hashes()
    pos, made = P.rolling(hashes, w.first, words)
    owner = [owners[pos]]
    made = [made]
    for n in np.unique(counts[(counts > 0) & (counts < words)]):
        pos, short = P.rolling(hashes, w.first, int(n))
        mine = counts[owners[pos]] == n
        owner.append(owners[pos][mine])
        made.append(short[mine])
    owner, made = np.concatenate(owner), np.concatenate(made)
    order = np.lexsort((made, owner))
    owner, made = owner[order], made[order]
    new = np.ones(len(made), bool)
    new[1:] = (made[1:] != made[:-1]) | (owner[1:] != owner[:-1])
    return made[new], np.searchsorted(owner[new], np.arange(len(counts) + 1))


def set_ids(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """A 64-bit id of each set."""
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(P.mix(hashes + U64(P.MULT_A)), dtype=U64)))
    return P.mix(sums[cuts[1:]] - sums[cuts[:-1]] + np.diff(cuts).astype(U64))


def whole_sets(texts: DataFrame, words: int) -> DataFrame:
    """(sid, n, members) of (text): id, size and the sorted hashes of each text's set."""
    schema = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("members", pa.binary())])

    def run(stream):
        for batch in stream:
            for part in P.pieces(batch, "text"):
                hashes, cuts = shingle_sets(part.column("text"), words)
                packed = [hashes[a:b].astype("<u8").tobytes() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(hashes, cuts).view(np.int64)), pa.array(np.diff(cuts).astype(np.int64)), pa.array(packed, pa.binary())], schema=schema)

    return texts.mapInArrow(run, "sid long, n long, members binary")


def overlaps(members: list[np.ndarray]) -> np.ndarray:
    """The sizes of all pairwise intersections of sets of distinct hashes."""
    m = len(members)
    out = np.zeros(m * m, np.int64)
    owner = np.repeat(np.arange(m), [len(x) for x in members])
    hashes = np.concatenate([*members, np.zeros(0, U64)])
    order = np.argsort(hashes, kind="stable")
    hashes, owner = hashes[order], owner[order]
    at = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(at, len(hashes)))
    for c in np.unique(sizes[(sizes > 1) & (sizes <= RARE)]).tolist():
        i, j = np.triu_indices(c, 1)
        first = at[sizes == c]
        step = max(1, (1 << 20) // len(i))
        for k in range(0, len(first), step):
            rows = owner[first[k : k + step, None] + np.arange(c)]
            out += np.bincount((rows[:, i] * m + rows[:, j]).reshape(-1), minlength=m * m)
    out = out.reshape(m, m)
    common = np.flatnonzero(sizes > RARE)
    for k in range(0, len(common), 2048):
        mine = common[k : k + 2048]
        grid = np.zeros((m, len(mine)), np.float32)
        column = np.repeat(np.arange(len(mine)), sizes[mine])
        place = np.repeat(at[mine] - np.concatenate(([0], np.cumsum(sizes[mine])[:-1])), sizes[mine]) + np.arange(len(column))
        grid[owner[place], column] = 1
        out += np.triu(grid @ grid.T, 1).astype(np.int64)
    return out


def forest(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray) -> np.ndarray:
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


def _compared(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """(a, b): the roots that links join, among rows (*keys, sid, root, side, members); sides differ where both are given."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("sid")  # a repeated task gives the same rows
        members = [np.frombuffer(x.as_buffer(), "<u8") for x in table.column("members")]
        roots, root = np.unique(table.column("root").to_numpy(), return_inverse=True)
        side = table.column("side").to_numpy()
        n = np.array([len(x) for x in members], np.int64)
        both = overlaps(members)
        i, j = np.nonzero(both)
        both = both[i, j]
        apart = (root[i] != root[j]) & ((side[i] != side[j]) | (side[i] < 0)) & (100 * both >= percent * (n[i] + n[j] - both))
        label = forest(len(roots), root[i[apart]], root[j[apart]], np.arange(len(roots)))
        joined = np.flatnonzero(label != np.arange(len(roots)))
        return pa.table({"a": pa.array(roots[joined], pa.int64()), "b": pa.array(roots[label[joined]], pa.int64())})

    return rows.groupBy(*keys).applyInArrow(run, "a long, b long")


def _blocks(rows: DataFrame, by: list[str]) -> DataFrame:
    """(*by, blocks): how many blocks the rows (sid, n) of each group need."""
    need = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_HASHES))
    return rows.groupBy(*by).agg(F.greatest(need, F.lit(1)).cast("int").alias("blocks"), F.count(F.lit(1)).alias("sets"))


def linked_parts(groups: DataFrame, sets: DataFrame, percent: int, folder: str) -> DataFrame:
    """(node, component) of the sets that links of 100 * |both| >= percent * |either| join, directly or not.

    ``groups`` has rows (key, sid), one for each set of a candidate group, and ``sets`` rows (sid, n, members).
    Nodes without a link are absent.
    """
    everything = P.saved(groups.join(sets.select("sid", "n"), "sid").select("key", "sid", "n", F.col("sid").alias("root")), f"{folder}/members")
    live, links, parts, turn = everything, [], None, 0
    while True:
        sizes = P.saved(_blocks(live, ["key"]), f"{folder}/sizes-{turn}")
        dealt = live.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("sid", F.lit(turn)), F.col("blocks")).cast("int"))
        rows = dealt.join(sets.select("sid", "members"), "sid").select("key", "block", "sid", "root", F.lit(-1).alias("side"), "members")
        links.append(P.saved(_compared(rows, ["key", "block"], percent), f"{folder}/links-{turn}"))
        large = sizes.where("blocks > 1").select("key", "sets")
        parts = _parts(links, f"{folder}/parts-{turn}")
        if large.isEmpty():
            if turn == 0:
                return parts
            break  # only the sets that stand for their parts were compared: the others still meet in the sweep
        left = P.saved(live.join(large, "key").join(parts.withColumnRenamed("node", "sid"), "sid", "left").where("component IS NULL OR component = sid").select("key", "sid", "n", "root", "sets"), f"{folder}/left-{turn}")
        shrunk = left.groupBy("key").agg(F.count(F.lit(1)).alias("now"), F.max("sets").alias("sets")).where("3 * now <= 2 * sets").select("key")
        live, turn = P.saved(left.join(shrunk, "key", "left_semi").drop("sets"), f"{folder}/live-{turn}"), turn + 1
        if live.isEmpty():
            break
    return _swept(everything, _blocks(everything, ["key"]).where("blocks > 1").select("key"), sets, links, parts, percent, folder)


def _parts(links: list[DataFrame], uri: str) -> DataFrame:
    found = links[0]
    for more in links[1:]:
        found = found.unionAll(more)
    return P.saved(connected_components(found), uri)


def _swept(everything: DataFrame, large: DataFrame, sets: DataFrame, links: list[DataFrame], parts: DataFrame, percent: int, folder: str) -> DataFrame:
    """The parts after all pairs of different parts in large groups have been compared."""
    rooted = everything.join(large, "key", "left_semi").join(parts.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", "n", F.coalesce("component", "sid").alias("root"))
    counted = P.saved(rooted, f"{folder}/rooted").groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    biggest = counted.groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", F.col("top.root").alias("top"))
    open_ = P.saved(rooted.sparkSession.read.schema(rooted.schema).parquet(f"{folder}/rooted").join(biggest, "key").withColumn("rest", F.col("root") != F.col("top")).drop("top"), f"{folder}/open")
    if open_.isEmpty():
        return parts
    needs = _blocks(open_, ["key", "rest"]).groupBy("key").agg(F.max(F.when(F.col("rest"), F.col("blocks"))).alias("rests"), F.max(F.when(~F.col("rest"), F.col("blocks"))).alias("tops"))
    # blocks 0 .. rests - 1 hold the rest, those from there on the largest part; a row goes wherever its block meets one of the rest
    dealt = open_.join(needs, "key").withColumn("block", F.when(F.col("rest"), F.pmod(F.xxhash64("sid"), F.col("rests"))).otherwise(F.col("rests") + F.pmod(F.xxhash64("sid"), F.col("tops"))).cast("int"))
    others = F.sequence(F.lit(0), F.when(F.col("rest"), F.col("rests") + F.col("tops") - 1).otherwise(F.col("rests") - 1))
    pairs = dealt.join(sets.select("sid", "members"), "sid").withColumn("other", F.explode(others))
    side = F.when(F.col("block") == F.col("other"), F.lit(-1)).otherwise(F.col("block"))
    rows = pairs.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "sid", "root", side.alias("side"), "members")
    return _parts([*links, P.saved(_compared(rows, ["key", "low", "high"], percent), f"{folder}/links-swept")], f"{folder}/parts-swept")
