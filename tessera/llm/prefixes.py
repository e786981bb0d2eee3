"""The trie of conversation prefixes.

1. Turns become a SHA-256 of role and text and a length; texts travel no further.  They are
   sorted by range over (conversation, turn), so that even one conversation of most rows
   spreads over tasks, and numpy scans give each turn its place and the polynomial rolling
   fingerprint of the prefix that it ends.  A scan's carry is one row a partition.
2. A conversation is rebuilt from the first turns of another one without a new scan: the
   fingerprints of its own later turns are shifted by a power of the base.
3. Prefixes of equal depth and fingerprint are candidates for one node, with the member of
   smallest id as representative.  Each member's last turn and the fingerprint before it are
   held against the representative's: if all agree at every depth, then by induction every
   prefix equals its representative's turn by turn.  Groups that do not agree are split by
   what they hold, and what follows them is held up again, until all do.
4. What a node adds belongs to its representative.  Sums from the end of each path (a second
   scan) tell what a member has at or below each node, and a node sums that over its members.

Edge cases: null turns come first; equal turns of a conversation go by the SHA-256 of role and
text; a null role or text is empty; rows without conv_id are of no conversation and are left
out; repeated rows are further turns; a very long text is one digest and one length; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed as P

U64 = np.uint64

#: Base of the fingerprints, odd and so invertible modulo 2^64.
BASE = 0x9E3779B97F4A7C15

#: Conversations of one block share the first turns of the block's first; a head has HEAD - 1 turns at most.
BLOCK, HEAD = 5, 9

_TURN = ["q0", "q1", "q2", "q3"]
_NODE = ["depth", "fp"]


def power(exponents: np.ndarray, base: int = BASE) -> np.ndarray:
    """base to signed exponents, modulo 2^64."""
    out = np.ones(len(exponents), U64)
    for sign, b in ((exponents > 0, base), (exponents < 0, pow(base, -1, 1 << 64))):
        left = np.abs(np.where(sign, exponents, 0))
        while left.any():
            out[left & 1 == 1] *= U64(b)
            left, b = left >> 1, b * b % (1 << 64)
    return out


def running(rows: DataFrame, key: str, order: list, sums: dict[str, int], folder: str) -> DataFrame:
    """rows with ``pos``, their place among the rows of their key, and for each column c of ``sums``
    the sums ``c_before`` and ``c_after`` of c * base^place up to them, modulo 2^64.

    Rows are sorted by range over key and order, scanned by partition, and written; a partition's
    last row is all that later partitions need of it.
    """
    spark = rows.sparkSession
    kept = rows.schema.fields
    made = ["pos", *(f"{c}_{x}" for c in sums for x in ("before", "after"))]
    schema = T.StructType([*kept, T.StructField("pid", T.IntegerType()), *(T.StructField(m, T.LongType()) for m in made)])

    def scan(stream):
        context = TaskContext.get()
        pid, last, place, totals = context.partitionId() if context else 0, None, 0, dict.fromkeys(sums, 0)
        for batch in stream:
            if not batch.num_rows:
                continue
            ids = batch.column(key).to_numpy(zero_copy_only=False)
            new = np.ones(len(ids), bool)
            new[1:] = ids[1:] != ids[:-1]
            goes_on = ids[0] == last
            starts = np.flatnonzero(new)
            run = np.cumsum(new) - 1
            pos = np.arange(len(ids)) - starts[run] + np.where(run == 0, place if goes_on else 0, 0)
            out = [pos]
            for c, base in sums.items():
                value = batch.column(c).to_numpy(zero_copy_only=False).view(U64)
                part = value * power(pos, base) if base != 1 else value
                up = np.cumsum(part, dtype=U64)
                into = (up - part)[starts]
                if goes_on:
                    into[:1] -= U64(totals[c])
                after = up - into[run]
                out += [(after - part).view(np.int64), after.view(np.int64)]
                totals[c] = int(after[-1])
            last, place = ids[-1], int(pos[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(ids), pid, np.int32)), *map(pa.array, out)], names=schema.names)

    ranged = rows.repartitionByRange(P.partitions(spark), F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    local = P.saved(ranged.mapInArrow(scan, schema), folder)
    ends = local.groupBy("pid").agg(F.min(key).alias("low"), F.max(key).alias("high"), F.max_by(F.struct(*made), F.struct(key, "pos")).alias("last"))
    carry: dict[int, tuple] = {}  # by partition: the key that goes on in it, its rows and sums so far
    have = None
    for e in sorted(ends.collect(), key=lambda e: e.pid):
        n, *done = (e.last.pos + 1, *(getattr(e.last, f"{c}_after") % (1 << 64) for c in sums))
        if have and have[0] == e.low:
            carry[e.pid] = have
            if e.high == e.low:
                done = [(a + b * pow(base, have[1], 1 << 64)) % (1 << 64) for a, b, base in zip(have[2], done, sums.values(), strict=True)]
                n += have[1]
        have = (e.high, n, done)

    def join_up(stream):
        for batch in stream:
            ids, pids = batch.column(key).to_numpy(zero_copy_only=False), batch.column("pid").to_numpy(zero_copy_only=False)
            columns = {m: batch.column(m).to_numpy(zero_copy_only=False).copy() for m in made}
            for pid in np.unique(pids).tolist():
                if pid in carry:
                    on, n, done = carry[pid]
                    mine = (pids == pid) & (ids == on)
                    columns["pos"][mine] += n
                    for (c, base), total in zip(sums.items(), done, strict=True):
                        for x in (f"{c}_before", f"{c}_after"):
                            columns[x][mine] = (columns[x][mine].view(U64) * U64(pow(base, n, 1 << 64)) + U64(total)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), *(pa.array(columns[m]) for m in made)], names=[f.name for f in joined])

    joined = T.StructType([*kept, *(T.StructField(m, T.LongType()) for m in made)])
    return local.mapInArrow(join_up, joined)


def _turns(conversations: DataFrame, folder: str) -> DataFrame:
    """(conv_id, turn, digest, at, bytes) of every turn; ``at`` only parts repeated rows."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256))
    found = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), digest.alias("digest"), F.monotonically_increasing_id().alias("at"), F.octet_length(text).cast("long").alias("bytes"))
    return P.saved(found.where("conv_id IS NOT NULL"), f"{folder}/turns")


def _quarters(turns: DataFrame) -> DataFrame:
    """The digest as four longs."""

    def run(stream):
        for batch in stream:
            at = batch.schema.get_field_index("digest")
            four = np.frombuffer(b"".join(batch.column(at).to_pylist()), "<i8").reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(batch.columns) if i != at), *(pa.array(np.ascontiguousarray(q)) for q in four.T)], names=schema.names)

    rest = [f for f in turns.schema.fields if f.name != "digest"]
    schema = T.StructType([*rest, *(T.StructField(q, T.LongType()) for q in _TURN)])
    return turns.mapInArrow(run, schema)


def _rebuilt(placed: DataFrame, folder: str, mask: int) -> DataFrame:
    """(conv_id, depth, fp, before, q0..q3, bytes, is_end): every prefix of every rebuilt conversation, the empty one included."""
    head = F.when(F.col("pos") < HEAD - 1, F.struct("pos", F.col("q0_before").alias("before"), F.col("q0_after").alias("after"), *_TURN, "bytes"))
    convs = placed.groupBy("conv_id").agg((F.max("pos") + 1).alias("n"), F.sort_array(F.collect_list(head)).alias("heads"))
    convs = P.saved(convs.select("*", F.expr(f"CAST(crc32(CAST(conv_id AS string)) % {HEAD} AS int)").alias("h"), F.expr(f"conv_id - conv_id % {BLOCK}").alias("base")), f"{folder}/convs")
    bases = convs.select(F.col("conv_id").alias("base"), F.col("heads").alias("base_heads"))
    taken = convs.join(bases, "base", "left").select("conv_id", "n", "h", F.when(F.col("h") > 0, F.expr("try_element_at(heads, h).after")).alias("own"), F.expr("coalesce(slice(base_heads, 1, h), slice(heads, 1, 0))").alias("taken"))
    plans = P.saved(taken.select("conv_id", "h", F.size("taken").alias("hb"), F.coalesce("own", F.lit(0)).alias("own"), F.coalesce(F.expr("try_element_at(taken, -1).after"), F.lit(0)).alias("base"), "taken", (F.size("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("depths")), f"{folder}/plans")
    schema = "conv_id long, depth long, fp long, before long, " + ", ".join(f"{q} long" for q in _TURN) + ", bytes long, is_end boolean"

    def shift(stream):
        for b in stream:
            conv, pos, h, hb, own, base, before, after, depths = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("conv_id", "pos", "h", "hb", "own", "base", "q0_before", "q0_after", "depths"))
            factor = power(hb - h)
            moved = [((base.view(U64) + factor * (x.view(U64) - own.view(U64))) & U64(mask)).view(np.int64) for x in (after, before)]
            depth = pos - h + hb + 1
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (conv, depth, *moved)), *(b.column(c) for c in (*_TURN, "bytes")), pa.array(depth == depths)], names=["conv_id", "depth", "fp", "before", *_TURN, "bytes", "is_end"])

    slim = plans.select("conv_id", "h", "hb", "own", "base", "depths")
    tails = placed.join(slim, "conv_id").where("pos >= h").mapInArrow(shift, schema)
    low = F.lit(mask if mask < 1 << 63 else -1)
    heads = plans.select("conv_id", "depths", F.explode("taken").alias("t")).select("conv_id", (F.col("t.pos") + 1).alias("depth"), F.col("t.after").bitwiseAND(low).alias("fp"), F.col("t.before").bitwiseAND(low).alias("before"), *(f"t.{q}" for q in _TURN), "t.bytes", (F.col("t.pos") + 1 == F.col("depths")).alias("is_end"))
    zero = F.lit(0).cast("long")
    roots = plans.select("conv_id", zero.alias("depth"), zero.alias("fp"), zero.alias("before"), *(zero.alias(q) for q in _TURN), zero.alias("bytes"), (F.col("depths") == 0).alias("is_end"))
    return P.saved(tails.unionAll(heads).unionAll(roots), f"{folder}/prefixes")


def _verified(prefixes: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """(prefixes, nodes) with one node for each (depth, fp): groups that do not agree with their representative are split."""
    turn = 0
    while True:
        held = ["before", *_TURN]
        ends = [f(c).alias(f"{n}_{c}") for c in held for n, f in (("min", F.min), ("max", F.max))]
        groups = P.saved(prefixes.groupBy(*_NODE).agg(F.min("conv_id").alias("rep"), F.count(F.lit(1)).alias("n_convs"), F.max("bytes").alias("bytes"), *ends), f"{folder}/groups-{turn}")
        bad = groups.where(" OR ".join(f"min_{c} <> max_{c}" for c in held)).select(*_NODE, F.lit(True).alias("bad"))
        if bad.isEmpty():
            return prefixes, groups.select(*_NODE, "rep", "n_convs", "bytes", F.col("min_before").alias("before"))
        turn += 1
        named = F.when(F.col("bad"), F.xxhash64(F.lit(turn), "fp", *held)).otherwise(F.col("fp"))
        split = P.saved(prefixes.join(bad, _NODE, "left").withColumn("fp", named).drop("bad"), f"{folder}/split-{turn}")
        above = split.select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("fp").alias("above"))
        prefixes = P.saved(split.join(above, ["conv_id", "depth"], "left").withColumn("before", F.coalesce("above", "before")).drop("above"), f"{folder}/prefixes-{turn}")


def _ends(prefixes: DataFrame) -> DataFrame:
    """(depth, fp, ends_sha256) of the nodes in which conversations end: ids in order, streamed into the digest."""

    def run(stream):
        at, digest = None, None
        for batch in stream:
            out: dict[str, list] = {"depth": [], "fp": [], "ends_sha256": []}
            for depth, fp, conv in zip(*(batch.column(c).to_pylist() for c in ("depth", "fp", "conv_id")), strict=True):
                if (depth, fp) != at:
                    if at:
                        for name, value in zip(out, (*at, digest.hexdigest()), strict=True):
                            out[name].append(value)
                    at, digest = (depth, fp), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
            yield pa.RecordBatch.from_pydict(out, schema=schema)
        if at:
            yield pa.RecordBatch.from_pydict({"depth": [at[0]], "fp": [at[1]], "ends_sha256": [digest.hexdigest()]}, schema=schema)

    schema = pa.schema([("depth", pa.int64()), ("fp", pa.int64()), ("ends_sha256", pa.string())])
    ended = prefixes.where("is_end").select(*_NODE, "conv_id")
    return ended.repartition(P.partitions(prefixes.sparkSession), *_NODE).sortWithinPartitions(*_NODE, "conv_id").mapInArrow(run, "depth long, fp long, ends_sha256 string")


def prefix_trie(conversations: DataFrame, bits: int = 64) -> DataFrame:
    """One row a node of the trie: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``bits`` of the fingerprints are used; fewer only make more splits.  The ids that end in one
    node pass through one task, as a stream.
    """
    spark = conversations.sparkSession
    folder = P.scratch(spark, "prefixes")
    plain = conversations.select(*(F.col(f"`{c}`") for c in ("conv_id", "turn", "role", "text")))
    with P.fleeting_shuffles(spark):
        turns = _quarters(_turns(plain, folder).withColumn("order", F.col("digest")))
        placed = running(turns, "conv_id", [F.col("turn"), F.col("order"), F.col("at")], {"q0": BASE}, f"{folder}/placed").drop("turn", "order", "at")
        prefixes, nodes = _verified(_rebuilt(placed, folder, (1 << bits) - 1), folder)
        children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("before").alias("fp")).agg(F.count(F.lit(1)).alias("n_children"))
        nodes = P.saved(nodes.join(children, _NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), f"{folder}/nodes")
        # nodes of one member save nothing and have one leaf below; only shared ones need sums
        shared = nodes.where("n_convs > 1").select(*_NODE, "rep", ((F.col("n_convs") - 1) * F.col("bytes")).alias("saves"), (F.col("n_children") == 0).alias("leaf"))
        deepest = prefixes.join(shared, _NODE).select("conv_id", *_NODE, F.when(F.col("conv_id") == F.col("rep"), F.col("saves")).otherwise(F.lit(0)).alias("saves"), F.expr("CAST(is_end AND leaf AND conv_id = rep AS long)").alias("leaves"), "is_end")
        # a path that goes on below its last shared node has one leaf of its own there
        last = F.struct("depth", "is_end")
        on = P.saved(deepest, f"{folder}/shared").groupBy("conv_id").agg(F.max(last).alias("last")).where("NOT last.is_end").select("conv_id", F.col("last.depth").alias("depth"), F.lit(1).cast("long").alias("own_leaf"))
        paths = spark.read.schema(deepest.schema).parquet(f"{folder}/shared").join(on, ["conv_id", "depth"], "left").select("conv_id", *_NODE, "saves", (F.col("leaves") + F.coalesce("own_leaf", F.lit(0).cast("long"))).alias("leaves"))
        below = running(paths, "conv_id", [F.desc("depth")], {"saves": 1, "leaves": 1}, f"{folder}/below")
        rolled = P.saved(below.groupBy(*_NODE).agg(F.sum("saves_after").alias("saved_tokens"), F.sum("leaves_after").alias("n_leaves")), f"{folder}/rolled")
        ends = P.saved(_ends(prefixes), f"{folder}/ends")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("before"), F.col("rep").alias("parent_conv_id"))
    full = nodes.join(parents, ["depth", "before"], "left").join(rolled, _NODE, "left").join(ends, _NODE, "left")
    return full.select(
        F.col("rep").alias("conv_id"),
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", F.lit(0).cast("long")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
