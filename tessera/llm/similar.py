"""Groups of documents whose word shingles have a Jaccard similarity of 0.8 or more.

1. A text is the set of its five-word shingles (64-bit hashes, A-Z lower-cased).  Equal sets
   meet by pre-aggregation and are one set from there on.
2. Each set has a SimHash sketch of 512 bits, read as sixteen fingerprints of 32 bits.  The
   Gray-order index of ``simhash`` finds, for each of the sixteen, sets whose fingerprints
   differ in at most three bits; those that also differ in at most LIMIT of 128 other bits
   are candidates.  Bits of two sets of similarity 0.8 differ with chance 0.15, so one
   fingerprint finds the pair with chance 0.26 and all sixteen with 0.99; at 0.85 with 0.9996.
3. Candidates form groups, and every pair of a group is settled on the whole sets
   (``shingles.linked_parts``): a dense group in a few rounds of a fixed number of comparisons a
   member, what nothing links by a sweep of blocks.

Edge cases: a null text has no words; texts without words are copies of each other; fewer
than five words are one shingle; a very long text is one set, worked on whole; a null doc_id
belongs to its group and counts as the largest; rows of equal id and other text are told
apart; an empty table gives no rows; other columns never matter, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import connected_components
from . import packed as P
from . import shingles as S
from . import simhash

U64 = np.uint64

#: 64-bit words of a sketch; each holds two fingerprints.
SKETCH = 8

#: Bits of the sketch's first 128 in which candidates may differ: 4 standard deviations above the mean at similarity 0.8.
LIMIT = 36

_WORDS = [f"s{i}" for i in range(SKETCH)]

#: Each byte's bits as eight lanes of a 64-bit number.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(U64)


def sketches(hashes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """SKETCH words a set: a bit is 1 if it is in over half the set's hashes under that word's seed."""
    sizes = np.diff(cuts)
    out = np.zeros((len(sizes), SKETCH), U64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    # segments of at most 255 hashes, so that a lane of eight bits holds their sum
    parts = -(-sizes[full] // 255)
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    starts = np.repeat(cuts[:-1][full], parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    ends = np.append(starts[1:], len(hashes))
    for w in range(SKETCH):
        seed = P.mix(np.array([w + 1], U64) * U64(P.MULT_A))
        lanes = np.empty((len(starts), 8), U64)
        for s in range(0, len(starts), 512):
            lo, hi = starts[s], ends[min(s + 512, len(starts)) - 1]
            bits = P.mix(hashes[lo:hi] ^ seed).astype("<u8").view(np.uint8).reshape(-1, 8)
            lanes[s : s + 512] = np.add.reduceat(_LANES[bits], starts[s : s + 512] - lo, axis=0)
        ones = np.add.reduceat(lanes.astype("<u8").view(np.uint8).reshape(len(starts), 64).astype(np.int32), first, axis=0)
        out[full, w] = np.packbits(2 * ones > sizes[full, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


_SIGNED = ", ".join(f"{c} long" for c in ("r1", "r2", "doc_id", "sid", *_WORDS))


def _signed(rows: DataFrame, words: int) -> DataFrame:
    """(r1, r2, doc_id, sid, _WORDS) of (r1, r2, doc_id, text)."""

    def run(stream):
        for batch in stream:
            for part in P.pieces(batch, "text"):
                hashes, cuts = S.shingle_sets(part.column("text"), words)
                made = [S.set_ids(hashes, cuts), *np.ascontiguousarray(sketches(hashes, cuts).T)]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], *(pa.array(x.view(np.int64)) for x in made)], names=["r1", "r2", "doc_id", "sid", *_WORDS])

    return rows.mapInArrow(run, _SIGNED)


def candidate_links(sets: DataFrame) -> DataFrame:
    """(a, b): a spanning forest of the candidates among (sid, _WORDS), through the Gray-order index."""
    return simhash.word_links(sets, "sid", _WORDS, LIMIT)


def _row_keys(docs: DataFrame) -> list:
    """Two 64-bit hashes over all columns: rows share them only if they are repeats."""
    columns = [F.col(c).cast("string") for c in docs.columns]
    return [F.xxhash64(F.lit(k), *columns, *(c.isNull() for c in columns)).alias(f"r{k}") for k in (1, 2)]


def similar_groups(docs: DataFrame, percent: int = 80, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(r1, r2, doc_id, sid, keeper) of every row: its key, its set, and its group's (least doc_id, its row's key).

    ``keeper`` is a struct (no_id, doc_id, r1, r2); equal keepers are one group.
    """
    spark = docs.sparkSession
    folder = P.scratch(spark, "similar")
    text_at, id_at = P.position(docs, text), P.position(docs, doc_id)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    rows = plain.select(*_row_keys(plain), F.col(f"c{id_at}").cast("long").alias("doc_id"), F.col(f"c{text_at}").cast("string").alias("text"))
    with P.fleeting_shuffles(spark):
        signed = P.saved(_signed(rows, words), f"{folder}/signed")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "r1", "r2")).alias("first")
        one = P.saved(signed.groupBy("sid").agg(first, *(F.first(w).alias(w) for w in _WORDS)), f"{folder}/one")
        links = P.saved(candidate_links(one.select("sid", *_WORDS)), f"{folder}/links")
        groups = P.saved(connected_components(links).select(F.col("component").alias("key"), F.col("node").alias("sid")), f"{folder}/groups")
        ids = one.join(groups, "sid", "left_semi").select("first.r1", "first.r2")
        texts = rows.join(ids, ["r1", "r2"], "left_semi").select("text")
        sets = P.saved(S.whole_sets(texts, words).join(groups, "sid", "left_semi").dropDuplicates(["sid"]), f"{folder}/sets")
        parts = S.linked_parts(groups, sets, percent, f"{folder}/parts")
        P.discard(spark, f"{folder}/sets")
        rooted = one.join(parts, one.sid == parts.node, "left").select("sid", "first", F.coalesce("component", "sid").alias("root"))
        named = rooted.groupBy("root").agg(F.min("first").alias("keeper"))
        by_sid = P.saved(rooted.join(named, "root").select("sid", "keeper"), f"{folder}/by-sid")
    return signed.join(by_sid, "sid").select("r1", "r2", "doc_id", "sid", "keeper")


def drop_similar(docs: DataFrame, percent: int = 80, words: int = 5, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each group: that of least doc_id, and of its rows one.

    Rows are marked by their own keys, so other rows of an equal id are not touched.
    """
    spark = docs.sparkSession
    found = similar_groups(docs, percent, words, text, doc_id)
    folder = P.scratch(spark, "dropped")
    stays = (F.col("r1") == F.col("keeper.r1")) & (F.col("r2") == F.col("keeper.r2"))
    with P.fleeting_shuffles(spark):
        told = P.saved(found.groupBy("r1", "r2").agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("n")).where("NOT stays OR n > 1"), f"{folder}/told")
    names = docs.columns
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))
    keyed = plain.select("*", *_row_keys(plain))
    alone = keyed.join(told, ["r1", "r2"], "left_anti")
    repeats = keyed.join(told.where("stays"), ["r1", "r2"], "left_semi").dropDuplicates(["r1", "r2"])
    return alone.unionAll(repeats).drop("r1", "r2").toDF(*names)
