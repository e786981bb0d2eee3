"""Ordered logic: folds, chunks, neighbourhoods, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import ordered_fold


def chunks(df: DataFrame, group: str, order: list[Column], size: int) -> DataFrame:
    """df with a shard name: groups above the size are cut in chunks '#hotK' by order."""
    w = Window.partitionBy(group)
    rn = F.row_number().over(w.orderBy(*order))
    counts = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    out = df.join(counts, group).withColumn("__rn", rn)
    name = F.when(F.col("__n") > size, F.concat(F.col(group).cast("string"), F.lit("#hot"), F.floor((F.col("__rn") - 1) / size).cast("string"))).otherwise(F.col(group).cast("string"))
    return out.withColumn("shard", name).drop("__n", "__rn")


def round_robin(df: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """The first rows of every group in turn, as ``turn`` and ``place``; groups by their best row, then name.

    Only the first ``limit`` rows of a group can be taken, so the rest are dropped before the
    global sort, which is a top-k.
    """
    ranked = df.withColumn("turn", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("turn") <= limit)
    return ranked.orderBy("turn", group).limit(limit)


def neighbourhood(df: DataFrame, keys: list[str], order: str, text: str, before: int, after: int, into: str = "window") -> DataFrame:
    """The lines around each line, joined by newlines."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-before, after)
    return df.withColumn(into, F.array_join(F.collect_list(text).over(w), "\n"))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """(keys, start, end) after joining intervals that overlap or lie within the gap. Gaps and islands."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    flagged = df.where(F.col(start) <= F.col(end)).withColumn("__new", F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0))
    island = flagged.withColumn("__island", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*keys, "__island").agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("__island")


def uncovered(spans: DataFrame, sizes: DataFrame, keys: list[str], start: str, end: str, size: str) -> DataFrame:
    """(keys, start, end): the parts of 1..size that no span covers.

    Merged spans leave gaps before, between and after them, so nothing is exploded by line.
    """
    clipped = spans.join(sizes, keys).select(*keys, F.greatest(F.col(start), F.lit(1)).alias("start"), F.least(F.col(end), F.col(size)).alias("end"))
    merged = merge_intervals(clipped.where("start <= end"), keys, "start", "end")
    w = Window.partitionBy(*keys).orderBy("start")
    gaps = merged.select(*keys, (F.coalesce(F.lag("end").over(w), F.lit(0)) + 1).alias("a"), (F.col("start") - 1).alias("b"))
    last = merged.groupBy(*keys).agg(F.max("end").alias("e"))
    tail = sizes.join(last, keys, "left").select(*keys, (F.coalesce("e", F.lit(0)) + 1).alias("a"), F.col(size).alias("b"))
    return gaps.unionByName(tail).where("a <= b").select(*keys, F.col("a").cast("long").alias("start"), F.col("b").cast("long").alias("end"))


def islands(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """(keys, start, end) of runs of consecutive positions."""
    rn = F.row_number().over(Window.partitionBy(*keys).orderBy(position))
    return df.withColumn("__g", F.col(position) - rn).groupBy(*keys, "__g").agg(F.min(position).alias("start"), F.max(position).alias("end")).drop("__g")


def nonblank_ranges(lines: DataFrame, keys: list[str], position: str, text: str) -> DataFrame:
    """Runs of lines that are not blank."""
    return islands(lines.where(F.trim(text) != ""), keys, position)


def pack_budget(df: DataFrame, key: str, order: str, cost: str, budget: int) -> DataFrame:
    """df with ``taken``: in order, a block is taken if it still fits; later smaller ones may fit where an earlier did not."""

    def step(used, size):
        fits = size is not None and used + int(size) <= budget
        return used + int(size) if fits else used, fits if size is not None else None

    return ordered_fold(df, [key], _rest(df, key, order, cost), [cost], int, step, "taken", T.BooleanType())


def next_fit(df: DataFrame, key: str, order: str, size: str, capacity: int) -> DataFrame:
    """df with ``bin`` from 0: a new bin opens when the next item does not fit."""

    def step(state, item):
        used, number = state
        cost = int(item or 0)
        if used > 0 and used + cost > capacity:
            return (cost, number + 1), number + 1
        return (used + cost, number), number

    return ordered_fold(df, [key], _rest(df, key, order, size), [size], lambda: (0, 0), step, "bin", T.IntegerType())


def _rest(df: DataFrame, key: str, *first: str) -> list[str]:
    """The order of a fold: the given columns, then all others, so that ties are settled."""
    kinds = dict(df.dtypes)
    return [*first, *(c for c in df.columns if c not in (key, *first) and not kinds[c].startswith("map"))]


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows of a total order, as a top-k without a full sort."""
    return df.orderBy(*order).limit(k)


def top_k_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int, into: str = "rank") -> DataFrame:
    return df.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(into) <= k)


def head_tail(df: DataFrame, keys: list[str], text: str, most: int) -> DataFrame:
    """Line-capped text: the first 75 % and last 25 % of the cap, with a marker between."""
    lines = F.split(F.col(text), "\n", -1)
    head = int(most * 0.75)
    cut = F.concat(F.slice(lines, 1, head), F.array(F.concat(F.lit("... "), (F.size(lines) - most).cast("string"), F.lit(" lines left out"))), F.slice(lines, -(most - head), most - head))
    return df.select(*keys, F.array_join(F.when(F.size(lines) > most, cut).otherwise(lines), "\n").alias(text))


def sequential_ids(df: DataFrame, order: list[str], prefix: str, partition: str) -> DataFrame:
    """Ids PREFIX-partition-NNN after a sort within each partition, as dated reports number them."""
    rn = F.row_number().over(Window.partitionBy(partition).orderBy(*order))
    return df.withColumn("id", F.format_string(f"{prefix}-%s-%03d", F.col(partition).cast("string"), rn))


def proximity_fold(df: DataFrame, keys: list[str], line: str, bucket: str, source: str, order: list[str], window: int = 3) -> DataFrame:
    """Keep one row of near duplicates, folding in order against the last kept row.

    A row within ``window`` lines of the last kept row and of its bucket merges with it; the
    stronger source (confirmed, scanner, model) stays, of equals the earlier.  ``merged`` counts
    the rows folded in.
    """
    strength = F.when(F.col(source) == "sast_confirmed", 2).when(F.col(source) == "sast_only", 1).otherwise(0)
    cols = [c for c in df.columns if c not in keys]

    def step(kept, at, of, strong):
        number, last, name, best = kept
        if number and None not in (last, at) and abs(last - at) <= window and name == of and name is not None:
            return (kept if best >= strong else (number, at, of, strong)), number
        return (number + 1, at, of, strong), number + 1

    folded = ordered_fold(df.withColumn("__s", strength), keys, [line, *order], [line, bucket, "__s"], lambda: (0, None, None, 0), step, "__kept", T.LongType())
    groups = folded.groupBy(*keys, "__kept").agg(F.min_by(F.struct(*cols), F.struct(-F.col("__s"), line, *order)).alias("row"), (F.count(F.lit(1)) - 1).cast("int").alias("merged"))
    return groups.select(*keys, "row.*", "merged")


def sessions(df: DataFrame, keys: list[str], order: list[str], opens: Column) -> DataFrame:
    """df with a session number that rises where ``opens`` holds."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("session", F.sum(F.when(opens, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def transitions(df: DataFrame, key: str, order: list[str], state: str) -> DataFrame:
    """(source, target, n) of successive states per key."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("target", F.lead(state).over(w)).where("target is not null").groupBy(F.col(state).alias("source"), "target").agg(F.count(F.lit(1)).alias("n"))
