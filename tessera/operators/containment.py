"""Which patterns of a set a text holds, by an Aho-Corasick automaton in the scan."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import checkpoint_dir

#: Characters of patterns in one automaton (up to about 100 bytes each).
BLOCK = 1 << 20

_automata: dict[int, ahocorasick.Automaton] = {}


def _automaton(number: int, shared):
    """The automaton of a broadcast block, kept by the worker until another comes."""
    if number not in _automata:
        _automata.clear()
        made = ahocorasick.Automaton()
        for i, pattern in enumerate(shared.value):
            made.add_word(pattern, i)
        made.make_automaton()
        _automata[number] = made
    return _automata[number]


def holding(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, block: int | None = None) -> DataFrame:
    """(key, pattern) for each pattern that a text holds anywhere, each pair once.

    Texts are scanned once for every block of distinct patterns and never shuffled; time is linear
    in the texts and the hits, whatever the number of patterns in a block.  Null texts and null
    patterns hold and are held by nothing; the empty pattern is held by every text that is not null.
    """
    spark = texts.sparkSession
    distinct = patterns.select(F.col(pattern).cast("string").alias("p")).where("p is not null").distinct()
    sizes = distinct.agg(F.sum(F.length("p")), F.count(F.lit(1))).first()
    blocks = max(1, -(-(sizes[0] or 0) // (block or BLOCK)))
    if blocks > 1:  # read once for every block
        checkpoint_dir(spark)
        distinct = distinct.checkpoint()
    name_type = texts.schema[key].dataType
    schema = T.StructType([T.StructField(key, name_type), T.StructField(pattern, T.StringType())])
    scan = texts.select(F.col(key).alias("k"), F.col(text).cast("string").alias("t")).where("t is not null")
    out = None
    for b in range(blocks):
        mine = distinct if blocks == 1 else distinct.where(F.pmod(F.xxhash64("p"), F.lit(blocks)) == b)
        words = sorted(r.p for r in mine.where("p <> ''").collect())
        if not words:
            continue
        shared = spark.sparkContext.broadcast(words)

        def run(stream, shared=shared, number=shared._jbroadcast.id()):
            automaton = _automaton(number, shared)
            for batch in stream:
                at, held = [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    found = {number for _, number in automaton.iter(t)}
                    at += [i] * len(found)
                    held += found
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array([shared.value[n] for n in held], pa.string())], names=[key, pattern])

        hits = scan.mapInArrow(run, schema)
        out = hits if out is None else out.unionAll(hits)
    if sizes[1] and not distinct.where("p = ''").isEmpty():
        empty = scan.select(F.col("k").alias(key), F.lit("").alias(pattern))
        out = empty if out is None else out.unionAll(empty)
    return spark.createDataFrame([], schema) if out is None else out


#: Patterns that may share a word and still be looked for by it.
SHARED = 16

#: Words, and those with another character on both sides.
_WORD = "[A-Za-z0-9]+"
_INNER = f"(?<=[^A-Za-z0-9]){_WORD}(?=[^A-Za-z0-9])"


def holds_any(texts: DataFrame, key: str, text: str, patterns: DataFrame, pattern: str, block: int | None = None) -> DataFrame:
    """The keys of texts that hold at least one pattern.

    Patterns of one block are sought by ``holding``.  More would scan every text once a block, so
    they meet the texts by joins: a word inside a pattern is a whole word of each text that holds
    it, so a pattern goes by its longest one.  Those without, or whose word more than SHARED
    patterns have, meet the pieces of the texts that are as long as they are.  Work grows with the
    texts and the patterns, not with their product; such texts should be short, as paths are.
    """
    checkpoint_dir(texts.sparkSession)
    block = block or BLOCK
    chars = lambda df: df.agg(F.sum(F.length("p"))).first()[0] or 0
    distinct = patterns.select(F.col(pattern).cast("string").alias("p")).where("p is not null").distinct().checkpoint()
    if chars(distinct) <= block:
        return holding(texts, key, text, distinct, "p", block).select(key).distinct()
    scan = texts.select(F.col(key).alias(key), F.col(text).cast("string").alias("t")).where("t is not null")
    inner = F.transform(F.regexp_extract_all("p", F.lit(_INNER), 0), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    worded = distinct.withColumn("w", F.array_max(inner)["w"])
    few = worded.where("w is not null").groupBy("w").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= SHARED).select("w")
    words = scan.withColumn("w", F.explode(F.array_distinct(F.regexp_extract_all("t", F.lit(_WORD), 0))))
    # the side of the patterns is built, so that a word of very many texts is streamed and not sorted
    out = words.join(worded.join(few, "w").hint("shuffle_hash"), "w").where(F.contains("t", "p")).select(key)
    rest = worded.join(few, "w", "left_anti").select("p").checkpoint()
    if chars(rest) <= block:
        out = out.unionAll(holding(texts, key, text, rest, "p", block).select(key))
    else:
        sizes = F.array(*(F.lit(r.n) for r in rest.select(F.length("p").alias("n")).distinct().collect()))
        fitting = F.filter(sizes, lambda n: n <= F.length("t"))
        pieces = F.flatten(F.transform(fitting, lambda n: F.transform(F.sequence(F.lit(1), F.length("t") - n + 1), lambda i: F.substring(F.col("t"), i, n))))
        out = out.unionAll(scan.select(key, F.explode(F.array_distinct(pieces)).alias("p")).join(rest.hint("shuffle_hash"), "p", "left_semi").select(key))
    return out.distinct()
