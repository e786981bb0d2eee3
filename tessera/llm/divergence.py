"""Audit of how the sources of a language differ in their words.

1. A scan counts terms: each task folds its documents into (lang, source, term) counts and
   hands them on whenever FOLD entries are held, so a hot source or term is one entry a fold.
2. Terms in at least ``least`` documents of their language are kept.  Each group (lang,
   source) has the smoothed share p of every kept term in parts per 10^9; a term that a group
   lacks has the group's constant share z.
3. The divergence of two groups is a sum over the language's whole vocabulary, found by
   inclusion and exclusion over their supports without visiting what neither has:
   terms of one group against the other's z come from the group's histogram of counts, terms
   of both from a join of postings (which takes back what the histograms counted for them),
   and terms of neither are one constant times their number.  All arithmetic is on integers.

Edge cases: null text, lang and source are ''; a group without terms, and documents without
text, count as groups; a language without kept terms has divergence 0 and no term rows;
equal values rank by item; doc_id is not used, so null ids and repeated rows count as further
documents; a very long text is counted whole; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import packed as P

#: Entries of a task's counts before they are handed on.
FOLD = 400_000

#: Parts of a whole share.
UNITS = 1_000_000_000

#: Bytes of a term are ASCII letters, lower-cased, and all of other characters; the rest part terms.
_TERM_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def _counted(stream):
    """Folded counts; a row with no term tells that the group occurs."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}
    held = 0

    def hand_on():
        for (lang, source), (n, docs) in groups.items():
            terms = [None, *n]
            columns = ([lang] * len(terms), [source] * len(terms), pa.array(terms, pa.binary()).cast(pa.string()), [0, *n.values()], [0, *(docs[t] for t in n)])
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) if isinstance(c, list) else c for c, f in zip(columns, _COUNTS, strict=True)], schema=_COUNTS)
        groups.clear()

    for batch in stream:
        for rows in P.pieces(batch, "text"):
            data, offsets = P.utf8(rows.column("text"))
            data, ends = data.tobytes().translate(_TERM_BYTES), offsets.tolist()
            for k, group in enumerate(zip(rows.column("lang").to_pylist(), rows.column("source").to_pylist(), strict=True)):
                n, docs = groups.setdefault(group, (Counter(), Counter()))
                terms = data[ends[k] : ends[k + 1]].split()
                before = len(n)
                n.update(terms)
                docs.update(set(terms))
                held += len(n) - before
            if held >= FOLD:
                yield from hand_on()
                held = 0
    yield from hand_on()


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences and documents of each term, and a row with a null term for each group."""
    cols = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))]
    parts = docs.select(*cols).mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n, total, terms) -> Column:
    """1 + floor(UNITS * (n + 2) / (total + 2 * terms)), exact for any 64-bit counts; null without terms."""
    return F.expr(f"CASE WHEN {terms} > 0 THEN 1 + CAST({UNITS} AS DECIMAL(10, 0)) * ({n} + 2) DIV ({total} + 2 * {terms}) END")


def gap(p: str, q: str) -> str:
    """floor((p - q)^2 / (p + q)) of two shares."""
    return f"(({p} - {q}) * ({p} - {q}) DIV ({p} + {q}))"


def divergence(docs: DataFrame, least: int = 10, top: int = 10, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) as the module says.

    Part ``pair``: the divergence from each other source of the language.  Part ``term``: the
    ``top`` kept terms that stand out most in the group against the whole language.
    """
    spark = docs.sparkSession
    folder = P.scratch(spark, "divergence")
    by_term = Window.partitionBy("lang", "term")
    with P.fleeting_shuffles(spark):
        counts = term_counts(docs, text, lang, source)
        spread = counts.select("lang", "source", "term", "n", F.sum("docs").over(by_term).alias("spread"), F.sum("n").over(by_term).alias("all"), (F.min("source").over(by_term) == F.col("source")).alias("first"))
        kept = P.saved(spread.where(f"term IS NULL OR spread >= {least}").drop("spread"), f"{folder}/kept")
        # per group: N, size of the support; per language: N and V.  Rows without a term keep every group
        of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("term").alias("support"), F.sum(F.expr("CAST(first AND term IS NOT NULL AS long)")).alias("firsts"))
        by_lang = of_group.groupBy("lang").agg(F.sum("firsts").alias("terms"), F.sum("total").alias("lang_total"))
        groups = P.saved(of_group.join(by_lang, "lang").withColumn("z", share(0, "total", "terms")).drop("firsts"), f"{folder}/groups")
        priced = kept.where("term IS NOT NULL").join(groups, ["lang", "source"]).withColumn("p", share("n", "total", "terms"))
        postings = P.saved(priced.select("lang", "source", "term", "n", "all", "p", "z", "terms", "lang_total"), f"{folder}/postings")
    return _ranked(_pairs(groups, postings), None).unionAll(_ranked(_terms(postings), top))


def _pairs(groups: DataFrame, postings: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of every ordered pair of sources."""
    salts = P.partitions(groups.sparkSession)
    slim = groups.select("lang", "source", "z", "support", "terms")

    def against_groups(rows: DataFrame, *keys: str) -> DataFrame:
        """Rows with each other group of their language as ``other``; a language's rows spread over salts."""
        many = slim.select("lang", F.col("source").alias("other"), F.col("z").alias("other_z"), F.col("support").alias("other_support"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        return rows.withColumn("salt", F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")).join(many, ["lang", "salt"])

    low, high = F.least("source", "other").alias("a"), F.greatest("source", "other").alias("b")
    neither = against_groups(slim, "source").where("source < other").select("lang", low, high, F.expr(f"coalesce((terms - support - other_support) * {gap('z', 'other_z')}, 0)").alias("v"))
    histogram = postings.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("m"))
    one_sided = against_groups(histogram, "source", "p").where("source <> other").select("lang", low, high, F.expr(f"m * {gap('p', 'other_z')}").alias("v"))
    x = postings.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("z").alias("za"))
    y = postings.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    both = x.join(y, ["lang", "term"]).where("a < b").select("lang", "a", "b", F.expr(f"{gap('pa', 'pb')} - {gap('pa', 'zb')} - {gap('za', 'pb')} + {gap('za', 'zb')}").alias("v"))
    sums = neither.unionAll(one_sided).unionAll(both).groupBy("lang", "a", "b").agg(F.sum("v").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e")
    return sums.select("lang", "value", ends).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")


def _terms(postings: DataFrame) -> DataFrame:
    """(lang, source, part, item, value) of the terms that a group has more of than its language."""
    over = postings.withColumn("q", share("all", "lang_total", "terms")).where("p > q")
    return over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(gap("p", "q")).alias("value"))


def _ranked(rows: DataFrame, top: int | None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    out = rows.withColumn("rank", rank)
    return out if top is None else out.where(F.col("rank") <= top)
