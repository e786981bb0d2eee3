"""Document quality rules with host-level verdicts.

Counts per document come from one narrow array pass.  Rule failures are then summed by
host (``source``), each rule's failure rate is shrunk toward an empirical beta prior
fitted over all hosts by moments, and a host is rejected when the posterior rate of any
rule passes ``max_rate``.  Host verdicts are joined back: a document is kept if it passes
all rules and its host is not rejected.  A small host needs more failing documents than
a large one, because the prior holds it near the common rate.

The sums by host are partial aggregates, so a host with a third of all rows costs one row
a task.  Verdicts are broadcast while the hosts number at most BROADCAST_HOSTS; beyond
that the join is salted, so that no host's documents meet in one task.

Edge cases: a null text has no words (and so fails); a null host is a host of its own;
equal ids and repeated rows are judged row by row, and each counts for its host; a very long
text is measured whole, alone in its piece; an empty table gives no rows; other columns pass
through, but for one with the output's name, which the output replaces.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import packed as P

#: Rows of (host, verdict) that are broadcast at most; about 100 bytes each.
BROADCAST_HOSTS = 100_000
SALTS = 64

#: Characters that count as symbols; a fixed value of the rule.
SYMBOLS = "#*$%&|<>"

#: Rules by name, each true where a document fails; n_words = 0 fails the first alone.
RULES = {
    "few_words": "n_words < 20",
    "repeats": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
    "dup_lines": "100 * n_dup_lines > 50 * n_lines",
    "stutter": "100 * n_stutter > 30 * n_words",
}
BASE_RULES = ("few_words", "repeats")

METRICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutter"]

_IS_SYMBOL = np.zeros(256, np.int64)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = 1


def _summed(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values between offsets."""
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[offsets[1:]] - sums[offsets[:-1]]


def measure(data: np.ndarray, offsets: np.ndarray, shingle: int = 8) -> list[np.ndarray]:
    """The METRICS of each text of a buffer."""
    words = P.Words(data, offsets)
    n = len(offsets) - 1
    n_words = words.counts()
    points = (data & 0xC0) != 0x80
    word_chars = _summed(points & ~P.IS_SPACE[data], offsets)
    n_symbols = _summed(_IS_SYMBOL[data], offsets)

    # lines: a text of k newlines has k + 1
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((offsets[1:], breaks)), kind="stable")
    first = np.searchsorted(breaks, offsets) + np.arange(n + 1)
    first[-1] = len(starts)
    doc = np.repeat(np.arange(n), np.diff(first))
    has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    n_lines = np.bincount(doc[has_word], minlength=n).astype(np.int64)
    at = np.flatnonzero(has_word)
    key = P.mix(P.span_hashes(data, starts[at], ends[at]) ^ P.mix(doc[at].astype(np.uint64) + np.uint64(1)))
    _, keep = np.unique(key, return_index=True)
    n_dup = n_lines - np.bincount(doc[at][keep], minlength=n)

    # words of shingles found twice or more in their text
    hashes = words.hashes()
    pos, key = P.rolling(hashes, words.first, shingle)
    owner = np.repeat(np.arange(n), np.maximum(n_words - shingle + 1, 0))
    key = P.mix(key ^ P.mix(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(key, kind="stable")
    s = key[order]
    twice = np.zeros(len(s), bool)
    twice[1:] = s[1:] == s[:-1]
    twice[:-1] |= twice[1:]
    begin = pos[order[twice]]
    mark = np.zeros(len(words) + 1, np.int64)
    mark += np.bincount(begin, minlength=len(mark)) - np.bincount(begin + shingle, minlength=len(mark))
    n_repeat = _summed(np.cumsum(mark[:-1]) > 0, words.first)

    again = np.zeros(len(words), bool)  # words equal to the word before
    again[1:] = hashes[1:] == hashes[:-1]
    again[words.first[:-1][n_words > 0]] = False
    return [n_words.astype(np.int64), word_chars, n_symbols, n_dup.astype(np.int64), n_repeat, n_lines, _summed(again, words.first)]


def with_metrics(docs: DataFrame, text: str = "text", into: str = "quality_metrics") -> DataFrame:
    """docs with a struct of the METRICS; all other columns pass through."""
    struct = T.StructType([T.StructField(m, T.LongType()) for m in METRICS])

    def make(texts):
        return [pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in measure(*P.utf8(texts))], METRICS)]

    return P.add_columns(docs, text, [(into, struct)], make)


def host_verdicts(measured: DataFrame, max_rate: float = 0.5, host: str = "source", into: str = "quality_metrics") -> DataFrame:
    """(host, n_docs, host_rate, host_failed): the worst shrunk failure rate of each host.

    The prior of a rule is beta(a, b) with the mean and variance of the hosts' raw rates;
    where they do not vary the prior is as strong as 1,000 documents at the mean.
    """
    fails = {r: F.coalesce(F.expr(RULES[r]), F.lit(False)).cast("int") for r in RULES}
    flat = measured.select(F.col(f"`{host}`").alias("host"), F.col(f"`{into}`.*"))
    hosts = flat.groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), *(F.sum(c).alias(f"f_{r}") for r, c in fails.items()))
    rate = {r: F.col(f"f_{r}") / F.col("n_docs") for r in RULES}
    moments = hosts.agg(*(e for r in RULES for e in (F.avg(rate[r]).alias(f"m_{r}"), F.var_pop(rate[r]).alias(f"v_{r}"))))
    joined = hosts.crossJoin(F.broadcast(moments))  # one row
    shrunk = []
    for r in RULES:
        m, v = F.col(f"m_{r}"), F.col(f"v_{r}")
        strength = F.when((v <= 0) | (m <= 0) | (m >= 1), F.lit(1000.0)).otherwise(F.greatest(m * (1 - m) / v - 1, F.lit(1.0)))
        shrunk.append((F.col(f"f_{r}") + strength * m) / (F.col("n_docs") + strength))
    return joined.select("host", "n_docs", F.greatest(*shrunk).alias("host_rate")).withColumn("host_failed", F.col("host_rate") > max_rate)


def judge(docs: DataFrame, max_rate: float = 0.5, text: str = "text", host: str = "source", into: str = "quality", keep_text: bool = True) -> DataFrame:
    """docs with a struct ``into`` of the METRICS, base_failed, rules_failed, host_rate and kept.

    Texts are measured once for the hosts and again for the rows, as they are not stored in
    between.  Without ``keep_text`` they are measured once, and the rows written without them.
    """
    P.ensure_checkpoint_dir(docs.sparkSession)
    inner = [f"c{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*inner)
    words, site = inner[P.position(docs, text)], inner[P.position(docs, host)]
    if keep_text:
        measured = with_metrics(plain, words, "m")
        sites = with_metrics(plain.select(words, site), words, "m").select(site, "m")
    else:
        measured = P.saved(with_metrics(plain, words, "m").drop(words), f"{P.scratch(docs.sparkSession, 'quality')}/measured")
        sites = measured.select(site, "m")
    verdicts = host_verdicts(sites, max_rate, site, "m").checkpoint()
    small = verdicts.count() <= BROADCAST_HOSTS
    right = verdicts.select(F.col("host").alias("h"), F.struct("host_rate", "host_failed").alias("v"))
    if small:
        joined = measured.join(F.broadcast(right), F.col(site).eqNullSafe(F.col("h")), "left")
    else:
        salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
        right = right.withColumn("h_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = measured.withColumn("salt", salt).join(right, F.col(site).eqNullSafe(F.col("h")) & (F.col("salt") == F.col("h_salt")), "left")

    def failing(rules):
        return [F.coalesce(F.expr(_scoped(RULES[r], "m")), F.lit(False)) for r in rules]

    base = failing(BASE_RULES)
    base_failed = base[0] | base[1]
    names_failed = F.array_compact(F.array(*(F.when(c, F.lit(r)) for r, c in zip(RULES, failing(RULES), strict=True))))
    kept = (F.size(names_failed) == 0) & ~F.coalesce(F.col("v.host_failed"), F.lit(False))
    made = F.struct(*(F.col(f"m.{m}").alias(m) for m in METRICS), base_failed.alias("base_failed"), names_failed.alias("rules_failed"), F.col("v.host_rate").alias("host_rate"), kept.alias("kept"))
    kept_columns = [F.col(n).alias(c) for n, c in zip(inner, docs.columns, strict=True) if c.lower() != into.lower() and (keep_text or n != words)]
    return joined.select(*kept_columns, made.alias(into))


def _scoped(rule: str, struct: str) -> str:
    for m in METRICS:
        rule = rule.replace(m, f"{struct}.{m}")
    return rule


__all__ = ["BASE_RULES", "METRICS", "RULES", "host_verdicts", "judge", "measure", "with_metrics"]
