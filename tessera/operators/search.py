"""Keyword and vector search, and merging of ranked results."""

from __future__ import annotations

import re
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a block of query vectors that is broadcast at most.
BLOCK_BYTES = 64 << 20

#: Bytes of a block of query words that is broadcast at most.
QUERY_BYTES = 8 << 20

WORD = re.compile("[a-z0-9]+")


def word_list(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def _term_blocks(queries: DataFrame, query_id: str, query: str) -> list[tuple[pa.Array, list[list[str]]]]:
    """(ids, distinct words of each) in blocks of about QUERY_BYTES, chosen by the id; queries without words are left out."""
    rows = queries.select(F.col(query_id).alias("q"), F.explode(word_list(F.col(query))).alias("t")).distinct().groupBy("q").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    size = rows.agg(F.sum(F.octet_length(F.array_join("ts", ","))).alias("n")).first().n or 0
    blocks = max(1, -(-size // QUERY_BYTES))
    out = []
    for i in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == i).toArrow().combine_chunks()
        if block.num_rows:
            out.append((block.column("q").combine_chunks(), block.column("ts").to_pylist()))
    return out


def _counts(texts: list[str], index: dict[str, int]):
    """(row, term, count) arrays of the listed words in some texts, ordered by term and row, and the length of every text."""
    at, term, length = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        words = WORD.findall(text)
        length[i] = len(words)
        mine = [index[w] for w in words if w in index]
        term += mine
        at += [i] * len(mine)
    joint, n = np.unique(np.asarray(term, np.int64) * max(1, len(texts)) + np.asarray(at, np.int64), return_counts=True)
    return joint % max(1, len(texts)), joint // max(1, len(texts)), n, length


def _postings(row: np.ndarray, term: np.ndarray, weight: np.ndarray) -> dict:
    """term -> (rows, weights, greatest weight) of one batch."""
    cut = np.flatnonzero(np.diff(term, prepend=-1))
    ends = np.append(cut[1:], len(term))
    return {int(term[i]): (row[i:j], weight[i:j], float(weight[i:j].max())) for i, j in zip(cut, ends)}


def _bounded(lists: list, k: int, floor: float):
    """(rows, scores) of a batch that can be among the k best, given the k-th best score so far.

    The words of least bound that together stay below it bring no row of their own: they are only
    looked up in the rows that the others bring, and rows whose bound falls below it are let go.
    """
    lists = sorted(lists, key=lambda x: x[2])
    reach = np.cumsum([x[2] for x in lists])
    first = int(np.searchsorted(reach, floor))
    if first == len(lists):
        return np.zeros(0, np.int64), np.zeros(0)
    rows = np.unique(np.concatenate([x[0] for x in lists[first:]]))
    score = np.zeros(len(rows))
    for r, w, _ in lists[first:]:
        score[np.searchsorted(rows, r)] += w
    for i in range(first - 1, -1, -1):
        stay = score + reach[i] >= floor
        rows, score = rows[stay], score[stay]
        r, w, _ = lists[i]
        to = np.minimum(np.searchsorted(r, rows), len(r) - 1)
        score += np.where(r[to] == rows, w[to], 0)
    best = _best(rows, score, k)
    return rows[best], score[best]


def _scan_top_k(docs: DataFrame, doc_id: str, text: str, ids: pa.Array, words: list[list[str]], k: int, weigh) -> DataFrame:
    """(q, d, score): in each task the k best rows of each query of a block, by score to nine digits, then id.

    ``weigh(term, count, length)`` gives the weights of a batch's (row, term) counts.
    """
    index = {t: i for i, t in enumerate(sorted({t for ts in words for t in ts}))}
    shared = docs.sparkSession.sparkContext.broadcast((index, [[index[t] for t in ts] for ts in words], ids))

    def run(stream):
        index, wanted, ids = shared.value
        held = [[] for _ in wanted]
        for batch in stream:
            # in order of id, so that a row's place in the batch settles ties
            batch = batch.take(pc.sort_indices(batch.column(0), null_placement="at_start"))
            row, term, n, length = _counts(batch.column(1).to_pylist(), index)
            if not len(term):
                continue
            post = _postings(row, term, weigh(term, n, length[row]))
            for q, terms in enumerate(wanted):
                lists = [post[t] for t in terms if t in post]
                if not lists:
                    continue
                floor = held[q][-1][0] - 1e-8 if len(held[q]) == k else -np.inf
                rows, score = _bounded(lists, k, floor)
                if len(rows):
                    more = zip(np.round(score, 9).tolist(), batch.column(0).take(pa.array(rows)).to_pylist(), score.tolist())
                    held[q] = sorted([*held[q], *more], key=lambda x: (-x[0], x[1] is not None, x[1]))[:k]
        where = np.repeat(np.arange(len(held)), [len(h) for h in held])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(where)), pa.array([x[1] for h in held for x in h], kind), pa.array([x[2] for h in held for x in h], pa.float64())], names=["q", "d", "score"])

    from pyspark.sql.pandas.types import from_arrow_type, to_arrow_type

    kind = to_arrow_type(docs.schema[doc_id].dataType)
    rows = docs.select(F.col(doc_id).alias("d"), F.lower(F.coalesce(text, F.lit(""))).alias("t"))
    return rows.mapInArrow(run, f"q {from_arrow_type(ids.type).simpleString()}, d {docs.schema[doc_id].dataType.simpleString()}, score double")


def _search(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query: str, k: int, weigher) -> DataFrame:
    """The k best rows of each query over all its blocks; ``weigher(words)`` gives a block's weigh."""
    parts = [_scan_top_k(docs, doc_id, text, ids, words, k, weigher(words)) for ids, words in _term_blocks(queries, query_id, query)]
    if not parts:
        parts = [docs.sparkSession.createDataFrame([], T.StructType([T.StructField("q", queries.schema[query_id].dataType), T.StructField("d", docs.schema[doc_id].dataType), T.StructField("score", T.DoubleType())]))]
    best = _ranked(reduce(DataFrame.unionAll, parts), "q", "score", "d", k)
    return best.select(F.col("q").alias(query_id), F.col("d").alias(doc_id), "score", "rank")


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query; those that share no word with it are none.

    One scan counts the documents that hold each query word; a second scores whole texts in place,
    with the greatest weight of each word in a batch as its bound, and shuffles k rows a query and
    task.  So a query of common words makes no (query, document) pairs.  Query words go out in
    blocks of checked size, two scans a block.  Rows with one query id are one query; a null text
    is empty.
    """
    texts = docs.select(F.lower(F.coalesce(text, F.lit(""))).alias("t"))

    def weigher(words):
        terms = sorted({t for ts in words for t in ts})
        index = {t: i for i, t in enumerate(terms)}
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def count(stream):
            # two places more: the number of texts and their words
            held = np.zeros(len(shared.value) + 2, np.int64)
            for batch in stream:
                _, term, _, length = _counts(batch.column(0).to_pylist(), shared.value)
                held[:-2] += np.bincount(term, minlength=len(held) - 2)
                held[-2:] += [len(length), length.sum()]
            some = np.flatnonzero(held)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(held[some], pa.int64())], names=["t", "n"])

        got = np.zeros(len(terms) + 2)
        for r in texts.mapInArrow(count, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect():
            got[r.t] = r.n
        df, n, total = got[:-2], got[-2], got[-1]
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        mean = max(total / max(n, 1), 1e-300)
        return lambda term, tf, length: idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))

    return _search(docs, queries, doc_id, text, query_id, query, k, weigher)


def _ranked(df: DataFrame, query: str, score: str, tie: str, k: int) -> DataFrame:
    # ranking on the rounded score makes ties of equal documents break by id
    w = Window.partitionBy(query).orderBy(F.desc(F.round(score, 9)), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _matrix(column) -> np.ndarray:
    """Rows of unit length of an Arrow column of vectors; a vector of zeros stays one."""
    flat = column.combine_chunks() if hasattr(column, "combine_chunks") else column
    rows = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 0))
    size = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


def _block(df: DataFrame, key: str, vector: str, what: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys and unit vectors of a stated block; raises where it is more than BLOCK_BYTES."""
    told = df.where(F.col(vector).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.max(F.size(vector)).alias("d")).first()
    if told.n * (told.d or 0) * 8 > BLOCK_BYTES:
        raise ValueError(f"{told.n} {what} of {told.d} numbers: search in blocks of {BLOCK_BYTES} bytes")
    rows = df.where(F.col(vector).isNotNull()).select(F.col(key).cast("long"), vector).toArrow()
    return rows.column(0).to_numpy(), _matrix(rows.column(1))


def _best(key: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, by score to nine digits, then key."""
    score = np.round(score, 9)
    at = np.arange(len(score))
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    return at[np.lexsort((key[at], -score[at]))[:k]]


def vector_top_k(base: DataFrame, queries: DataFrame, key: str, vector: str, query_key: str, k: int) -> DataFrame:
    """(query_key, key, score, rank) by cosine, each query against all other rows; null vectors take no part.

    The query set is a stated block, checked against BLOCK_BYTES and broadcast.  A task scores its
    rows by matrix products and holds the k best of each query, which alone are shuffled.
    """
    names, wanted = _block(queries, key, vector, "queries")
    shared = base.sparkSession.sparkContext.broadcast((names, wanted))

    def run(stream):
        names, wanted = shared.value
        have_key, have = [np.zeros(0, np.int64)] * len(names), [np.zeros(0)] * len(names)
        for rows in stream:
            key_, rows = rows.column(0).to_numpy(), _matrix(rows.column(1))
            for q0 in range(0, len(names), 512):
                score = rows @ wanted[q0 : q0 + 512].T
                for i in range(score.shape[1]):
                    q, mine, other = q0 + i, score[:, i], key_ != names[q0 + i]
                    at = np.flatnonzero(other)
                    at = at[_best(key_[at], mine[at], k)]
                    keys, scores = np.concatenate((have_key[q], key_[at])), np.concatenate((have[q], mine[at]))
                    best = _best(keys, scores, k)
                    have_key[q], have[q] = keys[best], scores[best]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, [len(x) for x in have]), pa.int64()), pa.array(np.concatenate([*have_key, np.zeros(0, np.int64)]), pa.int64()), pa.array(np.concatenate([*have, np.zeros(0)]), pa.float64())], names=["q", "d", "score"])

    rows = base.where(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("d"), F.col(vector).alias("v"))
    best = rows.mapInArrow(run, "q long, d long, score double")
    return _ranked(best, "q", "score", "d", k).select(F.col("q").alias(query_key), F.col("d").alias(key), "score", "rank")


def drop_known(df: DataFrame, known: DataFrame, key: str, vector: str, least: float = 0.9) -> DataFrame:
    """Rows whose cosine to any known row is below the threshold; a row without a vector stays.

    Known rows are a block of checked size; the pass is narrow, by matrix products.
    """
    _, wanted = _block(known, key, vector, "known rows")
    shared = df.sparkSession.sparkContext.broadcast(wanted)
    at = df.columns.index(vector)

    def run(stream):
        wanted = shared.value
        for rows in stream:
            there = rows.column(at).is_valid().to_numpy(zero_copy_only=False)
            keep = np.ones(rows.num_rows, bool)
            if len(wanted) and there.any():
                mine = _matrix(rows.column(at).filter(pa.array(there)))
                top = np.full(len(mine), -2.0)
                for q in range(0, len(wanted), 1024):
                    top = np.maximum(top, (mine @ wanted[q : q + 1024].T).max(axis=1))
                keep[there] = top < least
            yield rows.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def token_search(docs: DataFrame, queries: DataFrame, doc_id: str, text: str, query_id: str, query: str, k: int) -> DataFrame:
    """(query_id, doc_id, score, rank): the number of distinct query tokens a document holds; scanned as in bm25."""
    found = _search(docs, queries, doc_id, text, query_id, query, k, lambda words: lambda term, n, length: np.ones(len(term)))
    return found.withColumn("score", F.col("score").cast("long"))


def host_keyword_score(docs: DataFrame, url: str, hosts: list[str], text: str, words: list[str]) -> DataFrame:
    """docs with a score: 2 for a host suffix, 1 per keyword."""
    host = F.parse_url(url, F.lit("HOST"))
    fits = F.lit(False)
    for h in hosts:
        fits = fits | (host == h) | F.endswith(host, F.lit(f".{h}"))
    score = F.when(fits, 2).otherwise(0)
    for w in words:
        score = score + F.when(F.contains(F.lower(text), F.lit(w.lower())), 1).otherwise(0)
    return docs.withColumn("score", score)


def quota_union(first: DataFrame, second: DataFrame, key: list[str], order: str, total: int, kept_for_second: int) -> DataFrame:
    """The best rows of two sources: ``first`` fills all but the slots kept for ``second``; repeats count once."""
    a = first.withColumn("__s", F.lit(0))
    b = second.join(first.select(*key), key, "left_anti").withColumn("__s", F.lit(1))
    rows = a.orderBy(order).limit(total).unionByName(b.orderBy(order).limit(total))
    ranked = rows.withColumn("__r", F.row_number().over(Window.partitionBy("__s").orderBy(order)))
    n_second = ranked.agg(F.count_if(F.col("__s") == 1).alias("n"))
    room = F.lit(total) - F.least(F.col("n"), F.lit(kept_for_second))
    taken = ranked.crossJoin(F.broadcast(n_second)).where(F.when(F.col("__s") == 0, F.col("__r") <= room).otherwise(True))
    return taken.orderBy("__s", "__r").limit(total).drop("__s", "__r", "n")


def federated(sources: list[DataFrame], key: str, pinned: DataFrame) -> DataFrame:
    """First occurrence by key in source order, without pinned rows."""
    rows = None
    for i, s in enumerate(sources):
        s = s.withColumn("source_no", F.lit(i))
        rows = s if rows is None else rows.unionByName(s, allowMissingColumns=True)
    rest = [c for c in rows.columns if c != key]
    first = rows.groupBy(key).agg(F.min_by(F.struct(*rest), F.col("source_no")).alias("r")).select(key, "r.*")
    return first.join(pinned.select(key), key, "left_anti")


def favourites(df: DataFrame, key: str, generation: str, order: list[Column]) -> DataFrame:
    """The row of the latest generation per key, ranked."""
    rest = [c for c in df.columns if c != key]
    best = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(generation)).alias("r")).select(key, "r.*")
    return best.orderBy(*order)


def choose_tool(requests: DataFrame, cache: DataFrame, tools: DataFrame, key: str, kind: str, tool: str) -> DataFrame:
    """(key, tool, how): a cache hit, else the tool of best affinity (2 exact kind, 1 general), else none."""
    r = requests.join(cache.select(key, F.col(tool).alias("__hit")), key, "left")
    exact = tools.where(F.col(kind) != "*").groupBy(kind).agg(F.min(tool).alias("__exact"))
    general = tools.where(F.col(kind) == "*").agg(F.min(tool).alias("__any"))
    r = r.join(exact, kind, "left").crossJoin(F.broadcast(general))
    how = F.when(F.col("__hit").isNotNull(), "cache").when(F.col("__exact").isNotNull(), "rule").when(F.col("__any").isNotNull(), "general").otherwise("ask")
    return r.select(key, F.coalesce("__hit", "__exact", "__any").alias(tool), how.alias("how"))


def assign_by_priority(rows: DataFrame, key: str, options: list[tuple[Column, Column]]) -> DataFrame:
    """rows with ``assigned`` and ``rank``: the first option whose condition holds; rows without one are left out."""
    name, rank = F.lit(None).cast("string"), F.lit(None).cast("int")
    for i, (condition, value) in reversed(list(enumerate(options))):
        name = F.when(condition, value).otherwise(name)
        rank = F.when(condition, F.lit(i)).otherwise(rank)
    return rows.withColumn("assigned", name).withColumn("rank", rank).where("assigned is not null")
