"""Toxic passages by maximum-scoring segments, calibrated by extreme values.

Learning.  Words of a bounded sample of labelled documents (``sample`` rows, taken by a
hash of their id) are counted by class.  A word's toxic share has a Dirichlet prior whose
mean is the share of its 6-byte prefix, whose prior is that of its 5-byte prefix, then of
4 bytes, then of all words.  A word or prefix whose share differs from its parent's by
more than ``min_z`` standard errors is a feature; its value is its log-odds against all
words.  The rest take their parent's value.

Scanning.  Each word scores its value less ``drift``, so that clean text falls.  A linear
scan yields all maximal scoring segments of a document; words that only fall are summed
by numpy first, so the Python loop sees the few that rise.

Calibration.  On labelled documents kept out of the counts, lambda solves
sum p(s) exp(lambda s) = 1 over clean words and K fits the number of clean segments:
the segments of chance have an extreme-value law, P(S >= s) = 1 - exp(-K n exp(-lambda s)).
A document's evidence is the sum of lambda S - log(1 + K n) over its significant
segments; a logistic curve fitted on those documents turns it into a score.

The label table joins by broadcast of the bounded sample only.  Scoring is a narrow pass
over all rows, and a text's score depends on nothing but the text.  Edge cases: a null or
empty text has no evidence and the score of that; without labels of both classes a fixed
curve is used; a null doc_id is scored as any other; labels told twice count once, the
toxic one; repeated rows score alike; a very long text is scanned whole; an empty table
gives no rows; labels, lang, source, doc_id and other columns are never inputs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import packed as P

U64 = np.uint64
PREFIXES = (4, 5, 6)

#: Bound of learning: labelled rows that are counted; they bound the features, which are all kept.
SAMPLE = 40_000

#: Negative log of the chance below which a segment counts as significant: the usual 5 %, not tuned.
SIGNIFICANT = 3.0

#: Bound of lambda, so that a few lucky words do not count beyond all measure.
STEEPEST = 2.0

#: Segment score from which clean segments are counted to fit their law.
LEVEL = 2.0

_FEATURE = "key long, value double, z double"
_FEATURE_ARROW = pa.schema([("key", pa.int64()), ("value", pa.float64()), ("z", pa.float64())])
_LEVELS = np.dtype([("p4", "<u8"), ("p5", "<u8"), ("p6", "<u8"), ("w", "<u8"), ("y1", "<u4"), ("y0", "<u4")])
_BINS = np.arange(-12, 12.25, 0.25)

SCORED = "evidence double, score double, passages array<struct<first_word: long, last_word: long, score: double>>"


def keys_of(words: P.Words) -> list[np.ndarray]:
    """Feature keys of each word: its prefixes from the shortest, then the word."""
    out = [P.mix(P.span_hashes(words.data, words.starts, np.minimum(words.starts + k, words.ends)) + U64(k)) for k in PREFIXES]
    return [*out, P.mix(words.hashes() + U64(7))]


def _logit(p):
    return np.log(p) - np.log1p(-p)


def select_features(rows: np.ndarray, share: float, strength: float, min_z: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, value, z) of the features among word counts of _LEVELS; share is the toxic share of all words."""
    rows = rows[np.lexsort((rows["w"], rows["p6"], rows["p5"], rows["p4"]))]
    parent = np.full(len(rows), share)
    out = []
    names = ["p4", "p5", "p6", "w"]
    for depth in range(4):
        new = np.ones(len(rows), bool)
        new[1:] = np.logical_or.reduce([rows[n][1:] != rows[n][:-1] for n in names[: depth + 1]])
        at = np.flatnonzero(new)
        sizes = np.diff(np.append(at, len(rows)))
        y1 = np.add.reduceat(rows["y1"].astype(np.float64), at)
        y0 = np.add.reduceat(rows["y0"].astype(np.float64), at)
        above = parent[at]
        mine = (y1 + strength * above) / (y1 + y0 + strength)
        variance = 1 / (y1 + strength * above) + 1 / (y0 + strength * (1 - above))
        z = (_logit(mine) - _logit(above)) / np.sqrt(variance)
        told = np.abs(z) >= min_z
        if told.any():
            out.append((rows[names[depth]][at][told], _logit(mine[told]) - _logit(share), z[told]))
        parent = np.repeat(np.where(told, mine, above), sizes)
    if not out:
        return np.zeros(0, U64), np.zeros(0), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score), in linear time (Ruzzo and Tompa)."""
    found: list[list] = []  # first, end, sum before, sum after
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        mine = [i, i + 1, before, total]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= mine[2]:
                j -= 1
            if j < 0 or found[j][3] >= mine[3]:
                found.append(mine)
                break
            mine = [found[j][0], mine[1], found[j][2], mine[3]]
            del found[j:]
    return [(a, b, after - before) for a, b, before, after in found]


class Scorer:
    """Values of words, and the calibration."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, drift: float):
        order = np.argsort(keys)
        self.keys, self.values, self.drift = keys[order], values[order], drift
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.keys >> U64(42)).astype(np.int64)] = True
        self.rate, self.k, self.curve = 1.0, 1e-3, (-3.0, 1.0)

    def token_scores(self, words: P.Words) -> np.ndarray:
        out = np.full(len(words), -self.drift)
        if not len(self.keys):
            return out
        for key in keys_of(words):  # the most specific comes last
            at = np.flatnonzero(self.maybe[(key >> U64(42)).astype(np.int64)])
            slot = np.searchsorted(self.keys, key[at])
            slot[slot == len(self.keys)] = 0
            hit = self.keys[slot] == key[at]
            out[at[hit]] = self.values[slot[hit]] - self.drift
        again = np.zeros(len(words), bool)  # a word said again says nothing new
        again[1:] = key[1:] == key[:-1]
        again[words.first[:-1][words.counts() > 0]] = False
        out[again] = np.minimum(out[again], -self.drift)
        return out

    def passages(self, words: P.Words, scores: np.ndarray) -> list[list[tuple[int, int, float]]]:
        """Per text its maximal segments in words."""
        out: list[list] = [[] for _ in range(len(words.offsets) - 1)]
        up = np.flatnonzero(scores > 0)
        sums = np.concatenate(([0.0], np.cumsum(scores)))
        doc = np.searchsorted(words.first, up, side="right") - 1
        cuts = np.flatnonzero(np.diff(doc)) + 1
        for group, d in zip(np.split(up, cuts), doc[np.concatenate(([0], cuts))] if len(up) else [], strict=False):
            gaps = sums[group[1:]] - sums[group[:-1] + 1]  # the falling words between
            line = np.empty(2 * len(group) - 1)
            line[0::2], line[1::2] = scores[group], gaps
            base = words.first[d]
            for a, b, s in segments(line.tolist()):
                out[d].append((int(group[(a + 1) // 2] - base), int(group[(b - 1) // 2] - base), s))
        return out

    def evidence(self, found: list[tuple[int, int, float]], n: int) -> float:
        return sum(x for x in (self.significance(s, n) for _, _, s in found) if x >= SIGNIFICANT)

    def significance(self, s: float, n: int) -> float:
        """The negative log of the chance of such a segment in n clean words, about."""
        return self.rate * s - math.log1p(self.k * n)

    def fit_law(self, clean_histogram: np.ndarray, words: int, above: int) -> None:
        """The law of chance segments: of the histogram of clean word scores, and of ``above`` clean
        segments that score LEVEL or more in so many clean words."""
        middle = (_BINS[:-1] + _BINS[1:]) / 2
        p = clean_histogram / max(1, clean_histogram.sum())
        if (p[middle > 0] > 0).any() and (p * middle).sum() < 0:
            low, high = 1e-3, 8.0
            for _ in range(60):
                self.rate = (low + high) / 2
                low, high = (self.rate, high) if (p * np.exp(self.rate * middle)).sum() < 1 else (low, self.rate)
        self.rate = min(max(self.rate, 0.3), STEEPEST)
        if words:
            self.k = (above + 0.5) / (words * math.exp(-self.rate * LEVEL))

    def fit_curve(self, evidence: np.ndarray, label: np.ndarray) -> None:
        """The logistic curve of labels over evidence, by Newton steps with a small ridge."""
        if not 0 < label.sum() < len(label):
            return
        w = np.zeros(2)
        design = np.stack((np.ones(len(evidence)), np.minimum(evidence, 30.0)), axis=1)
        for _ in range(50):
            q = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
            grad = design.T @ (label - q) - 1e-2 * w
            hess = (design * (q * (1 - q))[:, None]).T @ design + 1e-2 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            w += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        self.curve = (float(w[0]), max(float(w[1]), 1e-3))

    def probability(self, evidence: float) -> float:
        a, b = self.curve
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * min(evidence, 30.0)))))


def learn(docs: DataFrame, labels: DataFrame, count: str, calibrate: str, sample: int = SAMPLE, drift: float = 0.5, strength: float = 12.0, min_z: float = 1.5, text: str = "text", doc_id: str = "doc_id", label: str = "toxic") -> Scorer:
    """Learn from labelled rows: those of the SQL condition ``count`` (over doc_id) are counted,
    those of ``calibrate`` calibrate.

    The defaults of drift, strength and min_z had the least log loss, summed over two tables, on
    one fold of labelled rows among the settings learned on three others; the held-out fold took
    no part.
    """
    spark = docs.sparkSession
    told = labels.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    told = told.select("doc_id", "y", F.expr(f"CASE WHEN {count} THEN 0 WHEN {calibrate} THEN 1 END").alias("part")).where("part is not null")
    n = told.count()
    if n > sample:
        told = told.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(sample / n * (1 << 20)))
    told = told.groupBy("doc_id").agg(F.max("y").alias("y"), F.max("part").alias("part"))
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = texts.join(F.broadcast(told), "doc_id").select("text", "y", "part")  # at most ``sample`` rows of 16 bytes

    buckets = max(4, P.partitions(spark) // 2)

    def count_words(stream):
        for table in stream:
            for part in P.pieces(table, "text"):
                y = part.column("y").to_numpy(zero_copy_only=False)
                data, offsets = P.utf8(part.column("text"))
                words = P.Words(data, offsets, lower=True)
                keys = keys_of(words)
                w, at, back = np.unique(keys[3], return_index=True, return_inverse=True)
                made = np.zeros(len(w), _LEVELS)
                for name, key in zip(("p4", "p5", "p6", "w"), keys, strict=True):
                    made[name] = key[at]
                doc = words.doc_of()
                _, once = np.unique(P.mix(keys[3] ^ P.mix(doc.astype(U64))), return_index=True)  # a word counts once a document
                toxic, back = y[doc[once]] == 1, back[once]
                made["y1"] = np.bincount(back[toxic], minlength=len(w))
                made["y0"] = np.bincount(back[~toxic], minlength=len(w))
                made = made[np.argsort(made["p4"], kind="stable")]
                cuts = P.bucket_cuts(made["p4"], buckets)
                out: dict[str, list] = {"bucket": [], "words": [], "y1": [], "y0": []}
                for b in np.flatnonzero(np.diff(cuts)):
                    mine = made[cuts[b] : cuts[b + 1]]
                    out["bucket"].append(int(b))
                    out["words"].append(mine.tobytes())
                    out["y1"].append(int(mine["y1"].sum()))
                    out["y0"].append(int(mine["y0"].sum()))
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("y1", pa.int64()), ("y0", pa.int64())]))

    P.ensure_checkpoint_dir(spark)
    counted = rows.where("part = 0").mapInArrow(count_words, "bucket int, words binary, y1 long, y0 long").checkpoint()
    sums = counted.agg(F.sum("y1"), F.sum("y0")).first()
    toxic, clean = sums[0] or 0, sums[1] or 0
    if not toxic or not clean:
        return Scorer(np.zeros(0, U64), np.zeros(0), drift)
    share = toxic / (toxic + clean)

    def features(table: pa.Table) -> pa.Table:
        made = np.concatenate([np.frombuffer(x, _LEVELS) for x in table.column("words").to_pylist()])
        made = made[np.argsort(made["w"], kind="stable")]
        new = np.ones(len(made), bool)
        new[1:] = made["w"][1:] != made["w"][:-1]
        at = np.flatnonzero(new)
        joined = made[at].copy()
        for name in ("y1", "y0"):
            joined[name] = np.add.reduceat(made[name].astype(np.int64), at)
        key, value, z = select_features(joined, share, strength, min_z)
        return pa.Table.from_arrays([pa.array(key.view(np.int64)), pa.array(value), pa.array(z)], schema=_FEATURE_ARROW)

    found = counted.groupBy("bucket").applyInArrow(features, _FEATURE)
    best = found.select("key", "value").toArrow()  # 16 bytes a feature
    scorer = Scorer(best.column("key").to_numpy().view(U64), best.column("value").to_numpy(), drift)

    def observe(stream):
        for table in stream:
            for part in P.pieces(table, "text"):
                y = part.column("y").to_numpy(zero_copy_only=False)
                words = P.Words(*P.utf8(part.column("text")), lower=True)
                scores = scorer.token_scores(words)
                clean_words = np.clip(scores[(y == 0)[words.doc_of()]], -11.9, 11.9)
                histogram = np.histogram(clean_words, _BINS)[0].tolist()
                got = scorer.passages(words, scores)
                made = [{"y": int(y[i]), "n": n, "s": [x[2] for x in got[i]], "h": [] if i else histogram} for i, n in enumerate(words.counts().tolist())]
                yield pa.RecordBatch.from_pylist(made, schema=seen_schema)

    seen_schema = pa.schema([("y", pa.int32()), ("n", pa.int64()), ("s", pa.list_(pa.float64())), ("h", pa.list_(pa.int64()))])
    seen = rows.where("part = 1").mapInArrow(observe, "y int, n long, s array<double>, h array<long>").checkpoint()
    histogram = np.zeros(len(_BINS) - 1)
    for r in seen.select(F.posexplode("h").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect():  # a row a bin
        histogram[r["bin"]] = r["n"]
    words, above = seen.where("y = 0").agg(F.sum("n"), F.sum(F.expr(f"size(filter(s, x -> x >= {LEVEL}))"))).first()
    scorer.fit_law(histogram, words or 0, above or 0)
    told = F.filter(F.transform("s", lambda x: x * scorer.rate - F.log1p(F.col("n") * scorer.k)), lambda x: x >= SIGNIFICANT)
    fitted = seen.select("y", F.aggregate(told, F.lit(0.0), lambda a, x: a + x).alias("e")).toArrow()  # at most ``sample`` rows of two numbers
    scorer.fit_curve(fitted.column("e").to_numpy(), fitted.column("y").to_numpy().astype(float))
    return scorer


def score(docs: DataFrame, scorer: Scorer, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, evidence, score, passages) of every row; passages are the segments with evidence."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # the features of the labelled sample and a 4 MB filter

    def run(stream):
        model = shared.value
        for rows in stream:
            for part in P.pieces(rows, "text"):
                data, offsets = P.utf8(part.column("text"))
                words = P.Words(data, offsets, lower=True)
                counts = words.counts().tolist()
                got = model.passages(words, model.token_scores(words))
                evidence = [model.evidence(g, n) for g, n in zip(got, counts, strict=True)]
                told = []
                for g, n in zip(got, counts, strict=True):
                    told.append([{"first_word": a, "last_word": b, "score": s} for a, b, s in g if model.significance(s, n) >= SIGNIFICANT])
                kind = pa.list_(pa.struct([("first_word", pa.int64()), ("last_word", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(evidence, pa.float64()), pa.array([model.probability(e) for e in evidence], pa.float64()), pa.array(told, kind)],
                    names=["doc_id", "n_words", "evidence", "score", "passages"],
                )

    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return slim.mapInArrow(run, f"doc_id long, n_words long, {SCORED}")
