"""Segments against brute force; held-out accuracy on invented words."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import toxicity


def brute_segments(scores):
    """Ruzzo and Tompa's definition by recursion: the best segment, then both sides."""
    if not any(s > 0 for s in scores):
        return []
    best = None
    for i in range(len(scores)):
        total = 0
        for j in range(i, len(scores)):
            total += scores[j]
            if best is None or total > best[0] or (total == best[0] and j - i < best[2] - best[1]):
                best = (total, i, j)
    total, i, j = best
    left = brute_segments(scores[:i])
    right = [(a + j + 1, b + j + 1, s) for a, b, s in brute_segments(scores[j + 1 :])]
    return [*left, (i, j + 1, total), *right]


def test_segments():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([-3.25, -1.5, -1.125, 0.75, 1.0625, 2.5, 4.03125]) + rng.randint(-99, 99) / 1024 for _ in range(rng.randint(0, 25))]
        got = toxicity.segments(scores)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]


def _table(spark, n=900):
    rng = random.Random(8)
    clean = ["w%d" % int(rng.paretovariate(0.5)) for _ in range(4000)]
    bad = ["vile", "nasty", "grubby"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 200))]
        toxic = int(rng.random() < 0.2)
        for _ in range(toxic * rng.randint(2, 5)):
            words.insert(rng.randint(0, len(words)), rng.choice([*bad, "zogru%d" % rng.randint(0, 10**6)]))
        rows.append((i, " ".join(words), "en"))
        labels.append((i, toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out(spark):
    docs, labels = _table(spark)
    fold = "crc32(CAST(doc_id AS string)) % 5"
    scorer = toxicity.learn(docs, labels, f"{fold} IN (1, 2, 3)", f"{fold} = 4")
    more = spark.createDataFrame([(5000, None, ""), (5001, "", ""), (None, "vile nasty vile nasty grubby", ""), (5002, "plain " * 3000, "")], docs.schema)
    out = {r.doc_id: r for r in toxicity.score(docs.union(more), scorer).collect()}
    truth = {r.doc_id: r.toxic for r in labels.where(f"{fold} = 0").collect()}
    right = sum((out[i].score >= 0.5) == bool(y) for i, y in truth.items())
    assert right >= 0.97 * len(truth)
    assert out[5000].score == out[5001].score < 0.5 <= out[None].score
    assert out[5002].score < 0.5 and not out[5002].passages
    assert all(p.first_word <= p.last_word for r in out.values() for p in r.passages)


def test_no_labels_and_empty(spark):
    docs, labels = _table(spark, 30)
    scorer = toxicity.learn(docs, labels.where(F.lit(False)), "true", "false")
    assert all(0 <= r.score < 0.5 for r in toxicity.score(docs, scorer).collect())
    assert toxicity.score(docs.limit(0), scorer).collect() == []


def test_all_features_are_kept(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "FEATURES", 1, raising=False)
    docs, labels = _table(spark)
    assert len(toxicity.learn(docs, labels, "true", "false").keys) > 1


class Slow:
    """Learning, scanning and calibration in plain Python, over the words themselves."""

    def __init__(self, counted, calibrated, strength=12.0, drift=1.0, min_z=1.5):
        self.drift = drift
        y = [Counter(), Counter()]
        for text, label in counted:
            y[label].update(set(self.words(text)))
        both = sorted(y[0].keys() | y[1].keys())
        toxic, clean = sum(y[1].values()), sum(y[0].values())
        share = toxic / (toxic + clean)
        logit = lambda p: math.log(p) - math.log1p(-p)
        parent, self.values = dict.fromkeys(both, share), {}
        for level in (4, 5, 6, 10**9):
            groups = defaultdict(list)
            for w in both:
                groups[tuple(w[:k] for k in (4, 5, 6, 10**9) if k <= level)].append(w)
            for members in groups.values():
                y1, y0, above = sum(y[1][w] for w in members), sum(y[0][w] for w in members), parent[members[0]]
                mine = (y1 + strength * above) / (y1 + y0 + strength)
                z = (logit(mine) - logit(above)) / math.sqrt(1 / (y1 + strength * above) + 1 / (y0 + strength * (1 - above)))
                if abs(z) >= min_z:
                    self.values[level, members[0][:level]] = logit(mine) - logit(share)
                    parent.update(dict.fromkeys(members, mine))
        histogram, words, above = [0] * (len(toxicity._BINS) - 1), 0, 0
        seen = []
        for text, label in calibrated:
            scores = self.scores(text)
            found = [s for _, _, s in brute_segments_fast(scores)]
            seen.append((label, len(scores), found))
            if not label:
                words += len(scores)
                above += sum(s >= toxicity.LEVEL for s in found)
                for s in scores:
                    histogram[int((min(max(s, -11.9), 11.9) + 12) / 0.25)] += 1
        middle = [-12 + 0.25 * (i + 0.5) for i in range(len(histogram))]

        def over(rate):
            return sum(n * math.exp(rate * m) for n, m in zip(histogram, middle)) / sum(histogram) >= 1

        low, high = 1e-3, 8.0
        while high - low > 1e-12:
            rate = (low + high) / 2
            low, high = (low, rate) if over(rate) else (rate, high)
        risen = any(n for n, m in zip(histogram, middle) if m > 0) and sum(n * m for n, m in zip(histogram, middle)) < 0
        self.rate = min(max(low if risen else 1.0, 0.3), toxicity.STEEPEST)
        self.k = (above + 0.5) / (words * math.exp(-self.rate * toxicity.LEVEL))
        x = [min(30.0, self.evidence(found, n)) for _, n, found in seen]
        a = b = 0.0
        for _ in range(200):
            q = [1 / (1 + math.exp(-(a + b * v))) for v in x]
            ga, gb = sum(s[0] - p for s, p in zip(seen, q)) - 0.01 * a, sum((s[0] - p) * v for s, p, v in zip(seen, q, x)) - 0.01 * b
            haa, hab, hbb = sum(p * (1 - p) for p in q) + 0.01, sum(p * (1 - p) * v for p, v in zip(q, x)), sum(p * (1 - p) * v * v for p, v in zip(q, x)) + 0.01
            det = haa * hbb - hab * hab
            da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
            a, b = a + max(-2, min(2, da)), b + max(-2, min(2, db))
        self.curve = a, b

    @staticmethod
    def words(text):
        return (text or "").encode().lower().split()

    def scores(self, text):
        out, before = [], None
        for w in self.words(text):
            s = -self.drift
            for level in (4, 5, 6, 10**9):
                s = self.values[level, w[:level]] - self.drift if (level, w[:level]) in self.values else s
            out.append(min(s, -self.drift) if w == before else s)
            before = w
        return out

    def evidence(self, found, n):
        told = [self.rate * s - math.log1p(self.k * n) for s in found]
        return sum(t for t in told if t >= toxicity.SIGNIFICANT)

    def score(self, text):
        scores = self.scores(text)
        e = self.evidence([s for _, _, s in brute_segments_fast(scores)], len(scores))
        return e, 1 / (1 + math.exp(-(self.curve[0] + self.curve[1] * min(e, 30.0))))


def brute_segments_fast(scores):
    """The definition over runs that hold a rise: what falls between is one number, as sums decide."""
    line, spans = [], []
    for i, s in enumerate(scores):
        if s > 0 or not line or line[-1] > 0:
            line.append(s)
            spans.append((i, i))
        else:
            line[-1] += s
            spans[-1] = (spans[-1][0], i)
    return [(spans[a][0], spans[b - 1][1], s) for a, b, s in brute_segments(line)]


def test_against_plain_python(spark):
    docs, labels = _table(spark, 400)
    labels = labels.withColumn("toxic", F.expr("CASE WHEN doc_id % 40 = 3 THEN 1 - toxic ELSE toxic END"))  # some clean texts with such words
    fold = "crc32(CAST(doc_id AS string)) % 5"
    scorer = toxicity.learn(docs, labels, f"{fold} IN (1, 2, 3)", f"{fold} = 4", strength=12.0, drift=1.0, min_z=1.5)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    part = {i: zlib.crc32(str(i).encode()) % 5 for i in texts}
    slow = Slow([(texts[i], truth[i]) for i in texts if part[i] in (1, 2, 3)], [(texts[i], truth[i]) for i in texts if part[i] == 4])
    assert len(slow.values) == len(scorer.keys)
    assert scorer.rate == pytest.approx(slow.rate, rel=1e-6) and scorer.k == pytest.approx(slow.k, rel=1e-6)
    assert scorer.curve == pytest.approx(slow.curve, rel=1e-4)
    for r in toxicity.score(docs, scorer).collect():
        e, p = slow.score(texts[r.doc_id])
        assert r.evidence == pytest.approx(e, rel=1e-6, abs=1e-9) and r.score == pytest.approx(p, rel=1e-4)


def test_alone_and_together(spark):
    """A text's score does not depend on the texts beside it."""
    docs, labels = _table(spark, 300)
    scorer = toxicity.learn(docs, labels, "doc_id % 3 > 0", "doc_id % 3 = 0")
    texts = ["vile", "vile", "", None, "vile vile nasty", "nasty", "nasty grubby vile nasty", "plain"] * 3
    rows = [(i, t) for i, t in enumerate(texts)]
    together = {r.doc_id: (r.score, r.evidence) for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), scorer).collect()}
    alone = {r.doc_id: (r.score, r.evidence) for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(len(rows), "doc_id"), scorer).collect()}
    backwards = {r.doc_id: (r.score, r.evidence) for r in toxicity.score(spark.createDataFrame(rows[::-1], "doc_id long, text string").coalesce(1), scorer).collect()}
    assert together == alone == backwards
    assert len({together[i] for i, t in enumerate(texts) if t == "vile"}) == 1 and together[0][1] > 0
