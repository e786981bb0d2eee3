"""The prefix trie against a plain version, with weak fingerprints, long conversations and odd tables."""

import hashlib
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import prefixes


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    nodes, ends = {}, {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        full = own.get(c - int(math.fmod(c, 5)), [])[:h] + turns[h:]
        for d in range(len(full) + 1):
            nodes.setdefault(tuple(full[:d]), []).append(c)
        ends.setdefault(tuple(full), []).append(c)
    children, below = {}, {}
    for p in nodes:
        if p:
            children[p[:-1]] = children.get(p[:-1], 0) + 1
    for p, members in nodes.items():
        saves = (len(members) - 1) * len(p[-1][1].encode()) if p else 0
        for d in range(len(p) + 1):
            at = below.setdefault(p[:d], [0, 0])
            at[0] += p not in children
            at[1] += saves
    digest = lambda p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(nodes[p[:-1]]) if p else None, len(m), children.get(p, 0), *below[p], digest(p)) for p, m in nodes.items()), key=str)


def result(spark, rows, bits=64):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3)
    return sorted(map(tuple, prefixes.prefix_trie(df, bits).collect()), key=str)


def made(rng, convs, words=4):
    """Conversations of few different turns, so that many prefixes are shared."""
    return [(c, t, rng.choice(["user", None, "bot"]), rng.choice(["é", "b", "", None, "long text"][:words])) for c in range(convs) for t in range(rng.randrange(1, 14))]


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = made(rng, 70) + [(None, 1, "user", "no conversation"), (7, None, "user", "null turn"), (7, None, "bot", "null turn"), (8, 3, "user", "tie"), (8, 3, "bot", "tie"), (8, 3, "bot", "tie"), (-7, 0, "user", "b"), (-5, 0, "user", "b"), (1003, 0, "user", "b")]
    rows += [(200 + i, t, "user", "same") for i in range(40) for t in range(3)]
    assert result(spark, rows) == brute(rows)


@pytest.mark.parametrize("bits", [0, 1, 3])
def test_colliding_fingerprints_are_split(spark, bits):
    rows = [r for r in made(random.Random(2), 14, 2) if r[1] < 5]
    assert result(spark, rows, bits) == brute(rows)


def test_a_conversation_of_most_rows(spark):
    """Its turns lie in several partitions of the scan."""
    rng = random.Random(3)
    rows = [(c, t, "user", str(rng.randrange(3))) for c in (5, 6) for t in range(400)] + made(rng, 10, 3)
    rows += [(c, t, "user", str(t % 7)) for c in (50, 55, 60) for t in range(150)]  # the same after different heads
    assert result(spark, rows) == brute(rows)


def test_scan_by_hand(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice([1, 2, 2, 2, 2, 3]), rng.randrange(-(1 << 63), 1 << 63), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k long, v long, at long").repartition(3)
    got = prefixes.running(df, "k", [F.desc("at")], {"v": prefixes.BASE}, str(tmp_path / "scan")).collect()
    sums = {}
    for r in sorted(got, key=lambda r: (r.k, -r.at)):
        n, total = sums.get(r.k, (0, 0))
        after = (total + r.v * pow(prefixes.BASE, n, 1 << 64)) % (1 << 64)
        assert (r.pos, r.v_before % (1 << 64), r.v_after % (1 << 64)) == (n, total, after)
        sums[r.k] = (n + 1, after)
    assert len(got) == 300


def test_edges(spark):
    """An empty table, one turn, a very long text, clashing columns."""
    assert result(spark, []) == []
    rows = [(3, 1, "user", "x" * 2_000_000)]
    assert result(spark, rows) == brute(rows)
    df = spark.createDataFrame([(3, 1, "user", "x", 1, 2, 3)], "conv_id long, turn long, role string, text string, pos int, depth int, fp int")
    assert sorted(map(tuple, prefixes.prefix_trie(df).collect()), key=str) == brute([(3, 1, "user", "x")])
