"""The prefix trie against one built of whole texts: random conversations, nulls, ties, repeated rows, long and hot conversations."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from caseloom.llm import prefix_trie as pt

SCHEMA = "conv_id long, turn long, role string, text string"


def built(df, **kw):
    c = F.col("conv_id")
    return [tuple(r) for r in pt.prefix_trie(df, c - c % 5, F.crc32(c.cast("string")) % 9, 8, **kw).collect()]


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            convs[c].append((turn is not None, turn or 0, role or "", text or ""))
    for c in convs:
        convs[c] = [x[2:] for x in sorted(convs[c])]
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        rebuilt[c] = convs.get(base, [])[:h] + turns[h:]
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(rebuilt):
        t = tuple(rebuilt[c])
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
        ends[t].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        leaves = sum(totals[q][0] for q in children[p]) or 1
        saved = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) + sum(totals[q][1] for q in children[p])
        totals[p] = (leaves, saved)
    sha = lambda p: hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest()
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), *totals[p], sha(p)) for p, m in members.items())


def same(got, want):
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)


def conversations(n, seed, texts=4):
    r = random.Random(seed)
    return [(c, k, r.choice(["user", "assistant"]) if r.random() < 0.2 else ("user", "assistant")[k % 2], f"text {r.randint(0, texts)} é" * r.randint(1, 2)) for c in range(n) if c % 11 != 5 for k in range(r.randint(1, 12))]


def test_matches_whole_texts(spark):
    rows = conversations(120, 1)
    want = brute(rows)
    assert max(r[3] for r in want if r[1]) > 5
    same(built(spark.createDataFrame(rows, SCHEMA).repartition(4)), want)


def test_odd_rows(spark):
    rows = conversations(30, 2) + [(None, 0, "user", "x"), (40, None, "user", "null turn"), (40, None, None, None), (40, 1, "user", ""), (40, 1, "assistant", "b"), (40, 1, "assistant", "b"), (41, 3, "us", "era"), (42, 3, "use", "ra"), (-3, 0, "user", "y"), (-5, 0, "user", "z"), (-5, 1, "user", "w"), (10**15, 0, "user", "big"), (10**15 + 1, 5, "user", "long " * 100_000)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("at", "part", "row", "depth", "fp", "base", "h", "n", "heads", "i")}).repartition(3)
    same(built(df), brute(rows))
    assert built(spark.createDataFrame([], SCHEMA)) == []
    same(built(spark.createDataFrame([(7, 0, "user", "only")], SCHEMA)), brute([(7, 0, "user", "only")]))


def test_hot_conversation_and_equal_conversations(spark):
    """A third of all turns in one conversation, over several parts; a third of all conversations equal."""
    rows = conversations(60, 3) + [(1003, k, "user", f"turn {k % 7}") for k in range(400)] + [(2000 + k, t, "user", f"same {t}") for k in range(60) for t in range(3)]
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        turns = pt._turns(spark.createDataFrame(rows, SCHEMA), ("conv_id", "turn", "role", "text"), b"")
        assert turns.filter("conv_id = 1003").select("part").distinct().count() > 2
        same(built(spark.createDataFrame(rows, SCHEMA)), brute(rows))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_long_running_sums_and_digests_by_chunks(spark, monkeypatch):
    monkeypatch.setattr(pt, "DEPTH_BITS", 1)
    monkeypatch.setattr(pt, "ID_BITS", 2)
    rows = conversations(50, 4) + [(300 + k, t, "user", f"same {t}") for k in range(20) for t in range(10)]
    same(built(spark.createDataFrame(rows, SCHEMA)), brute(rows))


def test_a_collision_stops_the_job(spark, monkeypatch):
    monkeypatch.setattr(pt, "turn_digest", lambda role, text, seed=b"": 5)
    with pytest.raises(ArithmeticError):
        built(spark.createDataFrame([(1, 0, "user", "a"), (2, 0, "user", "b"), (6, 0, "user", "c"), (7, 0, "user", "d"), (8, 0, "user", "d"), *[(c, t, "user", f"{c} {t}") for c in range(20, 30) for t in range(9)]], SCHEMA))
