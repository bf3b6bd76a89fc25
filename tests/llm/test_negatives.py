"""Hard negatives against a plain loop: random rows, and nulls, ties, copies, odd lengths, repeated rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseloom.llm import hard_negatives as hn

LABEL = "CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END"
SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, n_positives=5, n_negatives=3):
    """rows: [(vec_id, label, vector)] -> sorted result tuples."""
    used = []
    for i, label, x in rows:
        if label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        used.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, [math.floor(256 * float(np.float32(v))) for v in x]))
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for i, label, x in {(i, label, tuple(x)) for i, label, x in used if i is not None and i % 50 == 0}:
        scored = [(sum(a * b for a, b in zip(x, y)), j, other == label) for j, other, y in used if j != i]
        for p, j, _ in sorted((s for s in scored if s[2]), key=order)[:n_positives]:
            near = sorted((s for s in scored if not s[2] and 50 * p <= 100 * s[0] <= 95 * p), key=order)[:n_negatives]
            out += [(i, j, rank + 1, k, p, s) for rank, (s, k, _) in enumerate(near)]
    return sorted(out, key=str)


def mined(df, **kw):
    return sorted((tuple(r) for r in hn.hard_negatives(df, F.col("vec_id") % 50 == 0, F.expr(LABEL), **kw).collect()), key=str)


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(1)
    x = r.normal(0, 0.13, (420, 19)).astype(np.float32)
    x[100:140] = x[7]  # copies: ties by vec_id
    return [(i, int(r.integers(0, 3)) if i < 300 else 1, v.tolist()) for i, v in enumerate(x)]


def test_matches_a_plain_loop(spark, vectors):
    df = spark.createDataFrame(vectors, SCHEMA).repartition(5)
    want = brute(vectors)
    assert want and mined(df) == want
    assert mined(df, part_rows=(3, 64)) == want  # many parts of anchors and candidates


def test_odd_rows(spark, vectors):
    odd = vectors[:120] + [(200, None, [0.1] * 19), (250, 1, None), (300, 1, [0.1, None]), (350, 1, [float("nan")] * 3), (51, 2, [float("inf")]), (52, 2, []), (400, 1, []), (53, 1, [0.5] * 40), (450, 2, [0.4] * 33), (None, 1, [0.3] * 19), (None, 2, [0.3] * 19), vectors[50], vectors[50], vectors[3], vectors[3], vectors[60]]
    df = spark.createDataFrame(odd, SCHEMA).withColumns({c: F.lit(1) for c in ("x", "part", "rank", "a_key", "planes", "place")}).repartition(4)
    assert mined(df) == brute(odd)
    assert mined(spark.createDataFrame([], SCHEMA)) == [] and mined(spark.createDataFrame(vectors[1:40], SCHEMA)) == []


def test_wide_numbers(spark):
    r = random.Random(2)
    rows = [(i, i % 2, [r.uniform(-90_000, 90_000) for _ in range(8)]) for i in range(60)]
    rows = [(i, label, [float(np.float32(v)) for v in x]) for i, label, x in rows]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)
    with pytest.raises(ArithmeticError):
        mined(spark.createDataFrame([(0, 1, [1e30]), (1, 1, [1e30])], SCHEMA))


@pytest.mark.parametrize("bits", [1, 2, 9, 20])
def test_lookups_are_inner_products(bits):
    r = np.random.default_rng(bits)
    low, high = -(1 << (bits - 1)), (1 << (bits - 1)) - 1
    a, c = r.integers(low, high, (5, 24), endpoint=True), r.integers(low, high, (50, 24), endpoint=True)
    assert np.array_equal(hn.scores(hn.subset_sums(a.astype(np.int64)), hn.bit_planes(c, bits)), c @ a.T)


def test_best_keeps_the_order_of_ties():
    s = np.array([3, 9, 9, 1, 9, 3])
    assert hn.best(s, np.arange(6), 2).tolist() == [1, 2] and hn.best(s, np.array([0, 3, 5]), 2).tolist() == [0, 5] and hn.best(s, np.zeros(0, int), 2).tolist() == []
