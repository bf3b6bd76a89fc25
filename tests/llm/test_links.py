"""The Gray-order index against all pairs, and the pipeline against its parts."""

import numpy as np
from pyspark.sql import functions as F

from caseloom.llm import simhash


def roots(nodes, pairs):
    parent = {int(v): int(v) for v in nodes}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in pairs:
        a, b = find(int(a)), find(int(b))
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {int(v): find(int(v)) for v in nodes}


def clusters(seed, groups=20, each=40):
    rng = np.random.default_rng(seed)
    out = []
    for base in rng.integers(0, 2**63, groups, dtype=np.uint64):
        for _ in range(each):
            m = np.uint64(0)
            for k in rng.integers(0, 64, rng.integers(0, 5)):
                m ^= np.uint64(1) << np.uint64(k)
            out.append(base ^ m)
    return np.unique(np.array(out, np.uint64))


def test_links_lose_nothing(spark):
    x = clusters(1)
    want = roots(x, [(a, b) for i, a in enumerate(x) for b in x[:i] if int(a ^ b).bit_count() <= 4])
    assert roots(x, simhash.bucket_links(x, None, 4)) == want
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    for kw in ({}, {"bucket_rows": 9}, {"blocks": 7}):
        got = [(np.uint64(r["a"] % 2**64), np.uint64(r["b"] % 2**64)) for r in simhash.links(df, 4, **kw).collect()]
        assert roots(x, got) == want


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)]
    got = {r["node"]: r["root"] for r in simhash.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert set(got.values()) == {0, 1000} and len(got) == 249


def test_keep_one_knows_rows_by_id_and_text(spark):
    a, b, c, d = (" ".join(f"{x}{i * k % 97}" for i in range(60)) for x, k in (("river", 5), ("stone", 7), ("walk", 11), ("night", 13)))
    rows = [(5, a), (5, b), (3, b), (None, c), (None, d), (None, d), (None, b), (7, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("text_key", F.lit(1)).repartition(3)
    out = simhash.keep_one(df)
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert out.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=key) == sorted([(5, a), (3, b), (None, c), (None, d), (7, None)], key=key)


def test_one_index_for_buckets_of_every_size(spark):
    """Hundreds of buckets of 1 to 60 rows in one search, and pairs of parts; each against all pairs of its own rows."""
    rng = np.random.default_rng(8)
    fps, tree, want = [], [], set()
    for t in range(300):
        base = rng.integers(0, 2**63, dtype=np.uint64)
        own = np.unique(np.array([base ^ np.uint64(sum(1 << int(k) for k in rng.choice(64, rng.integers(0, 8), replace=False))) for _ in range(rng.integers(1, 60))], np.uint64))
        fps.append(own)
        tree += [t] * len(own)
    left, right = np.arange(0, 300, 2), np.where(np.arange(150) % 3 == 0, np.arange(0, 300, 2), np.arange(1, 300, 2))
    fps[11] = fps[10] ^ np.uint64(1)  # a pair of parts with links
    right[5] = 11
    tree = np.repeat(np.arange(300), [len(x) for x in fps])
    got = simhash.forest_links(tree, np.concatenate(fps), left, right, 4)
    for a, b in zip(left, right):
        pairs = [(x, y) for x in fps[a] for y in fps[b] if x != y and int(x ^ y).bit_count() <= 4]
        nodes = np.unique(np.concatenate((fps[a], fps[b])))
        mine = [(x, y) for x, y in got if x in nodes and y in nodes]
        assert roots(nodes, mine) == roots(nodes, pairs)
        want.add(bool(pairs))
    assert want == {True, False}


def test_a_large_family_of_close_fingerprints(spark):
    """20,000 fingerprints in one bucket, all linked: no loop over pairs in Python."""
    base = np.uint64(0x0123456789ABCDEF)
    rng = np.random.default_rng(4)
    masks = np.unique(np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (20_000, 2), dtype=np.uint64), 1))
    found = simhash.bucket_links(base ^ masks, None, 4)
    assert len(found) == len(masks) - 1


def test_many_counted_differences_do_not_wrap():
    x = np.array([0, 2**64 - 1, 2**63], np.uint64)
    assert [sorted(map(int, p)) for p in simhash.bucket_links(x, None, 4)] == [[0, 2**63]]
