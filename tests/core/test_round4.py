"""What large tables cost, on small ones: rows that are shuffled, and results of what was changed for it."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseloom.operators import grid, identity, sides, trails
from caseloom.plans import catalog, searching

KEYS = ["n", "r"]


def shuffled(spark, df):
    """Rows that the jobs of ``df()`` write to shuffles."""
    jvm, store = spark._jvm, spark._jsc.sc().statusStore()

    def stages():
        found = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {found.apply(k).stageId(): found.apply(k).shuffleWriteRecords() for k in range(found.size())}

    before = stages()
    df().write.format("noop").mode("overwrite").save()
    spark._jsc.sc().listenerBus().waitUntilEmpty()
    return sum(n for k, n in stages().items() if k not in before)


def customers(spark, path, persons, accounts):
    """Tables of persons and accounts in 250 groups."""
    spark.range(persons).selectExpr("id as c_custkey", "'x' as c_name", "cast(id div 10 % 25 as int) as c_nationkey", "cast(id % 7 - 3 as double) as c_acctbal", "'s' as c_mktsegment").write.parquet(f"{path}/customer.parquet")
    spark.range(accounts).selectExpr("id as s_suppkey", "'y' as s_name", "cast(id div 10 % 25 as int) as s_nationkey", "0.0D as s_acctbal").write.parquet(f"{path}/supplier.parquet")


def test_pairs_of_blocks(spark):
    """Right rows in several blocks, left ones in arrays, sums where the pairs are; rows without a key make no pair."""
    left = [(k % 3, k % 2, f"p{k}", [k, k + 1]) for k in range(40)] + [(None, 1, "p", [7])]
    right = [(k % 3, k % 2, k if k % 50 else None, -k) for k in range(4 * sides.BLOCK)] + [(0, None, 5, 5)]
    x, y = spark.createDataFrame(left, "n int, r int, a string, of array<int>"), spark.createDataFrame(right, "n int, r int, b int, c int")
    want = Counter((a, k, b, c) for n, r, a, of in left for k in of for m, s, b, c in right if (n, r) == (m, s) and n is not None and r is not None)
    assert Counter(tuple(z) for z in sides.expanded(x, y, KEYS, unpack=("of",)).select("a", "of", "b", "c").collect()) == want
    one = sides.expanded(x, y.drop("c"), KEYS, parts=3, unpack=("of",)).select("a", "of", "b")
    assert Counter(tuple(z) for z in one.collect()) == Counter({k: n for k, n in Counter(z[:3] for z in want.elements()).items()})
    few = x.select(*KEYS, (F.length("a") % 2).alias("a"), F.col("of")[0].alias("of"))
    summed = sides.expanded(few, y.drop("c"), KEYS, sums=("of",)).select("a", "of", "b")
    total = Counter()
    for n, r, a, of in left:
        total[n, r, len(a) % 2] += of[0]
    assert Counter(tuple(z) for z in summed.collect()) == Counter((a, t, b) for (n, r, a), t in total.items() for m, s, b, _ in right if (n, r) == (m, s))


def test_copies_of_a_side(spark, tmp_path):
    """with many groups of like size the right side is not copied, and what is shuffled of it are blocks."""
    customers(spark, tmp_path, 5000, 1000)
    c, s = spark.read.parquet(f"{tmp_path}/customer.parquet"), spark.read.parquet(f"{tmp_path}/supplier.parquet")
    a, b = s.selectExpr("s_suppkey as account", "s_nationkey as n", "s_suppkey % 10 as r"), c.selectExpr("c_custkey as person", "c_nationkey as n", "c_custkey % 10 as r")
    assert shuffled(spark, lambda: sides.expanded(a, b, KEYS)) < 12_000  # 81,000 when 16 copies of each row were shuffled


@pytest.mark.parametrize(("name", "most"), [("g23_neighbourhood", 100_000), ("g18_shortest_paths", 60_000)])
def test_classes_are_shuffled_not_persons(spark, tmp_path, name, most):
    """seeds are shuffled as arrays with the classes that they reach; 770,000 and 367,000 rows were."""
    customers(spark, tmp_path, 20_000, 500)
    assert shuffled(spark, lambda: catalog.QUERIES[name](spark, str(tmp_path))) < most


def test_repointed_sides(spark):
    """as by the pairs, with persons of several groups merged, and accounts and persons in several groups."""
    rnd = random.Random(3)
    left = [(f"p{k}", rnd.randrange(3), rnd.randrange(2)) for k in range(60)] + [("p1", 0, 0), ("p1", 1, 1), (None, 0, 0), ("a7", 0, 1)]
    right = [(f"a{k}", rnd.randrange(3), rnd.randrange(2)) for k in range(20)] + [("a3", 0, 0), ("a3", 1, 1), ("a4", 2, 0), ("a5", None, 0), ("p9", 1, 1)]
    x, y = spark.createDataFrame(left, "src string, n int, r int"), spark.createDataFrame(right, "dst string, n int, r int")
    merged = spark.createDataFrame([(f"p{k}", f"p{k % 5}") for k in range(5, 30)] + [("p50", "p40")], "v_id string, into string")
    edges = sides.expanded(x, y, KEYS).select("src", "dst", F.lit("l").alias("label"))
    want = sorted(tuple(r) for r in identity.repointed(edges, merged).collect())
    got = sorted(tuple(r) for r in identity.repointed_sides(x, y, KEYS, "l", merged).collect())
    assert got == want and max(r[3] for r in got) > 2


def test_repointed_pairs_are_not_shuffled(spark, tmp_path):
    """384,000 rows were, nearly all of them pairs of persons and accounts."""
    customers(spark, tmp_path, 5000, 10_000)
    spark.range(100).selectExpr("id as o_orderkey", "id as o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    assert shuffled(spark, lambda: catalog.QUERIES["r31_repointed_edges"](spark, str(tmp_path))) < 100_000


def test_members_of_a_grid_go_to_few_sides(spark):
    """many small blocks, for which 38,000 rows were shuffled when a block was a side."""
    rnd = random.Random(1)
    rows = sorted({(rnd.randrange(9), m) for m in range(600) for _ in range(3)})
    df = spark.createDataFrame(rows, "key int, m long")
    sets = {m: {k for k, o in rows if o == m} for m in range(600)}
    want = {(a, b): len(sets[a] & sets[b]) for a in range(600) for b in range(a + 1, 600) if sets[a] & sets[b]}
    assert {(r.a, r.b): r.shared for r in grid.counts(df, "key", "m", 10).collect()} == want
    got = grid.common(df, "key", "m", 10).collect()
    assert len(got) == len(want) and {(r.a, r.b): (r.shared, r.least) for r in got} == {(a, b): (n, min(sets[a] & sets[b])) for (a, b), n in want.items()}
    assert shuffled(spark, lambda: grid.counts(df, "key", "m", 10)) < 10_000


def test_late_transfers_are_left_out(spark):
    """what all seeds already have is not joined with later transfers again; labels are those of plain rounds, times that are null included."""
    t = spark.createDataFrame([(1, 9, 5), (1, 9, 7), (1, 9, None), (1, 8, 50), (1, 7, 50)], "account long, to long, ts long")
    known = spark.createDataFrame([("p", 9, 3), ("q", 9, 6), ("p", 8, 4), ("p", 7, 4), ("q", 7, None)], "seed string, account long, before long")
    assert Counter(tuple(r) for r in trails.useful(t, known, 2).select("to", "ts").collect()) == Counter([(9, 5), (9, None), (8, 50), (7, 50)])
    rnd = random.Random(8)
    moves = {(rnd.randrange(12), rnd.randrange(12), rnd.randrange(40) if rnd.random() < 0.95 else None) for _ in range(150)}
    start = {(s, a) for s in "pqr" for a in rnd.sample(range(12), 2)}
    want, best, front = [], {}, {x: None for x in start}
    for n in range(1, 5):
        new = {}
        for (s, a), at in front.items():
            for src, dst, ts in moves:
                if src == a and (at is None or (ts is not None and ts > at)):
                    new.setdefault((s, dst), []).append(ts)
        new = {x: min((z for z in ts if z is not None), default=None) for x, ts in new.items()}
        front = {x: at for x, at in new.items() if best.get(x) is None or (at is not None and at < best[x])}
        best |= {x: at for x, at in front.items() if at is not None}
        want += [(*x, n, at) for x, at in front.items()]
    got = trails.trails(spark.createDataFrame(sorted(moves, key=str), "src long, dst long, ts long"), spark.createDataFrame(sorted(start), "seed string, account long"), 4)
    assert Counter(tuple(r) for r in got.collect()) == Counter(want)


def test_often(spark):
    """F8: pairs that meet often, without a row of each meeting; members are taken in several parts and blocks."""
    rnd = random.Random(2)
    rows = sorted({(rnd.randrange(40), rnd.randrange(120)) for _ in range(1500)} | {(0, m) for m in range(120)})
    sets = {m: {k for k, o in rows if o == m} for m in range(120)}
    df = spark.createDataFrame([*rows, (None, 3), (5, None)], "key int, m long")
    want = {(a, b): n for a in range(120) for b in range(a + 1, 120) if (n := len(sets[a] & sets[b])) >= 5}
    for block, most in ((13, 50), (13, 1 << 20), (500, 1000)):
        got = grid.often(df, "key", "m", 5, block, most).collect()
        assert len(got) == len(want) and {(r.a, r.b): r.shared for r in got} == want
    assert shuffled(spark, lambda: grid.often(df, "key", "m", 5, 13)) < sum(len(sets[a] & sets[b]) for a in sets for b in sets if a < b)


def test_transfers_are_stored_once(spark):
    """F8: three rules read the transfers, each by a window over all lines of its own before."""
    tables = "/root/testdata/sf0.001"
    if not os.path.isdir(tables):
        pytest.skip("the driver's tables are not here")
    assert "Window" not in searching.timed_graph(spark, tables)[1].filter("label = 'transferred_to'")._jdf.queryExecution().optimizedPlan().toString()
