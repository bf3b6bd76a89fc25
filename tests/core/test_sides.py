"""Relations kept as the two sides of their groups, against their pairs; keys that occur in several groups included."""

import random
from collections import Counter, defaultdict

import pytest

from caseloom.operators import sides


@pytest.fixture(scope="module")
def both(spark):
    rnd = random.Random(5)
    left = [(f"p{m}", rnd.randrange(6)) for m in range(30)] + [("p1", 1), ("p1", 2), ("p2", 9), ("p3", None)]
    right = [(f"a{m}", rnd.randrange(6)) for m in range(12)] + [("a1", 1), ("a1", 2), ("a4", 8), ("a5", None)]
    pairs = [(x, y) for x, n in left for y, k in right if n is not None and n == k]
    return spark.createDataFrame(left, "person string, n int"), spark.createDataFrame(right, "account string, n int"), pairs


def test_counts(both):
    left, right, pairs = both
    assert Counter(tuple(r) for r in sides.expanded(left, right, ["n"]).select("person", "account").collect()) == Counter(pairs)
    assert [r.n for r in sides.total(left, right, ["n"]).collect()] == [len(pairs)]
    assert sides.total(left.limit(0), right, ["n"]).count() == 0
    assert {r.person: r.n for r in sides.degrees(left, "person", right, ["n"]).collect()} == Counter(x for x, _ in pairs)


def test_classes_and_walks(both):
    left, right, pairs = both
    members, table = sides.classes(left, "person", right, "account", ["n"])
    back = members.join(table, "cls").select("person", "account").collect()
    assert Counter(tuple(r) for r in back) == Counter(pairs)
    of, at = defaultdict(set), defaultdict(set)
    for x, y in pairs:
        of[x].add(y)
        at[y].add(x)
    want = {(x, z) for x in of for y in of[x] for w in at[y] - {x} for z in of[w] - {y}}
    got = [tuple(r) for r in sides.third_ends(members, "person", table, "account").collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_copies_are_not_broadcast(spark, both, tmp_path):
    """The right side is copied to all parts, which Spark does not count when it takes a table for small enough to go through the driver."""
    left, right, pairs = both
    for name, side in (("left", left), ("right", right)):
        side.write.parquet(f"{tmp_path}/{name}")
    d = sides.expanded(spark.read.parquet(f"{tmp_path}/left"), spark.read.parquet(f"{tmp_path}/right"), ["n"])
    assert "Broadcast" not in d._jdf.queryExecution().executedPlan().toString()
    assert Counter(tuple(r) for r in d.select("person", "account").collect()) == Counter(pairs)
