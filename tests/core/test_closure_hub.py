"""The closure of a relation with one large component: pairs that lead over it are a product, pairs around it are walked."""

import random

import pytest

from caseloom.operators import closure
from tests.core.test_closure import plain_closure


@pytest.mark.parametrize("seed", [1])
def test_pairs_over_and_around_the_hub(spark, seed):
    """A ring that 25 vertices lead to and that leads to 25, with ways around it that are shorter, longer or as long."""
    r = random.Random(seed)
    edges = [(100 + i, 100 + (i + 1) % 9) for i in range(9)]
    edges += [(i, r.choice([100 + i % 9, r.randint(i + 1, 25)])) for i in range(25)] + [(r.choice([100 + i % 9, r.randint(200, 199 + i) if i else 100]), 200 + i) for i in range(25)]
    edges += [(r.randint(0, 24), r.randint(200, 224)) for _ in range(12)] + [(25, 104), (300, 301), (301, 302), (302, 301), (302, 303)]
    members, reach = closure.closure(spark.createDataFrame(edges + edges[:4], "src long, dst long"), parts=3)
    comp, hops = plain_closure([e for e in edges if e[0] != e[1]])
    assert {x["v_id"]: x["component"] for x in members.collect()} == comp
    got = [tuple(x) for x in reach.collect()]
    assert {(a, b): h for a, b, h in got} == hops and len(got) == len(hops) and len(hops) > 500
    few = [tuple(x) for x in closure.closure(spark.createDataFrame(edges, "src long, dst long"), most_hops=3)[1].collect()]
    assert sorted(few) == sorted((a, b, h) for (a, b), h in hops.items() if h <= 3)
