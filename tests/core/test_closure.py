"""Directed closure, time-respecting trails, bounded cycles and identity chains against plain Python on random graphs."""

import random
from collections import defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from caseloom.operators import closure, identity, trails


def reachable(edges):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    found = {}
    for v in {x for e in edges for x in e}:
        seen, todo = set(), list(out[v])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += out[x]
        found[v] = seen
    return found


def plain_closure(edges):
    reach = reachable(edges)
    comp = {v: min([v, *(u for u in reach[v] if v in reach[u])]) for v in reach}
    step = defaultdict(set)
    for a, b in edges:
        if comp[a] != comp[b]:
            step[comp[a]].add(comp[b])
    hops = {}
    for c in set(comp.values()):
        if sum(x == c for x in comp.values()) > 1:
            hops[c, c] = 0
        front, seen, n = {c}, {c}, 0
        while front:
            n += 1
            front = {y for x in front for y in step[x]} - seen
            seen |= front
            hops |= {(c, y): n for y in front}
    return comp, hops


@pytest.mark.parametrize("seed,n,m", [(2, 30, 45), (3, 25, 20)])
def test_closure_with_cycles(spark, seed, n, m):
    r = random.Random(seed)
    edges = [(r.randint(0, n), r.randint(0, n)) for _ in range(m)] + [(100, 101), (101, 102), (102, 100), (102, 103), (5, 5)]
    edges = [e for e in edges if e[0] != e[1]]
    members, reach = closure.closure(spark.createDataFrame(edges + [(5, 5)] + edges[:3], "src long, dst long"))
    comp, hops = plain_closure(edges)
    assert {r["v_id"]: r["component"] for r in members.collect()} == comp
    got = [(r["src"], r["dst"], r["hops"]) for r in reach.collect()]
    assert {(a, b): h for a, b, h in got} == hops and len(got) == len(hops)


def test_a_large_component_is_one_vertex(spark):
    """A ring of 14 with a tail of three: one pair for the ring itself, not 196."""
    edges = [(i, (i + 1) % 14) for i in range(14)] + [(7, 100), (100, 101), (101, 102)]
    members, reach = closure.closure(spark.createDataFrame(edges, "src long, dst long"))
    assert members.filter("component = 0").count() == 14
    assert sorted(tuple(r) for r in reach.collect()) == [(0, 0, 0), (0, 100, 1), (0, 101, 2), (0, 102, 3), (100, 101, 1), (100, 102, 2), (101, 102, 1)]
    assert closure.closure(spark.createDataFrame([], "src long, dst long"))[1].count() == 0


def test_trails_drop_dominated_labels(spark):
    r = random.Random(6)
    t = [(r.randint(0, 9), r.randint(0, 9), r.randint(0, 40)) for _ in range(70)]
    got = {(x["seed"], x["account"], x["steps"], x["arrives"]) for x in trails.trails(spark.createDataFrame(t, "src long, dst long, ts long"), spark.createDataFrame([("p", 1), ("p", 2), ("q", 3)], "seed string, account long"), 4).collect()}
    want = set()
    for seed, starts in (("p", [1, 2]), ("q", [3])):
        walks = {(a, None) for a in starts}
        best = {}
        for n in range(1, 5):
            walks = {(d, ts) for a, at in walks for s, d, ts in t if s == a and (at is None or ts > at)}
            for account in {a for a, _ in walks}:
                first = min(ts for a, ts in walks if a == account)
                if first < best.get(account, 10**9):
                    best[account] = first
                    want.add((seed, account, n, first))
    assert got == want and {x[2] for x in got} >= {1, 2, 3}


def test_cycles_of_three_to_five(spark):
    r = random.Random(8)
    edges = {(g, a, b) for g in range(6) for a, b in ((r.randint(0, 7), r.randint(0, 7)) for _ in range(20)) if a != b}
    got = sorted((x["grp"], x["size"], tuple(x["members"])) for x in trails.cycles(spark.createDataFrame(list(edges), "grp long, src long, dst long")).collect())
    want = sorted((g, k, c) for g in range(6) for k in (3, 4, 5) for c in permutations(range(8), k) if c[0] == min(c) and all((g, c[i], c[(i + 1) % k]) in edges for i in range(k)))
    assert got == want and {x[1] for x in want} == {3, 4, 5}
    assert trails.cycles(spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 4, 4)], "grp long, src long, dst long")).count() == 0


def test_chain_confidence_is_the_best_product(spark):
    r = random.Random(9)
    links = [(r.randint(0, 12), r.randint(0, 12), round(r.choice([1.0, 0.9, 0.8, 0.7, 0.4]), 2)) for _ in range(40)]
    got = {(x["src"], x["dst"]): (x["confidence"], x["steps"]) for x in identity.chain_confidence(spark.createDataFrame(links, "src long, dst long, confidence double"), 0.5, 4).collect()}
    best, walks = {}, {(a, a, 1.0) for a in range(13)}
    for n in range(1, 5):
        walks = {(s, d, c * x) for s, at, c in walks for a, d, x in links if a == at and a != d and x >= 0.5 and c * x >= 0.5}
        for s, d, c in walks:
            if s != d and c > best.get((s, d), (0, 0))[0] + 1e-12:
                best[s, d] = (c, n)
    assert {k: (round(c, 9), n) for k, (c, n) in got.items()} == {k: (round(c, 9), n) for k, (c, n) in best.items()}
    assert any(n >= 3 for _, n in got.values())


def test_certain_identities_merge_over_chains(spark):
    links = spark.createDataFrame([("b", "a", 1.0), ("c", "b", 1.0), ("e", "d", 0.99), ("g", "f", 1.0)], "src string, dst string, confidence double")
    merged = identity.merged_ids(links)
    assert {r["v_id"]: r["into"] for r in merged.collect()} == {"b": "a", "c": "a", "g": "f"}
    edges = spark.createDataFrame([("x", "c", "l"), ("x", "b", "l"), ("x", "a", "l"), ("a", "c", "l"), ("g", "x", "m"), ("e", "d", "l")], "src string, dst string, label string")
    assert sorted(tuple(r) for r in identity.repointed(edges, merged).collect()) == [("e", "d", "l", 1), ("f", "x", "m", 1), ("x", "a", "l", 3)]
    assert identity.repointed(edges, merged.limit(0)).agg(F.sum("n")).first()[0] == 6
