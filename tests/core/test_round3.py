"""Faults that only larger tables showed, on small ones."""

import random
from collections import Counter
from itertools import combinations

from caseloom.operators import inference
from caseloom.operators.pairs import sharing_two
from caseloom.plans import catalog


def test_equal_balances_are_not_merged(spark, tmp_path):
    """Two debtors in a row are one person, two persons of equal balance are not."""
    tables = {
        "customer": ([(k, "n", 1, b, "s") for k, b in ((1, 5.0), (2, 5.0), (3, -1.0), (4, -2.0), (5, 7.0))], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"),
        "supplier": ([(11, "x", 2, 0.0)], "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"),
        "orders": ([(k, k) for k in range(1, 6)], "o_orderkey long, o_custkey long"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    got = {(r.src, r.dst) for r in catalog.QUERIES["r31_repointed_edges"](spark, str(tmp_path)).collect()}
    assert got == {(f"vt_case:{k}", f"vt_psn:{into}") for k, into in ((1, 1), (2, 2), (3, 3), (4, 3), (5, 5))}


def test_all_cases_of_an_account(spark, tmp_path):
    """Every case is in the list, not five of them."""
    spark.createDataFrame([(k, 7) for k in (1, 2, 3, 10, 20, 30, 30)], "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert [tuple(r) for r in catalog.QUERIES["a7_distinct_collections"](spark, str(tmp_path)).collect()] == [(7, 6, "1,10,2,20,3,30")]


def test_sharing_two(spark):
    rnd = random.Random(11)
    rows = {(rnd.randrange(40), m) for m in range(60) for _ in range(rnd.choice((1, 3, 6, 20)))}
    of = {}
    for k, m in rows:
        of.setdefault(m, set()).add(k)
    want = {(a, b, len(of[a] & of[b])) for a, b in combinations(sorted(of), 2) if len(of[a] & of[b]) >= 2}
    df = spark.createDataFrame(sorted(rows) + [(None, 3), (4, None)], "key long, m long")
    for most in (3, 10, 100):
        assert Counter(tuple(r) for r in sharing_two(df, "key", "m", most).collect()) == Counter(want)


def test_accounts_over_a_class(spark):
    """Things of what a person is a member of count as the person's own, each once."""
    edges = [("p1", "i", "used_ip"), ("p2", "i", "used_ip"), ("p1", "g", "member_of"), ("p2", "g", "member_of"), ("g", "a1", "holds"), ("g", "a2", "holds"), ("p2", "a2", "has_account"), ("p2", "t", "owns_phone")]
    df = spark.createDataFrame(edges, "src string, dst string, label string")
    assert [r.n for r in inference.cross_domain(df, df, 2).collect()] == [3]
