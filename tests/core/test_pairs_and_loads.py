"""Hot keys of pair joins, paths that meet half way, stored graphs, merged loads, records and metadata, on small rows."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from caseloom.functions import mapping, metadata
from caseloom.operators import graph as g
from caseloom.operators import paths
from caseloom.operators.pairs import linked
from caseloom.sources import csv, records
from caseloom.sources.store import Store


def test_pairs_of_a_hot_key_match_brute_force(spark):
    r = random.Random(2)
    rows = {("hot", m) for m in range(60)} | {(f"k{r.randrange(30)}", r.randrange(60)) for _ in range(200)} | {("alone", 3)}
    weight = {(k, m): r.randrange(9) for k, m in sorted(rows)}
    df = spark.createDataFrame([(k, m, w) for (k, m), w in weight.items()] + [(None, 1, 1), ("k1", None, 1)], "key string, m long, w long")
    for least, block in ((1, 500), (1, 7), (3, 7)):
        got = linked(df, ["key"], "m", least, ("w",), block).collect()
        by = {}
        for k, m in rows:
            by.setdefault(k, []).append(m)
        every = {(k, a, b, weight[k, a], weight[k, b]) for k, ms in by.items() for a, b in itertools.combinations(sorted(ms), 2)}
        found = {(x["key"], x["a"], x["b"], x["w_a"], x["w_b"]) for x in got}
        assert len(found) == len(got) and found <= every
        shared, want = Counter((a, b) for _, a, b, _, _ in found), Counter((a, b) for _, a, b, _, _ in every)
        assert {p: n for p, n in shared.items() if n >= least} == {p: n for p, n in want.items() if n >= least}
    assert linked(df.limit(0), ["key"], "m").count() == 0


def test_a_hot_key_is_spread_over_tasks(spark):
    df = spark.range(400).select(F.lit("hot").alias("key"), F.col("id").alias("m"))
    pairs = linked(df, ["key"], "m", block=20)
    assert pairs.count() == 400 * 399 // 2
    per_task = [r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(per_task) > 1 and max(per_task) < 400 * 399 // 2


def breadth_first(edges, a, b, hops):
    near = {}
    for x, y in edges:
        near.setdefault(x, set()).add(y)
        near.setdefault(y, set()).add(x)
    seen, front = {a}, {a}
    for n in range(hops + 1):
        if b in front:
            return n
        front = {y for x in front for y in near.get(x, ())} - seen
        seen |= front
    return None


def test_paths_meet_half_way(spark):
    r = random.Random(4)
    edges = sorted({(f"v{r.randrange(40)}", f"v{r.randrange(40)}") for _ in range(45)})
    df = spark.createDataFrame([(a, b, "e") for a, b in edges], "src string, dst string, label string")
    wanted = [(f"v{r.randrange(40)}", f"v{r.randrange(40)}") for _ in range(30)] + [("v1", "v1"), ("nowhere", "v1")]
    pairs = spark.createDataFrame(wanted, "a string, b string")
    step = {(a, b) for a, b in edges} | {(b, a) for a, b in edges}
    for hops in (5, 6):
        got = {(x["a"], x["b"]): x for x in paths.shortest(df, pairs, hops).collect()}
        for a, b in set(wanted):
            want = breadth_first(edges, a, b, hops) if a != b else 0
            assert ((a, b) in got) == (want is not None), (a, b)
            if want is not None:
                path = got[a, b]["path"]
                assert got[a, b]["hops"] == want == len(path) - 1 and (path[0], path[-1]) == (a, b)
                assert all(p in step for p in zip(path, path[1:]))


def test_components_that_do_not_settle_raise(spark):
    chain = spark.createDataFrame([(f"{i:03}", f"{i + 1:03}") for i in range(60)], "a string, b string")
    with pytest.raises(RuntimeError):
        paths.components(chain, max_rounds=2)
    assert {x["component"] for x in paths.components(chain).collect()} == {"000"}


def test_the_last_solid_value_wins(spark):
    schema = "BACNT_NO string, BANK_CD string, DPSTR_NM string"
    first = spark.createDataFrame([("1", "004", "zoe"), ("2", "088", "bo")], schema)
    second = spark.createDataFrame([("1", " ", "adam"), ("3", None, None)], schema)
    got = csv.merge_loads([{"TB_FIN_BACNT": first}, {"TB_FIN_BACNT": second}])["TB_FIN_BACNT"]
    assert sorted(map(tuple, got.select("BACNT_NO", "BANK_CD", "DPSTR_NM").collect())) == [("1", "004", "adam"), ("2", "088", "bo"), ("3", None, None)]


def test_stored_graphs(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/graphs")
    v = spark.createDataFrame([("a", "x"), ("b", "x")], "v_id string, label string")
    e = spark.createDataFrame([("a", "b", "l")], "src string, dst string, label string")
    for name in ("unit_one", "unit_two"):
        store.create(name)
        store.create(name)
        store.load(name, {"vertices": v, "edges": e})
    store.load("unit_one", {"vertices": v.select("label", "v_id"), "edges": e})
    assert store.graphs("unit_*") == ["unit_one", "unit_two"]
    assert {tuple(r) for r in store.sizes(["unit_one", "unit_two"]).collect()} == {("unit_one", 4, 2), ("unit_two", 2, 1)}
    store.load("unit_one", {"vertices": v}, clear=True)
    assert {tuple(r) for r in store.sizes(["unit_one"]).collect()} == {("unit_one", 2, 0)}
    store.drop("unit_two")
    assert store.graphs("unit_*") == ["unit_one"]
    for bad in ("default", "a b", "x; drop"):
        with pytest.raises(ValueError):
            store.drop(bad)
    store.drop("unit_one")


def test_records(spark):
    kt = spark.createDataFrame([("010-1", "+82 2", "2024-05-06 07:08:09"), ("3", None, "soon")], "FROM_NUM string, TO_NUM string, TIME string")
    got = records.call_records(kt).collect()
    assert [(r["carrier"], r["caller"], r["callee"], str(r["ts"])) for r in got] == [("KT", "0101", "+822", "2024-05-06 07:08:09"), ("KT", "3", None, "None")]
    with pytest.raises(ValueError):
        records.call_records(kt.drop("TO_NUM"))
    places = spark.createDataFrame([(1, " 37.5", "127"), (2, "x", "1"), (3, None, "1"), (4, "1", "")], "id long, lat string, lng string")
    assert [tuple(r) for r in records.with_coordinates(places, "lat", "lng").collect()] == [(1, 37.5, 127.0)]


def test_metadata_rules_go_in_order(spark):
    props = [{"flnm": "1", "event_id": "2"}, {"event_type": "call"}, {"event_id": "x", "actno": "1"}, {"ip": "1", "name": "n"}, {"nickname": "n"}, {"colour": "red"}, {}]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(props)], "i long, props map<string,string>")
    got = {r["i"]: tuple(r["m"]) for r in df.select("i", metadata.node_metadata(F.col("props")).alias("m")).collect()}
    assert got[0] == ("Case", "Case", "사건", "수사사건") and got[1][2:] == ("통화이벤트", "통신사실확인자료") and got[2][2:] == ("이벤트", "수사단서")
    assert got[3][1] == "NetworkTrace" and got[4][1] == "DigitalIdentity" and got[5] == got[6] == ("Unknown", "Unknown", "알 수 없음", None)
    whole = df.filter("i = 1").select(metadata.enriched_node(F.col("props")).alias("p")).first()["p"]
    assert whole == {"event_type": "call", "ontology_type": "Event", "entity_subtype": "Event", "domain_concept": "통화이벤트", "legal_category": "통신사실확인자료", "kics_compliant": "true"}
    edges = spark.createDataFrame([("used_phone",), ("likes",)], "kind string").select(metadata.edge_metadata(F.col("kind")).alias("m")).collect()
    assert [tuple(r["m"]) for r in edges] == [("usedCommunicationDevice", "전화번호 사용", "통신사실확인자료"), ("likes", "likes", None)]


def test_placeholders_and_distinct_elements(spark):
    df = spark.createDataFrame([("불상",), ("미상",), (None,), ("kim",)], "name string")
    assert [r["name"] for r in g.without_placeholders(df, F.col("name")).collect()] == ["kim"]
    assert g.distinct_elements([df, df], ["name"]).count() == 4


def test_columns_of_a_landed_file(spark):
    columns = spark.createDataFrame([("f", 0, "접수번호"), ("f", 1, "출금계좌번호"), ("f", 2, "입금계좌번호"), ("f", 3, "메모"), ("g", 0, "caller"), ("g", 1, "callee")], "file string, ordinal int, column string")
    types = mapping.column_types(columns)
    got = {(r["file"], r["column"]): (r["type"], r["method"]) for r in types.collect()}
    assert got["f", "접수번호"] == ("case", "exact") and got["f", "출금계좌번호"] == ("sender", "exact") and got["f", "메모"][1] == "unmapped"
    assert {(r["file"], r["source"], r["target"], r["relation"]) for r in mapping.relations(types).collect()} == {("f", "출금계좌번호", "입금계좌번호", "transferred_to"), ("g", "caller", "callee", "contacted")}
    assert {(r["file"], r["action"]) for r in mapping.actions(columns).collect()} == {("f", "Transfer"), ("g", "Call")}
