"""Relations that are complete between two sides, stored as these: no pair is written, and every pair is read."""

from itertools import product

import pytest
from pyspark.sql import functions as F

from caseloom.sources import csv
from caseloom.sources.store import Store


@pytest.fixture(scope="module")
def graph(spark):
    left = [(f"p{k}", "l", k % 3 if k else None) for k in range(40)]
    right = [(f"a{k}", "l", k % 4 if k else None) for k in range(30)] + [("a5", "l", 1)]
    pairs = sorted((a, b, "l") for (a, _, x), (b, _, y) in product(left, right) if x is not None and x == y)
    return spark.createDataFrame(left, "src string, label string, g int"), spark.createDataFrame(right, "dst string, label string, g int"), pairs


def test_store(spark, tmp_path, graph):
    """Two loads are twice the edges, not four times; rows written grow with the sides."""
    left, right, pairs = graph
    store, v = Store(spark, f"file://{tmp_path}/graphs"), spark.createDataFrame([("p1", "x")], "v_id string, label string")
    store.create("sides_one")
    for n in (1, 2):
        store.load("sides_one", {"vertices": v}, complete={"edges": (left, right)})
        assert [tuple(r) for r in store.sizes(store.graphs("sides_*")).collect()] == [("sides_one", n, n * len(pairs))]
        assert sorted(tuple(r) for r in store.edges("sides_one").collect()) == sorted(n * pairs)
    store.load("sides_one", {"vertices": v, "edges": spark.createDataFrame([("a", "b", "m")], "src string, dst string, label string")}, clear=True, complete={"edges": (left, right)})
    assert [tuple(r) for r in store.sizes(["sides_one"]).collect()] == [("sides_one", 1, len(pairs) + 1)]
    assert sorted(tuple(r) for r in store.edges("sides_one").collect()) == sorted([*pairs, ("a", "b", "m")])
    assert sum(spark.table(f"sides_one.{t}").count() for t in store.tables("sides_one")) == 1 + 1 + left.count() + right.count() < len(pairs)
    store.clear("sides_one")
    assert [tuple(r) for r in store.sizes(["sides_one"]).collect()] == [("sides_one", 0, 0)]
    store.drop("sides_one")


def test_written_graph(spark, tmp_path, graph):
    left, right, pairs = graph
    v = spark.createDataFrame([("p1", "x")], "v_id string, label string")
    other = [("c1", "p1", "m"), ("a", "z", "l")]
    e = spark.createDataFrame(other, "src string, dst string, label string")
    csv.write_graph(v, e, f"{tmp_path}/both", (left, right))
    csv.write_graph(v, e, f"{tmp_path}/plain")
    csv.write_graph(v, e, f"{tmp_path}/none", (left, right.withColumn("g", F.lit(9))))
    assert sorted(tuple(r) for r in csv.read_graph(spark, f"{tmp_path}/both")[1].select("src", "dst", "label").collect()) == sorted(pairs + other)
    assert sorted(tuple(r) for r in csv.read_graph(spark, f"{tmp_path}/plain")[1].select("src", "dst", "label").collect()) == sorted(other)
    rows = [x for x in pairs + other if x[2] == "l"]
    assert [tuple(r) for r in csv.edge_summary(spark, f"{tmp_path}/both", "l").collect()] == [("l", len(rows), min(x[0] for x in rows), max(x[1] for x in rows))]
    assert [tuple(r) for r in csv.edge_summary(spark, f"{tmp_path}/none", "l").collect()] == [("l", 1, "a", "z")]
    assert csv.edge_summary(spark, f"{tmp_path}/both", "k").count() == 0
