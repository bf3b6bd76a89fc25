"""Inference rules over any graph: each takes vertices(v_id, label) and edges(src, dst, label, ts) and a threshold, and returns findings.

A finding is (rule, v_id, other, n, confidence): the vertex that the rule is about, the second vertex if it is about a pair, and the
count that reached the threshold. Labels are those of the table dialect; edges without a time have null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseloom.operators import grid
from caseloom.operators.paths import staged

#: rule -> function (vertices, edges, threshold) -> (v_id, other, n)
RULES: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {}


def rule(name: str):
    def add(f):
        RULES[name] = f
        return f

    return add


def _found(df: DataFrame, key: str, n: str = "n", other: str | None = None) -> DataFrame:
    return df.select(F.col(key).alias("v_id"), (F.col(other) if other else F.lit(None).cast("string")).alias("other"), F.col(n).cast("long").alias("n"))


@rule("OrganizedCrime")
def organized_crime(vertices: DataFrame, edges: DataFrame, threshold: int) -> DataFrame:
    """Phones of ``threshold`` cases or more."""
    e = edges.filter("label = 'eg_used_phone'").select("src", "dst").distinct()
    return _found(e.groupBy("dst").agg(F.count("*").alias("n")).filter(F.col("n") >= threshold), "dst")


@rule("MoneyLaundering")
def money_laundering(vertices: DataFrame, edges: DataFrame, threshold: int) -> DataFrame:
    """Accounts with ``threshold`` pairs of a transfer in and one out, or more; pairs are counted, not made."""
    t = edges.filter("label = 'transferred_to'")
    ends = t.select(F.col("dst").alias("v"), F.lit(1).alias("i"), F.lit(0).alias("o")).unionAll(t.select(F.col("src").alias("v"), F.lit(0).alias("i"), F.lit(1).alias("o")))
    return _found(ends.groupBy("v").agg((F.sum("i") * F.sum("o")).alias("n")).filter(F.col("n") >= threshold), "v")


@rule("Accomplice")
def accomplice(vertices: DataFrame, edges: DataFrame, threshold: int) -> DataFrame:
    """Pairs that call ``threshold`` or more of the same phones; callers are numbered in their order, and counted in a grid."""
    n = staged(edges.filter("label = 'contacted'").select("src", "dst").distinct())
    n = n.join(n.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") >= threshold).select("src"), "src", "left_semi")
    order = grid.numbered(n, "src")
    name = lambda c: order.select(F.col("place").alias(c), F.col("src").alias(f"{c}_id"))
    pairs = grid.often(n.join(order, "src"), "dst", "place", threshold).withColumnRenamed("shared", "n")
    return _found(pairs.join(name("a"), "a").join(name("b"), "b"), "a_id", other="b_id")


@rule("RapidTransfer")
def rapid_transfer(vertices: DataFrame, edges: DataFrame, threshold: int) -> DataFrame:
    """Accounts with ``threshold`` transfers out or more within an hour; n is the most of any hour."""
    hour = Window.partitionBy("src").orderBy(F.unix_timestamp("ts")).rangeBetween(-3600, 0)
    t = edges.filter("label = 'transferred_to'").select("src", F.count("*").over(hour).alias("k"))
    return _found(t.groupBy("src").agg(F.max("k").alias("n")).filter(F.col("n") >= threshold), "src")


@rule("NightActivity")
def night_activity(vertices: DataFrame, edges: DataFrame, threshold: int) -> DataFrame:
    """Vertices with ``threshold`` edges out or more between 0 and 6 o'clock."""
    return _found(edges.filter(F.hour("ts") < 6).groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") >= threshold), "src")


@rule("CrossDomainLink")
def cross_domain(vertices: DataFrame, edges: DataFrame, threshold: int) -> DataFrame:
    """Addresses from which ``threshold`` accounts and phones or more are reached over the persons that use them, or over what those are members of."""
    used = edges.filter("label = 'used_ip'").select(F.col("src").alias("person"), F.col("dst").alias("ip")).distinct()
    own = edges.filter("label in ('has_account', 'owns_phone')").select(F.col("src").alias("person"), F.col("dst").alias("thing"))
    group = edges.filter("label = 'member_of'").select(F.col("src").alias("person"), F.col("dst").alias("group"))
    held = edges.filter("label = 'holds'").select(F.col("src").alias("group"), F.col("dst").alias("thing"))
    over = used.join(group, "person").select("ip", "group").distinct().join(held, "group").select("ip", "thing")
    reached = used.join(own, "person").select("ip", "thing").unionAll(over).distinct()
    return _found(reached.groupBy("ip").agg(F.count("*").alias("n")).filter(F.col("n") >= threshold), "ip")


def infer(vertices: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """All findings of the rules in rules(rule, threshold, confidence), a small table; only vertices that the graph has are reported."""
    out, ids = None, vertices.select("v_id")
    for r in rules.collect():
        found = RULES[r["rule"]](vertices, edges, r["threshold"]).select(F.lit(r["rule"]).alias("rule"), "v_id", "other", "n", F.lit(r["confidence"]).alias("confidence"))
        out = found if out is None else out.unionAll(found)
    return out.join(ids, "v_id", "left_semi").select("rule", "v_id", "other", "n", "confidence")
