"""A relation that is complete between the two sides of each group, kept as its sides: what can be counted or walked by group is never expanded to its pairs.

``left`` and ``right`` have the group's key columns; members of both sides with equal, non-null keys are linked, once for each pair of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.paths import staged


#: Members of a block.
BLOCK = 256


def _dealt(columns: list[str], parts: int):
    return F.pmod(F.xxhash64(*columns), F.lit(parts)).cast("int")


def _largest(df: DataFrame, keys: list[str]) -> tuple[int, int]:
    """(rows of the largest group, rows of all groups), neither under 1."""
    most, rows = df.groupBy(*keys).count().agg(F.max("count"), F.sum("count")).first()
    return max(1, most or 0), max(1, rows or 0)


def blocks(df: DataFrame, keys: list[str], name: str, most: int | None = None) -> DataFrame:
    """(keys, name): the rows of each group in arrays of about ``BLOCK`` at most, values if there is one column besides the keys and else structs."""
    rest, df = [c for c in df.columns if c not in keys], df.dropna(subset=keys)
    most = most or _largest(df, keys)[0]
    out = df.groupBy(*keys, _dealt(rest, math.ceil(most / BLOCK)).alias("_b")).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    return out.select(*keys, (F.col("_rows").getField(rest[0]) if len(rest) == 1 else F.col("_rows")).alias(name))


def expanded(left: DataFrame, right: DataFrame, keys: list[str], parts: int | None = None, unpack: tuple[str, ...] = (), sums: tuple[str, ...] = ()) -> DataFrame:
    """All pairs of a left and a right row of one group. Arrays of the left side that ``unpack`` names stand for a row of each element, and are shuffled as they are.
    Left rows that differ in the columns ``sums`` only are one, with the sums of these, which are made where the pairs are.

    The right rows are joined in blocks. A group is dealt to ``parts`` tasks, to which its blocks are copied; if none is given, to as few as keep
    all tasks busy, one if there are many groups of like size. The number of tasks is given, since by the bytes that come in the pairs look few.
    So is the join: Spark does not count the copies of the right side and may plan to broadcast them, which only adaptive execution takes back.
    """
    n = 4 * left.sparkSession.sparkContext.defaultParallelism
    rest = [c for c in right.columns if c not in keys]
    most, rows = _largest(right.dropna(subset=keys), keys)
    parts = parts or min(64, math.ceil(16 * n * most / rows))
    own = [c for c in left.columns if c not in keys and c not in sums]
    x = left.withColumn("_p", _dealt(own, parts)).repartition(n, *keys, "_p")
    x = x.groupBy(*keys, "_p", *own).agg(*[F.sum(c).alias(c) for c in sums]) if sums else x
    for c in unpack:
        x = x.select(*[k for k in x.columns if k != c], F.explode(c).alias(c))
    y = blocks(right, keys, "_block", most).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartition(n, *keys, "_p")
    mine = [c for c in x.columns if c not in keys and c != "_p"]
    both = x.join(y.hint("merge"), [*keys, "_p"]).select(*mine, F.explode("_block").alias(rest[0] if len(rest) == 1 else "_row"))
    return both if len(rest) == 1 else both.select(*mine, "_row.*")


def total(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """(n): the count of pairs, no row if there is none."""
    a, b = (x.groupBy(*keys).agg(F.count("*").alias(c)) for x, c in ((left, "_a"), (right, "_b")))
    return a.join(b, keys).agg(F.sum(F.col("_a") * F.col("_b")).alias("n")).filter("n > 0")


def shared(left: DataFrame, right: DataFrame) -> list[str]:
    """The key columns of two stored sides: those that both have."""
    return [c for c in left.columns if c in right.columns]


def labelled(left: DataFrame, right: DataFrame) -> DataFrame:
    """(src, dst, label): all pairs of stored sides left(src, label, ...) and right(dst, label, ...)."""
    return expanded(left.withColumn("_label", F.col("label")), right, shared(left, right)).select("src", "dst", F.col("_label").alias("label"))


def label_summary(left: DataFrame, right: DataFrame) -> DataFrame:
    """(label, n, least, most): of the pairs of left(src, label, ...) and right(dst, label, ...) the count, the smallest src and the largest dst; no row for a label without pairs."""
    keys = shared(left, right)
    a = left.groupBy(*keys).agg(F.count("*").alias("_a"), F.min("src").alias("_least"))
    b = right.groupBy(*keys).agg(F.count("*").alias("_b"), F.max("dst").alias("_most"))
    return a.join(b, keys).groupBy("label").agg(F.sum(F.col("_a") * F.col("_b")).alias("n"), F.min("_least").alias("least"), F.max("_most").alias("most"))


def degrees(side: DataFrame, member: str, other: DataFrame, keys: list[str]) -> DataFrame:
    """(member, n): the count of pairs of each member of ``side``."""
    n = other.groupBy(*keys).agg(F.count("*").alias("_n"))
    return side.join(n, keys).groupBy(member).agg(F.sum("_n").alias("n"))


def classes(left: DataFrame, member: str, right: DataFrame, other: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(member, cls) and (cls, other): left members that are linked with the same right ones, equally often, are one class, named after the smallest of them.

    A class's right members are repeated as often as a left one is linked with them. Members without a link are left out.
    """
    own = left.select(member, *keys).join(right.select(*keys).distinct(), keys, "left_semi")
    groups = own.groupBy(member).agg(F.sort_array(F.collect_list(F.struct(*keys))).alias("_groups"))
    name = groups.groupBy("_groups").agg(F.min(member).alias("cls"))
    members = staged(groups.join(name, "_groups").select(member, "cls"))
    of = name.select("cls", F.explode("_groups").alias("_g")).select("cls", *[F.col(f"_g.{k}").alias(k) for k in keys])
    return members, staged(of.join(right.select(other, *keys), keys).select("cls", other))


def small(table: DataFrame, most: int = 500_000) -> DataFrame:
    """``table``, which is stored, to be broadcast if it has up to ``most`` rows, so that a large one that it is joined with stays where it is."""
    return F.broadcast(table) if table.limit(most + 1).count() <= most else table


def met(table: DataFrame, other: str) -> DataFrame:
    """(cls, cls2, n, one): classes that share a right member, each also with itself, with the count of shared ones and the smallest."""
    t = table.select("cls", other).distinct()
    return t.join(t.withColumnRenamed("cls", "cls2"), other).groupBy("cls", "cls2").agg(F.count("*").alias("n"), F.min(other).alias("one"))


def third_ends(members: DataFrame, member: str, table: DataFrame, other: str) -> DataFrame:
    """(member, other): ends of walks of exactly three links that repeat none: over a shared right member to another left one, and on to another right one."""
    size = members.groupBy("cls").agg(F.count("*").alias("_size"))
    pairs = met(table, other).join(size, "cls").filter("cls <> cls2 or _size > 1").drop("_size")
    onward = table.select(F.col("cls").alias("cls2"), other).distinct()
    ends = pairs.join(onward, "cls2").filter((F.col("n") > 1) | (F.col("one") != F.col(other))).select("cls", other).distinct()
    return expanded(ends, members, ["cls"]).select(member, other)
