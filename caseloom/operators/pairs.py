"""Pairs of members that share a key, made so that a hot key is no single task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators.paths import staged

#: Members of a key up to which its pairs are made in one place.
BLOCK = 500


def linked(df: DataFrame, keys: list[str], member: str, least: int = 1, carry: tuple[str, ...] = (), block: int = BLOCK) -> DataFrame:
    """(keys, a, b, and for each carried column c: c_a, c_b): one row per key and pair of its members, a < b.

    ``df`` has one row per key and member. Members with fewer than ``least`` keys can share no ``least`` of them and go
    first, then keys that are left with one member. A key with more than ``block`` members is split into parts by member,
    and every pair of parts is joined on its own, so that its pairs are spread over many tasks. No pair is left out.
    """
    u = df.select(*keys, member, *carry)
    if least > 1:
        u = u.join(u.groupBy(member).agg(F.count("*").alias("_n")).filter(F.col("_n") >= least).select(member), member, "left_semi")
    u = staged(u)
    u = u.join(u.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1"), keys)
    parts = F.ceil(F.col("_n") / block).cast("int")
    u = u.withColumn("_parts", parts).withColumn("_own", F.pmod(F.xxhash64(member), F.col("_parts")).cast("int"))

    def side(name, low, high):
        named = [F.col(member).alias(f"_{name}"), *[F.col(c).alias(f"_{c}_{name}") for c in carry]]
        return u.select(*keys, *named, low, high)

    left = side("x", F.col("_own").alias("_p"), F.explode(F.sequence("_own", F.col("_parts") - 1)).alias("_q"))
    right = side("y", F.explode(F.sequence(F.lit(0), "_own")).alias("_p"), F.col("_own").alias("_q"))
    both = left.join(right, [*keys, "_p", "_q"]).filter((F.col("_p") < F.col("_q")) | (F.col("_x") < F.col("_y")))
    straight = F.col("_x") < F.col("_y")
    carried = [
        c
        for k in carry
        for c in (F.when(straight, F.col(f"_{k}_x")).otherwise(F.col(f"_{k}_y")).alias(f"{k}_a"), F.when(straight, F.col(f"_{k}_y")).otherwise(F.col(f"_{k}_x")).alias(f"{k}_b"))
    ]
    return both.select(*keys, F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"), *carried)


def sharing_two(df: DataFrame, key: str, member: str, most: int = 32) -> DataFrame:
    """(a, b, shared): pairs of members, a < b, that share two or more keys of the distinct rows ``df``, with the count of shared keys.

    Members meet on pairs of keys, so that pairs with one key in common are never made: k common keys are k (k - 1) / 2 common pairs.
    Members with over ``most`` keys have too many pairs of them, and meet the others on single keys.
    """
    u = df.select(key, member).dropna()
    u = u.join(u.groupBy(key).agg(F.count("*").alias("_n")).filter("_n > 1").select(key), key, "left_semi")
    u = staged(u.join(u.groupBy(member).agg(F.count("*").alias("_keys")).filter("_keys > 1"), member))
    keys = u.filter(F.col("_keys") <= most).groupBy(member).agg(F.sort_array(F.collect_list(key)).alias("_k"))
    first = keys.select(member, "_k", F.posexplode("_k").alias("_i", "_k1"))
    pairs = first.select(member, "_k1", F.explode(F.slice("_k", F.col("_i") + 2, F.size("_k"))).alias("_k2"))
    light = linked(pairs, ["_k1", "_k2"], member).groupBy("a", "b").agg(F.count("*").alias("_c"))
    light = light.select("a", "b", F.round((1 + F.sqrt(1 + 8 * F.col("_c"))) / 2).cast("long").alias("shared"))
    x = u.filter(F.col("_keys") > most).select(key, F.col(member).alias("_x"))
    y = u.select(key, F.col(member).alias("_y"), (F.col("_keys") > most).alias("_both"))
    met = x.join(y, key).filter("_x <> _y and (not _both or _x < _y)").groupBy(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))
    return light.unionAll(met.agg(F.count("*").alias("shared")).filter("shared >= 2"))
