"""Directed closure of a transitive relation: strongly connected components, then reachability between them.

Inside a component everything reaches everything, so a component is one vertex of the closure and its members are a table
beside it: nothing grows with the square of a component. Loops are frontier joins; every round is a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators import sides
from caseloom.operators.paths import staged


def _trimmed(e: DataFrame, rounds: int) -> DataFrame:
    """Edges whose start has an edge in and whose end has an edge out, again and again: others are in no cycle."""
    left = e.count()
    for _ in range(rounds):
        e = staged(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").select("src", "dst"))
        before, left = left, e.count()
        if left == before:
            return e
    raise RuntimeError(f"edges were still being removed after {rounds} rounds")


def _highest_before(e: DataFrame, rounds: int) -> DataFrame:
    """(v, color): the largest vertex that reaches v, itself included. Only vertices whose color has just changed pass it on."""
    color = staged(e.select(F.explode(F.array("src", "dst")).alias("v")).distinct().select("v", F.col("v").alias("color")))
    changed = color
    for _ in range(rounds):
        passed = changed.select(F.col("v").alias("src"), "color").join(e, "src").groupBy(F.col("dst").alias("v")).agg(F.max("color").alias("new"))
        merged = staged(color.join(passed, "v", "left").select("v", F.greatest("color", F.coalesce("new", "color")).alias("color"), F.coalesce(F.col("new") > F.col("color"), F.lit(False)).alias("fresh")))
        color, changed = merged.select("v", "color"), merged.filter("fresh").select("v", "color")
        if changed.isEmpty():
            return color
    raise RuntimeError(f"colors did not settle in {rounds} rounds")


def _reached(e: DataFrame, front: DataFrame, rounds: int, back: bool = False) -> DataFrame:
    """(v, color): what front(v, color) reaches over edges(src, dst), or with ``back`` what reaches it; each color on its own edges only."""
    near, far = ("dst", "src") if back else ("src", "dst")
    found = front = staged(front)
    for _ in range(rounds):
        new = front.withColumnRenamed("v", near).join(e, near).select(F.col(far).alias("v"), "color").distinct()
        front = staged(new.join(found.select("v"), "v", "left_anti"))
        if front.isEmpty():
            return staged(found)
        found = found.unionAll(front)
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def _around_pivot(e: DataFrame, rounds: int) -> DataFrame:
    """(v, color): the component of the vertex with most edges in and out, which is the large one if there is a large one."""
    ends = e.select(F.col("src").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(e.select(F.col("dst").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    pivot = ends.groupBy("v").agg((F.sum("o") * F.sum("i")).alias("n")).orderBy(F.desc("n"), "v").limit(1).select("v", F.col("v").alias("color"))
    ahead = _reached(e, pivot, rounds)
    return staged(_reached(e, pivot, rounds, back=True).join(ahead.select("v"), "v", "left_semi"))


def _colored(e: DataFrame, rounds: int) -> DataFrame:
    """(v, color): of every color the component of the vertex that it is named after."""
    color = _highest_before(e, rounds)
    a, b = (color.select(F.col("v").alias(c), F.col("color").alias(f"{c}_color")) for c in ("src", "dst"))
    inside = staged(e.join(a, "src").join(b, "dst").filter("src_color = dst_color").select("src", "dst"))
    return _reached(inside, color.filter("v = color"), rounds, back=True)


def strong_components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(v_id, component): of every vertex of edges(src, dst) the smallest vertex that it reaches and is reached from.

    Vertices outside of every cycle are trimmed off. The component of the best linked vertex comes next, by what it reaches and what reaches it.
    After that each vertex takes the largest vertex before it as its color; the vertices of a color that reach that vertex are a
    component, and the edges that are left between others go round again.
    """
    e = all_edges = staged(edges.select("src", "dst").filter("src <> dst").distinct())
    found = None
    for n in range(rounds):
        e = _trimmed(e, rounds)
        if e.isEmpty():
            break
        part = _colored(e, rounds) if n else _around_pivot(e, rounds)
        found = part if found is None else found.unionAll(part)
        gone = part.select(F.col("v").alias("src"))
        e = staged(e.join(gone, "src", "left_anti").join(gone.select(F.col("src").alias("dst")), "dst", "left_anti").select("src", "dst"))
    vertices = all_edges.select(F.explode(F.array("src", "dst")).alias("v_id")).distinct()
    if found is None:
        return vertices.select("v_id", F.col("v_id").alias("component"))
    named = found.join(found.groupBy("color").agg(F.min("v").alias("component")), "color").select(F.col("v").alias("v_id"), "component")
    return vertices.join(named, "v_id", "left").select("v_id", F.coalesce("component", "v_id").alias("component"))


def _hub(step: DataFrame) -> DataFrame:
    """(v): the vertex of step(at, to) with most steps in and out, the large component if there is one; none if no vertex has both."""
    ends = step.select(F.col("at").alias("v"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(step.select(F.col("to").alias("v"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return staged(ends.groupBy("v").agg((F.sum("o") * F.sum("i")).alias("n")).filter("n > 0").orderBy(F.desc("n"), "v").limit(1).select("v"))


def _distances(step: DataFrame, start: DataFrame, near: str, far: str, rounds: int, all_: bool) -> DataFrame:
    """(v, hops): what start(v) leads to from ``near`` to ``far``, with the least count of steps; start itself is left out."""
    front = start.select("v", F.lit(0).alias("hops"))
    found = front
    for n in range(1, rounds + 1):
        new = front.select(F.col("v").alias(near)).join(step, near).select(F.col(far).alias("v")).distinct()
        front = staged(new.join(found.select("v"), "v", "left_anti").select("v", F.lit(n).alias("hops")))
        if front.isEmpty():
            break
        found = found.unionAll(front)
    else:
        if all_:
            raise RuntimeError(f"distances did not settle in {rounds} rounds")
    return staged(found.filter("hops > 0"))


def _pairs(step: DataFrame, rounds: int, all_: bool) -> DataFrame:
    """(src, dst, hops) over step(at, to), semi-naive: a round extends only what the round before found, and drops pairs that are known."""
    front = staged(step.select(F.col("at").alias("src"), F.col("to").alias("dst"), F.lit(1).alias("hops")))
    found = front
    for n in range(2, rounds + 1):
        new = front.withColumnRenamed("dst", "at").join(step, "at").select("src", F.col("to").alias("dst")).distinct()
        front = staged(new.join(found.select("src", "dst"), ["src", "dst"], "left_anti").select("src", "dst", F.lit(n).alias("hops")))
        if front.isEmpty():
            break
        found = found.unionAll(front)
    else:
        if all_:
            raise RuntimeError(f"the closure did not settle in {rounds} rounds")
    return found


def closure(edges: DataFrame, most_hops: int | None = None, rounds: int = 200, parts: int = 64) -> tuple[DataFrame, DataFrame]:
    """(members, reach) of the transitive relation edges(src, dst).

    members(v_id, component); reach(src, dst, hops): components of which the first reaches the second, with the least count of steps
    from one component to the next; a component of several vertices reaches itself with 0.

    Nearly all pairs of a large relation lead over its large component, the hub: all that reaches it with all that it reaches. The distances to and
    from the hub are found by themselves, pairs around it are walked round by round, and the others are a product dealt to ``parts`` tasks, which is
    never shuffled: what a start reaches around the hub lies beside it, and is left out of the product and merged with its distance over the hub.
    """
    most, all_ = most_hops or rounds, not most_hops
    edges = staged(edges.select("src", "dst").filter("src <> dst").distinct())
    members = staged(strong_components(edges, rounds))
    a, b = (members.select(F.col("v_id").alias(c), F.col("component").alias(f"{c}_c")) for c in ("src", "dst"))
    step = staged(edges.join(a, "src").join(b, "dst").filter("src_c <> dst_c").select(F.col("src_c").alias("at"), F.col("dst_c").alias("to")).distinct())
    cycles = members.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("component").alias("src"), F.col("component").alias("dst"), F.lit(0).alias("hops"))
    hub = _hub(step)
    to_hub = _distances(step, hub, "to", "at", most, all_).select(F.col("v").alias("src"), F.col("hops").alias("h1"))
    from_hub = _distances(step, hub, "at", "to", most, all_).select(F.col("v").alias("dst"), F.col("hops").alias("h2"))
    direct = to_hub.crossJoin(hub).select("src", F.col("v").alias("dst"), F.col("h1").alias("hops"))
    direct = direct.unionAll(hub.crossJoin(from_hub).select(F.col("v").alias("src"), "dst", F.col("h2").alias("hops")))

    rest = staged(step.join(hub.select(F.col("v").alias("at")), "at", "left_anti").join(hub.select(F.col("v").alias("to")), "to", "left_anti").select("at", "to"))
    around = staged(_pairs(rest, most, all_).join(to_hub, "src", "left").join(from_hub, "dst", "left"))
    known = around.filter("h1 is not null and h2 is not null").groupBy("src").agg(F.collect_list("dst").alias("known"))
    left = staged(to_hub.join(known, "src", "left").select("src", "h1", "known", F.lit(0).alias("k")))
    product = sides.expanded(left, from_hub.withColumn("k", F.lit(0)), ["k"], parts)
    over = product.filter("known is null or not array_contains(known, dst)").select("src", "dst", (F.col("h1") + F.col("h2")).alias("hops"))
    if most_hops:
        over = over.filter(F.col("hops") <= most_hops)
    around = around.select("src", "dst", F.least("hops", F.col("h1") + F.col("h2")).alias("hops"))  # least() skips nulls
    return members, cycles.unionAll(direct).unionAll(around).unionAll(over)
