"""Probabilistic identity: confidence along chains of ``resolves_to``, merging of what is certain, and edges re-pointed to what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.operators import sides
from caseloom.operators.paths import components, staged


def chain_confidence(links: DataFrame, least: float, steps: int) -> DataFrame:
    """(src, dst, confidence, steps): the best product along a chain of up to ``steps`` links(src, dst, confidence).

    Confidences are at most 1, so a chain that falls below ``least`` never gets over it again and is dropped; a round extends only pairs
    that it has made better. Of equal products the shorter chain is kept.
    """
    step = staged(links.filter(F.col("confidence") >= least).groupBy(F.col("src").alias("at"), F.col("dst").alias("to")).agg(F.max("confidence").alias("c")).filter("at <> to"))
    best = front = staged(step.select(F.col("at").alias("src"), F.col("to").alias("dst"), F.col("c").alias("confidence"), F.lit(1).alias("steps")))
    for n in range(2, steps + 1):
        new = front.select("src", F.col("dst").alias("at"), "confidence").join(step, "at").filter("src <> to").select("src", F.col("to").alias("dst"), (F.col("confidence") * F.col("c")).alias("new")).filter(F.col("new") >= least)
        new = new.groupBy("src", "dst").agg(F.max("new").alias("new"))
        merged = staged(best.join(new, ["src", "dst"], "full").withColumn("better", F.coalesce(F.col("new") > F.coalesce("confidence", F.lit(0.0)), F.lit(False))))
        kept = [F.when(F.col("better"), F.col("new")).otherwise(F.col("confidence")).alias("confidence"), F.when(F.col("better"), n).otherwise(F.col("steps")).alias("steps")]
        best, front = merged.select("src", "dst", *kept), merged.filter("better").select("src", "dst", F.col("new").alias("confidence"))
        if front.isEmpty():
            break
    return best


def merged_ids(links: DataFrame) -> DataFrame:
    """(v_id, into): vertices that links of confidence 1 make one, each with the smallest of them; the smallest itself is left out."""
    certain = links.filter("confidence >= 1").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return components(certain).select("v_id", F.col("component").alias("into")).filter("v_id <> into")


def _put(edges: DataFrame, end: str, merged: DataFrame) -> DataFrame:
    to = merged.select(F.col("v_id").alias(end), F.col("into").alias("_into"))
    return edges.join(to, end, "left").withColumn(end, F.coalesce("_into", end)).drop("_into")


def repointed(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """(src, dst, label, n): edges with merged ends put to what they were merged into; equal ones are folded, and those within one vertex go."""
    m = sides.small(staged(merged))
    return _put(_put(edges, "src", m), "dst", m).filter("src <> dst").groupBy("src", "dst", "label").agg(F.count("*").alias("n"))


def repointed_sides(left: DataFrame, right: DataFrame, keys: list[str], label: str, merged: DataFrame) -> DataFrame:
    """``repointed`` for all pairs of left(src, keys) and right(dst, keys): both sides are merged and counted, and no pair is shuffled.

    Only the ends of the right side that are in several groups can make equal pairs, so that only their pairs are folded.
    """
    m = sides.small(staged(merged))
    count = lambda df, end, n: _put(df.dropna(subset=[end, *keys]), end, m).groupBy(end, *keys).agg(F.count("*").alias(n))
    a = staged(count(left, "src", "_a"))
    b = staged(count(right, "dst", "_b").groupBy("dst").agg(F.collect_list(F.struct(*keys, "_b")).alias("_at")))
    pairs = lambda of: sides.expanded(a, of.select("dst", F.explode("_at").alias("_g")).select("dst", "_g.*"), keys).filter("src <> dst").select("src", "dst", F.lit(label).alias("label"), (F.col("_a") * F.col("_b")).alias("n"))
    return pairs(b.filter(F.size("_at") == 1)).unionAll(pairs(b.filter(F.size("_at") > 1)).groupBy("src", "dst", "label").agg(F.sum("n").alias("n")))
