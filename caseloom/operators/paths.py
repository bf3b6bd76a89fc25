"""Bounded walks and paths as frontier joins; the lineage of each step is cut in the shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.graph import undirected


def shared_path(spark: SparkSession) -> str:
    """A new folder below the one named in spark.checkpoint.dir. Unset, that is an error on a cluster; on one machine a temporary one."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark, "_caseloom_stage", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark._caseloom_stage = "file://" + tempfile.mkdtemp(prefix="caseloom-")
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to a shared folder and read again."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def half_paths(step: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, at, hops, path): every vertex within ``hops`` steps of a seed, with the smallest of its shortest paths.

    ``step`` is (at, to). Vertices that an earlier step reached are left out, so a step only extends the frontier.
    """
    front = staged(seeds.select("seed", F.col("seed").alias("at"), F.lit(0).alias("hops"), F.array("seed").alias("path")))
    found, seen = front, front.select("seed", "at")
    for n in range(1, hops + 1):
        new = front.join(step, "at").select("seed", F.col("to").alias("at"), F.concat("path", F.array("to")).alias("path"))
        new = new.groupBy("seed", "at").agg(F.min("path").alias("path")).join(seen, ["seed", "at"], "left_anti")
        front = staged(new.select("seed", "at", F.lit(n).alias("hops"), "path"))
        if front.isEmpty():
            break
        found, seen = found.unionAll(front), seen.unionAll(front.select("seed", "at"))
    return found


def shortest(edges: DataFrame, pairs: DataFrame, hops: int = 6) -> DataFrame:
    """(a, b, hops, path) of each pair (a, b) that is linked in at most ``hops`` undirected steps.

    Both ends walk half of the way, each end once however many pairs it is in, and meet: a shortest path has a vertex half
    way. Of paths of one length the one with the smallest first half, and then the smallest second half, is kept.
    """
    step = staged(undirected(edges).select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    pairs = staged(pairs.select("a", "b").distinct())
    near, far = (hops + 1) // 2, hops // 2
    ends = lambda c: pairs.select(F.col(c).alias("seed")).distinct()
    left = half_paths(step, ends("a"), near).select(F.col("seed").alias("a"), "at", F.col("hops").alias("h1"), F.col("path").alias("p1"))
    right = half_paths(step, ends("b"), far).select(F.col("seed").alias("b"), "at", F.col("hops").alias("h2"), F.col("path").alias("p2"))
    met = pairs.join(left, "a").join(right, ["b", "at"])
    path = F.concat("p1", F.slice(F.reverse("p2"), 2, far + 1))
    least = F.min(F.struct((F.col("h1") + F.col("h2")).alias("hops"), path.alias("path"))).alias("x")
    return met.groupBy("a", "b").agg(least).select("a", "b", "x.hops", "x.path")


def from_seeds(edges: DataFrame, seeds: DataFrame, hops: int = 6) -> DataFrame:
    """(a, b, hops, path) from each of seeds(seed) to every vertex within ``hops`` undirected steps, of equal paths the smallest."""
    step = staged(undirected(edges).select(F.col("src").alias("at"), F.col("dst").alias("to")).distinct())
    return half_paths(step, seeds, hops).filter("hops > 0").select(F.col("seed").alias("a"), F.col("at").alias("b"), "hops", "path")


def walks(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """(seed, at, via, steps) ends of undirected walks of exactly ``depth`` edges that repeat no edge.

    ``edges`` needs an id column e_id; ``via`` is the last but one vertex.
    """
    e = edges.select("e_id", F.col("src").alias("at"), F.col("dst").alias("to")).unionAll(edges.select("e_id", F.col("dst").alias("at"), F.col("src").alias("to")))
    rows = seeds.select(F.col("v_id").alias("seed"), F.col("v_id").alias("at"), F.lit(None).cast("string").alias("via"), F.array().cast("array<string>").alias("steps"))
    for _ in range(max(1, min(5, depth))):
        rows = rows.join(e, "at").filter(~F.array_contains("steps", F.col("e_id"))).select("seed", F.col("to").alias("at"), F.col("at").alias("via"), F.concat("steps", F.array("e_id")).alias("steps"))
    return rows


def reach(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """(seed, v_id, hops) every vertex within ``hops`` undirected steps of a seed, at its least distance."""
    step = staged(undirected(edges).select(F.col("src").alias("v_id"), F.col("dst").alias("to")).distinct())
    all_ = front = staged(seeds.select(F.col("v_id").alias("seed"), "v_id", F.lit(0).alias("hops")).distinct())
    for n in range(1, hops + 1):
        front = staged(front.join(step, "v_id").select("seed", F.col("to").alias("v_id"), F.lit(n).alias("hops")).distinct().join(all_.select("seed", "v_id"), ["seed", "v_id"], "left_anti"))
        if front.isEmpty():
            break
        all_ = all_.unionAll(front)
    return all_


def components(pairs: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v_id, component) of a symmetric relation (a, b): smallest linked id, by alternating star steps."""
    e = staged(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        new = staged(large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct())
        sums = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        settled = new.agg(*sums).first() == e.agg(*sums).first()
        e = new
        if settled:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("v_id"), F.col("v").alias("component")).unionAll(e.select(F.col("v").alias("v_id"), F.col("v").alias("component")).distinct())
