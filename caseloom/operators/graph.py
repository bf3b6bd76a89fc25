"""Searches, neighbourhoods, merges and censuses over vertices(v_id, label, props) and edges(src, dst, label)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def undirected(edges: DataFrame) -> DataFrame:
    """Every edge in both directions, with its direction."""
    return edges.select("src", "dst", "label", F.lit("out").alias("direction")).unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "label", F.lit("in").alias("direction")))


def capped(df: DataFrame, per: list[str], order: list[str], most: int | None) -> DataFrame:
    """At most ``most`` rows of each group, in a stated order; all if ``most`` is None."""
    if most is None:
        return df
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def search(vertices: DataFrame, keyword: str, most: int | None = 50) -> DataFrame:
    """Vertices of which any property contains the keyword, at most ``most`` per label."""
    hit = F.exists(F.map_values("props"), lambda x: F.contains(x, F.lit(keyword)))
    return capped(vertices.filter(hit), ["label"], ["v_id"], most)


def search_props(vertices: DataFrame, keyword: str, names: list[str]) -> DataFrame:
    """Vertices of which one of the named properties contains the keyword."""
    return vertices.filter(F.exists(F.array(*[F.col("props")[n] for n in names]), lambda x: F.coalesce(F.contains(x, F.lit(keyword)), F.lit(False))))


def incident(edges: DataFrame, seeds: DataFrame, most: int | None = 100) -> DataFrame:
    """Edges with an end among the seeds (v_id); two semi-joins rather than one join on OR."""
    ids = seeds.select(F.col("v_id").alias("_id"))
    both = edges.join(ids, edges["src"] == ids["_id"], "left_semi").unionAll(edges.join(ids, edges["dst"] == ids["_id"], "left_semi")).distinct()
    return capped(both, ["label"], ["src", "dst"], most)


def with_endpoints(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges with the labels of both ends, null where a vertex is missing."""
    s = vertices.select(F.col("v_id").alias("src"), F.col("label").alias("src_label"))
    d = vertices.select(F.col("v_id").alias("dst"), F.col("label").alias("dst_label"))
    return edges.join(s, "src", "left").join(d, "dst", "left").select("src", "dst", "label", "src_label", "dst_label")


def neighbours(edges: DataFrame, seeds: DataFrame, most: int | None = 50) -> DataFrame:
    """(src, dst, label, direction) of the seeds' edges, undirected, at most ``most`` per seed and label."""
    ids = seeds.select(F.col("v_id").alias("_id"))
    e = undirected(edges)
    return capped(e.join(ids, e["src"] == ids["_id"], "left_semi").distinct(), ["src", "label"], ["dst", "direction"], most)


def delete_vertices(vertices: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the vertices in ``ids`` (v_id) and without their edges."""
    gone = ids.select(F.col("v_id").alias("_id"))
    v = vertices.join(gone, vertices["v_id"] == gone["_id"], "left_anti")
    e = edges.join(gone, edges["src"] == gone["_id"], "left_anti")
    return v, e.join(gone, e["dst"] == gone["_id"], "left_anti")


def degrees(edges: DataFrame) -> DataFrame:
    """A4: (v_id, label, ins, outs, total), one pass of partial counts over both ends."""
    ends = edges.select(F.col("src").alias("v_id"), "label", F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(edges.select(F.col("dst").alias("v_id"), "label", F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("v_id", "label").agg(F.sum("i").alias("ins"), F.sum("o").alias("outs"), F.count("*").alias("total"))


def census(edges: DataFrame) -> DataFrame:
    """Counts by label and the labels of both ends (the part of the id before the colon)."""
    return edges.groupBy("label", F.substring_index("src", ":", 1).alias("src_label"), F.substring_index("dst", ":", 1).alias("dst_label")).agg(F.count("*").alias("n"))


def schema_of(vertices: DataFrame) -> DataFrame:
    """Label -> sorted property names, over all vertices."""
    return vertices.select("label", F.explode(F.map_keys("props")).alias("k")).groupBy("label").agg(F.array_join(F.sort_array(F.collect_set("k")), ",").alias("keys"))


def attributes(vertices: DataFrame) -> DataFrame:
    """The attribute table of an entity/link/attribute export."""
    return vertices.select("v_id", F.explode("props").alias("name", "value"))


def merge_last(rows: DataFrame, key: list[str], order: list) -> DataFrame:
    """Of rows with one key the last in ``order``."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def upsert_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, and new ones whose key is not there; of new rows with one key the smallest."""
    w = Window.partitionBy(*key).orderBy(*[c for c in new.columns if c not in key])
    first = new.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return old.unionByName(first.join(old.select(*key), key, "left_anti"))


def upsert_coalesce(old: DataFrame, new: DataFrame, key: list[str], order: str) -> DataFrame:
    """Per key each column's last value that is neither null nor empty, the old one where the batch has none."""
    rest = [c for c in old.columns if c not in key]
    solid = lambda c: F.when(F.trim(F.col(c).cast("string")) != "", F.col(c))
    batch = new.groupBy(*key).agg(*[F.max_by(solid(c), F.when(solid(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in rest])
    return old.join(batch, key, "full").select(*key, *[F.coalesce(f"_{c}", c).alias(c) for c in rest])


#: Names that stand for an unknown person.
PLACEHOLDERS = ("불상", "미상")


def without_placeholders(df: DataFrame, name: Column) -> DataFrame:
    """P5: rows with a real name; placeholders and missing names go."""
    return df.filter(~name.isin(*PLACEHOLDERS))


def case_subgraphs(edges: DataFrame, most: int | None = 50) -> DataFrame:
    """(src, dst, label, direction) around every case, src being the case; at most ``most`` edges of each."""
    e = undirected(edges)
    return capped(e.filter(F.col("src").startswith("vt_case:")), ["src"], ["label", "dst", "direction"], most)


def distinct_elements(results: list[DataFrame], ids: list[str]) -> DataFrame:
    """The union of some results with each element, known by ``ids``, once."""
    out = results[0]
    for x in results[1:]:
        out = out.unionByName(x)
    return out.dropDuplicates(ids)
