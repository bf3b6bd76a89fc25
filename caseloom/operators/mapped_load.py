"""Rows of a mapped file to vertices and edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.operators.build import v_id


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def pairs_load(df: DataFrame, order: list[str], source: tuple[str, str], target: tuple[str, str], edge: str, source_props: list[str] = (), target_props: list[str] = (), edge_props: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """A source and a target vertex and one edge per row in which both are there.

    ``source`` and ``target`` are (label, column). A vertex's properties take the last row's value that is not
    empty, in ``order``; its first row is kept as first_seen. Edges keep one row each (parallel ones stay).
    """
    at = F.struct(*order)
    rows = df.withColumn("_s", _text(F.col(source[1]))).withColumn("_t", _text(F.col(target[1]))).filter("_s is not null and _t is not null").withColumn("_at", at)

    def side(label, key, props):
        last = [F.max_by(_text(F.col(p)), F.when(_text(F.col(p)).isNotNull(), F.col("_at"))).alias(p) for p in props]
        v = rows.groupBy(F.col(key).alias("key")).agg(F.min("_at").cast("string").alias("first_seen"), *last)
        named = F.map_filter(F.create_map(*[x for p in ("first_seen", *props) for x in (F.lit(p), F.col(p))]), lambda _, x: x.isNotNull())
        return v.select(v_id(label, F.col("key")).alias("v_id"), F.lit(label).alias("label"), "key", named.alias("props"))

    vertices = side(source[0], "_s", source_props).unionByName(side(target[0], "_t", target_props))
    props = F.create_map(*[x for p in edge_props for x in (F.lit(p), F.col(p).cast("string"))]) if edge_props else F.create_map().cast("map<string,string>")
    edges = rows.select(v_id(source[0], F.col("_s")).alias("src"), v_id(target[0], F.col("_t")).alias("dst"), F.lit(edge).alias("label"), props.alias("props"))
    return vertices, edges


def action_vertices(df: DataFrame, kind: str, row_id: str, props: list[str]) -> DataFrame:
    """An action vertex per row, id <kind>_<row>."""
    m = F.create_map(*[x for p in props for x in (F.lit(p), F.col(p).cast("string"))])
    return df.select(F.concat_ws("_", F.lit(kind), F.col(row_id).cast("string")).alias("v_id"), F.lit("vt_" + kind.lower()).alias("label"), m.alias("props"))


def entity_vertices(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Distinct (label, key) of the entity columns, column -> label; one pass that unpivots the row."""
    cells = F.array(*[F.struct(F.lit(label).alias("label"), _text(F.col(c)).alias("key")) for c, label in columns.items()])
    return df.select(F.explode(cells).alias("x")).select("x.label", "x.key").filter("key is not null").distinct().select(F.concat_ws(":", "label", "key").alias("v_id"), "label", "key")


def row_edges(df: DataFrame, kind: str, row_id: str, relations: list[tuple[str, str, str, bool]]) -> DataFrame:
    """Edges between a row's entities and its action: (column, label, edge, towards the action)."""
    action = F.concat_ws("_", F.lit(kind), F.col(row_id).cast("string"))
    cells = []
    for column, label, edge, towards in relations:
        entity = F.when(_text(F.col(column)).isNotNull(), v_id(label, _text(F.col(column))))
        src, dst = (entity, action) if towards else (action, entity)
        cells.append(F.struct(src.alias("src"), dst.alias("dst"), F.lit(edge).alias("label")))
    return df.select(F.explode(F.array(*cells)).alias("x")).select("x.*").filter("src is not null and dst is not null")


def resolve_any_label(vertices: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, value, v_id) of (name, value): the smallest vertex of any label that has the property."""
    have = vertices.select("v_id", F.explode("props").alias("name", "value"))
    return wanted.join(have, ["name", "value"], "left").groupBy("name", "value").agg(F.min("v_id").alias("v_id"))


def add_vertex(vertices: DataFrame, label: str, key: str, props: dict[str, str]) -> DataFrame:
    """The vertices and one more; one that is there already is replaced."""
    new = vertices.sparkSession.createDataFrame([(f"{label}:{key}", label, key, {k: str(v) for k, v in props.items()})], "v_id string, label string, key string, props map<string,string>")
    return vertices.filter(F.col("v_id") != f"{label}:{key}").unionByName(new)
