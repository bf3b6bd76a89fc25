"""Named graphs and landed tables as databases of Spark's catalog.

A relation that is complete between two sides is stored as these: a table of the name given and ``_left``, one of it and ``_right``. What both have
are their keys, the load that they came with among them, so that rows of two loads are not linked. ``edges`` gives every pair.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators import sides

#: Databases that are never dropped or cleared.
PROTECTED = ("default", "information_schema", "pg_catalog", "ag_catalog")


class Store:
    """Databases below one shared folder; a graph is a database with the tables ``vertices`` and ``edges``, or the sides of edges."""

    def __init__(self, spark: SparkSession, location: str):
        self.spark, self.location = spark, location.rstrip("/")

    def _checked(self, name: str, change: bool = False) -> str:
        if not re.fullmatch("[a-zA-Z_][a-zA-Z0-9_]*", name):
            raise ValueError(f"{name!r} is not a valid name")
        if change and name.lower() in PROTECTED:
            raise ValueError(f"{name} is protected")
        return name

    def create(self, name: str) -> None:
        """A new empty database; one that is there stays as it is."""
        self.spark.sql(f"CREATE DATABASE IF NOT EXISTS `{self._checked(name, True)}` LOCATION '{self.location}/{name}'")

    def drop(self, name: str) -> None:
        """The database and all its tables go."""
        self.spark.sql(f"DROP DATABASE IF EXISTS `{self._checked(name, True)}` CASCADE")

    def clear(self, name: str) -> None:
        """All tables of the database stay, without rows."""
        for t in self.tables(name):
            self.spark.sql(f"TRUNCATE TABLE `{self._checked(name, True)}`.`{t}`")

    def tables(self, name: str) -> list[str]:
        return sorted(t.name for t in self.spark.catalog.listTables(self._checked(name)))

    def load(self, name: str, tables: dict[str, DataFrame], clear: bool = False, complete: dict[str, tuple[DataFrame, DataFrame]] | None = None) -> None:
        """Appends the tables' rows by column name; with ``clear`` every table of the database is emptied before. ``complete``: relations as their two sides."""
        there = self.tables(name)
        for t, ends in (complete or {}).items():
            tag = F.lit(uuid.uuid4().hex).alias("load")
            tables = tables | {f"{t}_{end}": df.select("*", tag) for end, df in zip(("left", "right"), ends)}
        if clear:
            self.clear(name)
        for t, df in tables.items():
            if t in there:
                columns = self.spark.table(f"`{name}`.`{t}`").columns
                df = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).alias(c) for c in columns])
            df.write.mode("append").format("parquet").saveAsTable(f"`{name}`.`{t}`")

    def table(self, name: str, table: str) -> DataFrame:
        return self.spark.table(f"`{self._checked(name)}`.`{table}`")

    def edge_parts(self, name: str) -> tuple[DataFrame | None, tuple[DataFrame, DataFrame] | None]:
        """The stored edges of a graph, and the two sides of those that are stored as such; None if it has no such tables."""
        there = self.tables(name)
        plain = self.table(name, "edges") if "edges" in there else None
        return plain, (self.table(name, "edges_left"), self.table(name, "edges_right")) if "edges_left" in there else None

    def edges(self, name: str) -> DataFrame:
        """(src, dst, label): every edge of a graph, however it is stored."""
        plain, ends = self.edge_parts(name)
        found = [] if plain is None else [plain.select("src", "dst", "label")]
        if ends:
            found.append(sides.labelled(*ends))
        return found[0] if len(found) == 1 else found[0].unionAll(found[1])

    def _n_edges(self, name: str) -> DataFrame:
        """(edges): one row with the count of all edges; sides are counted by their groups."""
        plain, ends = self.edge_parts(name)
        found = [] if plain is None else [plain.agg(F.count("*").alias("n"))]
        if ends:
            found.append(sides.total(*ends, sides.shared(*ends)))
        n = found[0] if len(found) == 1 else found[0].unionAll(found[1])
        return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("edges"))

    def graphs(self, like: str = "*") -> list[str]:
        """Names of the databases that hold a graph."""
        found = [d.name for d in self.spark.catalog.listDatabases(like)]
        return sorted(d for d in found if "vertices" in (t := self.tables(d)) and ("edges" in t or "edges_left" in t))

    def sizes(self, names: list[str]) -> DataFrame:
        """(graph, vertices, edges) of the named graphs."""
        out = None
        for name in names:
            v = self.table(name, "vertices").agg(F.count("*").alias("vertices"))
            x = v.crossJoin(self._n_edges(name)).select(F.lit(name).alias("graph"), "vertices", "edges")  # one row each
            out = x if out is None else out.unionAll(x)
        return out
