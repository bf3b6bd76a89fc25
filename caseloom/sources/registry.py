"""Named sources of tables: folders of Parquet, or JDBC databases read by ranges of a column."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Sources:
    """Add, remove, list and read sources by name."""

    known: dict[str, dict[str, str]] = field(default_factory=dict)

    def add(self, name: str, **options: str) -> None:
        """``path=...`` for a folder with one Parquet table per entry, or the options of Spark's jdbc reader."""
        if not name.isidentifier() or not ({"path", "url"} & set(options)):
            raise ValueError("a source needs a plain name and a path or url")
        self.known[name] = options

    def remove(self, name: str) -> None:
        self.known.pop(name, None)

    def names(self) -> list[str]:
        return sorted(self.known)

    def _jdbc(self, spark: SparkSession, name: str):
        return spark.read.format("jdbc").options(**self.known[name])

    def tables(self, spark: SparkSession, name: str, query: str | None = None) -> list[str]:
        """The tables of a source: the folder's entries, or what ``query`` (one column) returns of a database's catalog."""
        options = self.known[name]
        if "path" in options:
            # The reader's own listing, so that a folder in any store will do.
            files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(options["path"]).select("path")
            return sorted({r["path"].split(options["path"].rstrip("/").split("/")[-1] + "/")[-1].split("/")[0].removesuffix(".parquet") for r in files.collect()})
        query = query or "SELECT table_name FROM information_schema.tables"
        return sorted(r[0] for r in self._jdbc(spark, name).option("query", query).load().collect())

    def read(self, spark: SparkSession, name: str, table: str, by: str | None = None, rows: int = 1_000_000) -> DataFrame:
        """A table of a source. Of a database, with ``by`` (a number or time column), as ranges of it of about ``rows`` rows each.

        Bounds and count are asked of the database first, in one query; rows with a null are in the first range. Filters and the
        choice of columns made on the result go to the database with each range. An empty table, or one whose values are all
        equal or null, is read in one piece.
        """
        options = self.known[name]
        if "path" in options:
            return spark.read.parquet(f"{options['path']}/{table}.parquet")
        reader = self._jdbc(spark, name)
        if by is None:
            return reader.option("dbtable", table).load()
        c = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(options["url"]).quoteIdentifier(by)  # as the reader quotes it itself
        least, most, n = reader.option("query", f"SELECT min({c}) AS lo, max({c}) AS hi, count(*) AS n FROM {table}").load().first()
        reader = self._jdbc(spark, name).option("dbtable", table)
        if least is None:
            return reader.load()
        if least == most:
            return reader.load()
        # The bounds only set the width of the ranges; the first and the last are open.
        parts = max(1, -(-int(n) // rows))
        return reader.option("partitionColumn", by).option("lowerBound", str(least)).option("upperBound", str(most)).option("numPartitions", parts).load()
