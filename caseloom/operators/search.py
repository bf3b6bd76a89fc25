"""Keyword search over properties by an inverted index of character trigrams, with the edges around what is found.

The index is two tables in one folder. Postings (gram, v_id) lie in buckets by the gram, elements in buckets by their id, both sorted
in them, so a search reads one bucket of postings for each of the keyword's grams, and of the elements only the buckets
that the rarest gram's candidates are in. Candidates are verified against their values. A keyword of fewer than three characters has no gram: all elements
are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseloom.operators.graph import capped, incident

GRAM, BUCKETS = 3, 64
#: Candidates up to which their ids are sent to all tasks; a shuffled join lies beyond.
BROADCAST_IDS = 100_000


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def contains(props: Column, keyword: str, names: list[str] | None = None) -> Column:
    """Whether a value of the properties, or of the named ones, contains the keyword; never null."""
    values = F.map_values(props) if names is None else F.array(*[F.try_element_at(props, F.lit(n)) for n in names])
    return F.coalesce(F.exists(values, lambda x: F.coalesce(F.contains(x, F.lit(keyword)), F.lit(False))), F.lit(False))


class Index:
    """An index below ``path`` over elements (v_id, label, props) of a graph: vertices, or edges with an id."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def build(self, elements: DataFrame) -> Index:
        e = elements.select("v_id", "label", "props")
        value = F.col("value")
        grams = F.when(F.length(value) >= GRAM, F.transform(F.sequence(F.lit(1), F.length(value) - GRAM + 1), lambda i: F.substring(value, i, F.lit(GRAM))))
        g = e.select("v_id", F.explode(F.map_values("props")).alias("value")).select("v_id", F.explode(F.array_distinct(grams)).alias("gram")).distinct()
        g = g.withColumn("bucket", _bucket(F.col("gram"), self.buckets))
        # Ids are dealt over several files of a bucket, so a gram that a third of all elements have is not one task.
        g.repartition("bucket", F.pmod(F.xxhash64("v_id"), F.lit(8))).sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/postings")
        e = e.withColumn("bucket", _bucket(F.col("v_id"), self.buckets))
        e.repartition("bucket").sortWithinPartitions("bucket", "v_id").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/elements")
        self.postings().groupBy("gram").agg(F.count("*").alias("n")).withColumn("bucket", _bucket(F.col("gram"), self.buckets)).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/counts")
        return self

    def postings(self) -> DataFrame:
        return self.spark.read.schema("v_id string, gram string, bucket int").parquet(f"{self.path}/postings")

    def elements(self) -> DataFrame:
        return self.spark.read.schema("v_id string, label string, props map<string,string>, bucket int").parquet(f"{self.path}/elements")

    def candidates(self, keyword: str) -> DataFrame | None:
        """Elements that have the rarest gram of the keyword, of the buckets they are in; None if the keyword has no gram."""
        grams = sorted({keyword[i : i + GRAM] for i in range(len(keyword) - GRAM + 1)})
        if not grams:
            return None
        spots = self.spark.createDataFrame([(x,) for x in grams], "gram string").withColumn("bucket", _bucket(F.col("gram"), self.buckets)).collect()
        counts = self.spark.read.schema("gram string, n long, bucket int").parquet(f"{self.path}/counts").filter(F.col("bucket").isin([r["bucket"] for r in spots]) & F.col("gram").isin(grams))
        n = {r["gram"]: r["n"] for r in counts.collect()}  # a row for each gram of the keyword
        if len(n) < len(grams):
            return self.elements().limit(0)
        rare = min(grams, key=lambda g: (n[g], g))
        ids = self.postings().filter((F.col("bucket") == next(r["bucket"] for r in spots if r["gram"] == rare)) & (F.col("gram") == rare)).select("v_id")
        among = [r[0] for r in ids.select(_bucket(F.col("v_id"), self.buckets)).distinct().collect()]  # at most ``buckets`` numbers
        few = F.broadcast(ids) if n[rare] <= BROADCAST_IDS else ids
        return self.elements().filter(F.col("bucket").isin(among)).join(few, "v_id", "left_semi")

    def search(self, keyword: str, names: list[str] | None = None) -> DataFrame:
        """(v_id, label, props) of the elements of which a value, or one of the named values, contains the keyword."""
        found = self.candidates(keyword)
        found = self.elements() if found is None else found
        return found.filter(contains(F.col("props"), keyword, names)).select("v_id", "label", "props")


def around(found: DataFrame, edges: DataFrame, most: int | None = 50, most_edges: int | None = 100) -> DataFrame:
    """(kind, id, label) of a search's result as a drawing needs it.

    The vertices found, at most ``most`` of a label; the edges at them, at most ``most_edges`` of a label; and the ends of those edges
    that are not among the vertices.
    """
    v = capped(found.select("v_id", "label"), ["label"], ["v_id"], most)
    e = incident(edges.select("src", "dst", "label"), v, most_edges)
    ends = e.select(F.explode(F.array("src", "dst")).alias("v_id")).distinct().join(v.select("v_id"), "v_id", "left_anti")
    parts = [v.select(F.lit("node").alias("kind"), F.col("v_id").alias("id"), "label"), e.select(F.lit("edge").alias("kind"), F.concat_ws(">", "src", "dst").alias("id"), "label"), ends.select(F.lit("end").alias("kind"), F.col("v_id").alias("id"), F.substring_index("v_id", ":", 1).alias("label"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


def matches(vertices: DataFrame, edges: DataFrame, keyword: str, names: list[str], edge_names: list[str], most: int | None = 30) -> DataFrame:
    """(v, e_id, label, n): edges in either direction of which the start v, by its named properties, or the edge itself contains the keyword.

    ``vertices`` are the start vertices found by an index; ``edges`` has e_id, src, dst, label and props.
    """
    hit = vertices.filter(contains(F.col("props"), keyword, names)).select(F.col("v_id").alias("v"))
    both = edges.select(F.col("src").alias("v"), "e_id", "label", F.col("dst").alias("n"), "props").unionAll(edges.select(F.col("dst").alias("v"), "e_id", "label", F.col("src").alias("n"), "props"))
    by_edge = both.filter(contains(F.col("props"), keyword, edge_names)).drop("props")
    rows = both.drop("props").join(hit, "v", "left_semi").unionAll(by_edge).distinct()
    return rows if most is None else rows.orderBy("v", "e_id", "n").limit(most)
