"""M5: a table of distinct edges that grows batch by batch, kept in buckets by a hash of the edge.

A bucket is a prefix of the hash's bits. When it has more than ``bucket_rows`` rows it is split by further bits, so buckets stay about
that size however large the table is. A batch finds the buckets that its edges belong to, reads and rewrites only those, below its own
folder, and then writes its manifest: every bucket with the folder that holds it. So what a batch reads is at most its own rows times a
bucket, whatever came before. A batch that is replayed starts from the manifest before it and overwrites its own folder, which
changes nothing; a batch that fails half way has written no manifest and is not seen.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["src", "dst", "label"]
#: Bits of the hash that prefixes are taken of.
BITS = 40
ENTRY = "depth int, prefix long, folder string, n_rows long"


def _hash():
    return F.pmod(F.xxhash64(*KEY), F.lit(1 << BITS))


def _prefix(depth: int):
    return F.shiftright("h", BITS - depth)


class EdgeStore:
    """Edges (src, dst, label) below ``path``; one writer at a time."""

    def __init__(self, spark: SparkSession, path: str, bucket_rows: int = 1_000_000):
        self.spark, self.path, self.bucket_rows = spark, path, bucket_rows

    def manifest(self, batch: int) -> list:
        """The buckets after a batch (depth, prefix, folder, n_rows); before the first one there is one empty bucket. One row a bucket, on the driver."""
        if batch < 0:
            return [(0, 0, None, 0)]
        return [tuple(r) for r in self.spark.read.schema(ENTRY).parquet(f"{self.path}/manifest/batch={batch}").collect()]

    def last(self) -> int:
        """The last batch that has a manifest; -1 if there is none."""
        try:
            done = self.spark.read.schema(f"{ENTRY}, batch int").parquet(f"{self.path}/manifest").select(F.max("batch")).first()[0]
        except AnalysisException:  # no folder yet
            return -1
        return -1 if done is None else done

    def merge(self, rows: DataFrame, batch: int) -> dict:
        """Adds the rows of a batch; returns how many rows it read, wrote and touched buckets."""
        new = rows.select(*KEY).distinct().withColumn("h", _hash())
        entries = self.manifest(batch - 1)
        known = self.spark.createDataFrame([(d, p, i) for i, (d, p, _, _) in enumerate(entries)], "depth int, prefix long, entry int")
        depths = sorted({e[0] for e in entries})
        at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in depths])).alias("b")
        placed = new.select("*", at).select(*KEY, "h", "b.*").join(F.broadcast(known), ["depth", "prefix"]).select(*KEY, "h", "entry")  # one row a bucket: bounded by the table's size over bucket_rows
        counts = {r["entry"]: r["n"] for r in placed.groupBy("entry").agg(F.count("*").alias("n")).collect()}
        if not counts:
            self._write_manifest(entries, batch)
            return {"read": 0, "written": 0, "buckets": 0}
        touched = {i: entries[i] for i in counts}
        folders = [e[2] for e in touched.values() if e[2]]
        if folders:
            old = self.spark.read.schema("src string, dst string, label string, h long").parquet(*folders)
            new = new.unionByName(old).dropDuplicates(KEY)
        # A touched bucket is split by as many bits as its rows, old and new, may need.
        deeper = {i: min(BITS, e[0] + max(0, ceil(log2((e[3] + counts[i]) / self.bucket_rows)))) for i, e in touched.items()}
        spots = self.spark.createDataFrame([(touched[i][0], touched[i][1], deeper[i]) for i in touched], "depth int, prefix long, deeper int")
        at = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), _prefix(d).alias("prefix")) for d in sorted({e[0] for e in touched.values()})])).alias("b")
        merged = new.select("*", at).select(*KEY, "h", "b.*").join(F.broadcast(spots), ["depth", "prefix"])
        merged = merged.select(*KEY, "h", F.concat_ws("-", "deeper", F.expr(f"shiftright(h, {BITS} - deeper)")).alias("bucket"))
        out = f"{self.path}/edges/batch={batch}"
        merged.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
        wrote = self.spark.read.schema("src string, bucket string").parquet(out).groupBy("bucket").agg(F.count("*").alias("n")).collect()
        fresh = [(*map(int, r["bucket"].split("-")), f"{out}/bucket={r['bucket']}", r["n"]) for r in wrote]
        there = {x[:2] for x in fresh}
        # Halves of a split bucket that got no row are buckets too.
        for i, (d, p, _, _) in touched.items():
            fresh += [(deeper[i], q, None, 0) for q in range(p << (deeper[i] - d), (p + 1) << (deeper[i] - d)) if (deeper[i], q) not in there]
        self._write_manifest([e for i, e in enumerate(entries) if i not in touched] + fresh, batch)
        return {"read": sum(e[3] for e in touched.values()), "written": sum(x[3] for x in fresh), "buckets": len(touched)}

    def _write_manifest(self, entries: list, batch: int) -> None:
        self.spark.createDataFrame(entries, ENTRY).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/batch={batch}")

    def edges(self, batch: int) -> DataFrame:
        """The whole table after a batch."""
        folders = [e[2] for e in self.manifest(batch) if e[2]]
        schema = "src string, dst string, label string"
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)


def load_edges(stream: DataFrame, path: str, bucket_rows: int = 1_000_000) -> DataFrame:
    """M5: merges each batch of a stream of edges into the store at ``path`` and returns the table after the last one."""
    store, last = EdgeStore(stream.sparkSession, path, bucket_rows), [-1]

    def merge(df, batch):
        store.merge(df, batch)
        last[0] = batch

    q = stream.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(merge).start()
    q.awaitTermination()
    if last[0] < 0:  # nothing new: the last manifest is that of an earlier run
        last[0] = store.last()
    return store.edges(last[0])
