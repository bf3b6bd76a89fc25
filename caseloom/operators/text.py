"""Chunks, entity documents, exact vector search and training-set preparation."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Characters whose cuts are found at a time.
CHARS = 1 << 20


def next_starts(points: np.ndarray, ends: np.ndarray, size: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """(stop, start): for every place of some texts in one row, where a chunk that begins there stops, and where the next one begins.

    ``points`` are code points, ``ends`` the end of each place's text. A chunk stops after the last '.' or newline of its ``size``
    characters if that is past their middle, and at their end if not; the next one begins ``overlap`` before that. The last chunk
    of a text is followed by the row's end, which follows itself.
    """
    n = len(points)
    at = np.arange(n)
    marks = np.maximum.accumulate(np.where((points == ord(".")) | (points == ord("\n")), at, -1))
    full = np.minimum(at + size, ends)
    mark = marks[full - 1]
    stop = np.where((full < ends) & (mark - at > size // 2), mark + 1, full)
    start = np.append(np.where(full < ends, stop - overlap, n), n)
    return stop, start


def chunk_starts(begins: np.ndarray, start: np.ndarray) -> np.ndarray:
    """All places that are reached from ``begins``, by pointer jumping: each round doubles how far the known ones reach."""
    n = len(start) - 1
    reached = np.zeros(n + 1, bool)
    reached[begins] = True
    while True:
        before = reached.sum()
        reached[start[np.flatnonzero(reached)]] = True
        if reached.sum() == before or (start == n).all():
            return np.flatnonzero(reached[:n])
        start = start[start]


def chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """(doc_id, chunk_index, text) of (doc_id, text): white space around a chunk goes, and chunks that are nothing else.

    Each cut depends on the one before. All texts of a block are cut together: where the next chunk would begin is computed for
    every place at once, and the places that are begun at are then found by pointer jumping.
    """
    schema = T.StructType([docs.schema["doc_id"], T.StructField("chunk_index", T.IntegerType()), T.StructField("text", T.StringType())])

    def run(batches):
        for b in batches:
            ids, texts = b.column(0), b.column(1).to_pylist()
            lengths = np.array([len(t) if t else 0 for t in texts], np.int64)
            total, first = np.cumsum(lengths), 0
            while first < len(texts):
                base = total[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(total, base + CHARS, "right")))
                sizes = lengths[first:last]
                row = "".join([t or "" for t in texts[first:last]])
                if row:
                    points = np.frombuffer(row.encode("utf-32-le", "surrogatepass"), np.uint32)
                    bounds = np.cumsum(sizes)
                    stop, start = next_starts(points, np.repeat(bounds, sizes), size, overlap)
                    begins = chunk_starts((bounds - sizes)[sizes > 0], start)
                    doc = np.searchsorted(bounds, begins, "right")
                    found = [(i, row[x:y].strip()) for i, x, y in zip(doc.tolist(), begins.tolist(), stop[begins].tolist(), strict=True)]
                    found = [x for x in found if x[1]]
                    place = np.array([x[0] for x in found], np.int64)
                    index = np.arange(len(place)) - np.searchsorted(place, place)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(place + first)), pa.array(index.astype(np.int32)), pa.array([x[1] for x in found], pa.string())], ["doc_id", "chunk_index", "text"])
                first = last

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def fixed_chunks(docs: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """X1, fixed width: chunks at every size - overlap characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.length("text") - overlap - 1), F.lit(size - overlap))
    d = docs.filter("length(text) > 0").select("doc_id", "text", F.posexplode(starts).alias("chunk_index", "start"))
    return d.select("doc_id", "chunk_index", F.substring("text", F.col("start") + 1, F.lit(size)).alias("text"))


def chunk_id(source: Column, index: Column) -> Column:
    """Eight digits of the source's digest and the chunk's number."""
    return F.concat_ws("_", F.substring(F.md5(source), 1, 8), index.cast("string"))


class ChunkStore:
    """Chunks (source, doc_id, chunk_index, text) below ``path``, a folder for each source, so that a source goes without the others being read."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(self, chunks: DataFrame) -> ChunkStore:
        """Replaces what is there. A folder is named by the source's digest, since a source may have any name."""
        d = chunks.select("source", "doc_id", "chunk_index", "text").withColumn("folder", F.md5(F.coalesce("source", F.lit(""))))
        d.write.mode("overwrite").partitionBy("folder").parquet(self.path)
        self.schema = d.schema
        return self

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).drop("folder")

    def delete(self, source: str) -> bool:
        """Removes a source's chunks; whether there were any."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/folder={hashlib.md5(source.encode()).hexdigest()}")
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def entity_text(label: Column, props: Column, names: list[str]) -> Column:
    """Label and the non-empty listed properties, as 'name: value' parts."""
    parts = [F.when(F.coalesce(props[n], F.lit("")) != "", F.concat(F.lit(f"{n}: "), props[n])) for n in names]
    return F.concat_ws(", ", F.concat(F.lit("["), label, F.lit("]")), *parts)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, block: tuple[int, int] = (8192, 16_384)) -> DataFrame:
    """(query_id, vec_id, score, rank): exact top k by cosine of every query against every vector.

    Both sides are dealt into parts of about ``block`` rows, queries and vectors; each pair of parts is one group of a cogroup and
    one matrix product, and only its best k per query go on, so what is shuffled afterwards is queries x parts x k rows.
    """
    nq, nv = (max(1, -(-df.count() // size)) for df, size in ((queries, block[0]), (vectors, block[1])))

    def side(df, own, n_own, other, n_other):
        part = F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(n_own)).cast("int").alias(own)
        return df.select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"), part, F.explode(F.sequence(F.lit(0), F.lit(n_other - 1))).alias(other)).groupBy("q_part", "v_part")

    def unit(t):
        m = np.stack(t.column("e").to_numpy()) if t.num_rows else np.zeros((0, 1))
        return t.column("vec_id").to_numpy(), m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)

    def score(_, a: pa.Table, b: pa.Table) -> pa.Table:
        (qi, q), (vi, v) = unit(a), unit(b)
        if not len(qi) or not len(vi):
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        keep, out = min(k, len(vi)), []
        for at in range(0, len(qi), 512):
            s = q[at : at + 512] @ v.T
            s[qi[at : at + 512, None] == vi[None, :]] = -np.inf  # not itself
            best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
            out.append((np.repeat(qi[at : at + 512], keep), vi[best.ravel()], np.take_along_axis(s, best, 1).ravel()))
        ids, found, s = (np.concatenate(x) for x in zip(*out, strict=True))
        ok = np.isfinite(s)
        return pa.table({"query_id": ids[ok], "vec_id": found[ok], "score": s[ok]})

    found = side(queries, "q_part", nq, "v_part", nv).cogroup(side(vectors, "v_part", nv, "q_part", nq)).applyInArrow(score, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def sampled(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """A sample of n rows in an order that only the key and the seed decide."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(key).cast("string"))), key).limit(n)


def oversampled(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times."""
    return df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
