"""Hard-negative mining by Four-Russians scoring.

Components become whole numbers, floor(scale * x). A candidate's eight components of a group are stored as one byte per bit of
their two's complement, the bit-plane bytes; an anchor has a table of the sums of all 256 subsets of its eight
components of a group. The inner product is then exact: per bit, one table lookup a group, added up, doubled from bit to bit (the sign bit
counts negative). Tables of a block of anchors lie side by side, so one lookup serves them all.

Anchors and candidates meet in a grid of blocks: both are dealt into parts of a set size, each pair of parts is one group of a
cogroup, and what leaves it is a few rows for each of its anchors. Two passes are made over the grid: the first scores candidates of an
anchor's own label and keeps the best ``n_positives``; the second scores all others and keeps, for each positive, the best
``n_negatives`` whose score lies in the window ``low`` to ``high`` hundredths of the positive's. Parts are dealt by row, not by label or vector, so neither a
frequent label nor copies of a vector make a part large.

Defined cases: rows with a null label or vector, or with a null or non-finite component, take no part; an empty vector scores 0 with all, and
shorter vectors count as filled up with zeros; a null vec_id is never an anchor and comes last among equal scores; rows that repeat an
anchor's id are not its partners; other repeated rows are partners each, and exactly repeated anchors are one; a positive of negative
score has an empty window; scores beyond 62 bits raise; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import staged

#: Rows of a part of candidates and of anchors, and anchors whose tables lie side by side.
CANDIDATES, ANCHORS, BESIDE = 16_384, 65_536, 32
#: Stands for a null vec_id, after all others.
NO_ID = (1 << 63) - 1


def bit_planes(x: np.ndarray, bits: int) -> np.ndarray:
    """Rows of whole numbers, a multiple of eight wide -> (bits, groups, rows) bytes: per bit and group, the bits of eight components."""
    u = x.astype(np.int64).view(np.uint64)
    return np.stack([np.packbits(((u >> np.uint64(k)) & np.uint64(1)).astype(np.uint8), axis=1, bitorder="little").T for k in range(bits)])


def subset_sums(a: np.ndarray) -> np.ndarray:
    """Anchors, a multiple of eight wide -> (groups, 256, anchors): sums of the subsets of eight components."""
    a = a.reshape(len(a), -1, 8)
    sums = np.zeros((a.shape[1], 256, len(a)), a.dtype)
    for j in range(8):
        sums[:, 1 << j : 2 << j] = sums[:, : 1 << j] + a[:, :, j].T[:, None, :]
    return sums


def scores(tables: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors): lookups of all groups added, bit by bit from the sign bit down."""
    bits, groups, n = planes.shape
    total = np.zeros((n, tables.shape[2]), tables.dtype)
    step = np.empty_like(total)
    for k in range(bits - 1, -1, -1):
        total <<= 1
        for g in range(groups):
            np.take(tables[g], planes[k, g], axis=0, out=step, mode="clip")
            if k == bits - 1:
                total -= step
            else:
                total += step
    return total


def best(s: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of the places ``at``, in order of id, the k with the highest scores; equal scores by place."""
    if len(at) > k:
        least = np.partition(s[at], -k)[-k]
        at = at[s[at] >= least]
    return at[np.argsort(-s[at], kind="stable")][:k]


def valid_rows(rows: DataFrame, scale: int, label: Column | None, cols: tuple[str, str, str]) -> DataFrame:
    """(vec_id, label, x): the rows that take part, with whole numbers."""
    d = rows.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(cols, ("vec_id", "label", "x"), strict=True)])
    d = d.withColumn("x", F.transform("x", lambda v: v.cast("double")))
    odd = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    d = d.filter(F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(odd, F.lit(False)))
    return d.select(F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"), F.transform("x", lambda v: F.floor(v * scale)).alias("x"))


def _width(dims: int) -> int:
    return max(8, -(-dims // 8) * 8)


def _dense(column: pa.Array, width: int) -> np.ndarray:
    """Lists of numbers as rows of one width, filled up with zeros."""
    column = pa.chunked_array([column]).combine_chunks() if isinstance(column, pa.Array) else column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    if len(sizes):
        out[np.arange(width) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
    return out


def _packed(d: DataFrame, dims: int, bits: int, parts: int) -> DataFrame:
    """(part, vec_id, label, planes): candidates dealt to parts in turn."""
    width = _width(dims)

    def run(batches):
        at = TaskContext.get().partitionId() * 7
        for b in batches:
            p = bit_planes(_dense(b.column("x"), width), bits).transpose(2, 0, 1).reshape(b.num_rows, -1)
            flat = pa.FixedSizeBinaryArray.from_buffers(pa.binary(p.shape[1]), b.num_rows, [None, pa.py_buffer(np.ascontiguousarray(p))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array((at + np.arange(b.num_rows)) % parts, pa.int32()), b.column("vec_id"), b.column("label"), flat], ["part", "vec_id", "label", "planes"])
            at += b.num_rows

    return staged(d.mapInArrow(run, "part int, vec_id long, label long, planes binary"), "candidates")


class Block:
    """Candidates of one group, in order of id."""

    def __init__(self, t: pa.Table, bits: int, width: int):
        ids = t.column("vec_id").fill_null(NO_ID).to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], t.column("label").to_numpy()[order]
        raw = np.frombuffer(b"".join(t.column("planes").to_pylist()), np.uint8).reshape(len(ids), bits, width // 8)
        self.planes = np.ascontiguousarray(raw[order].transpose(1, 2, 0))


def _grid(anchors: DataFrame, candidates: DataFrame, a_parts: int, c_parts: int, score, schema: str) -> DataFrame:
    """Each pair of parts is one group; ``score`` gets both as Arrow tables."""
    a = anchors.withColumn("c_part", F.explode(F.sequence(F.lit(0), F.lit(c_parts - 1))))
    c = candidates.withColumnRenamed("part", "c_part").withColumn("a_part", F.explode(F.sequence(F.lit(0), F.lit(a_parts - 1))))
    return a.groupBy("a_part", "c_part").cogroup(c.groupBy("a_part", "c_part")).applyInArrow(score, schema)


def _nothing(spark, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def hard_negatives(rows: DataFrame, is_anchor: Column, label: Column | None = None, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, cols: tuple[str, str, str] = ("vec_id", "label", "embedding"), part_rows: tuple[int, int] = (ANCHORS, CANDIDATES)) -> DataFrame:
    """Per anchor and positive, the first negatives: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` and ``label`` (whole numbers) are expressions of vec_id and label.
    """
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    d = valid_rows(rows, scale, label, cols)
    anchor = F.coalesce(is_anchor, F.lit(False)) & F.col("vec_id").isNotNull()
    low_x, high_x = F.array_min("x"), F.array_max("x")
    n, n_anchors, dims, least, most = d.agg(F.count("*"), F.count_if(anchor), F.max(F.size("x")), F.min(low_x), F.max(high_x)).first()
    if not n_anchors:
        return _nothing(rows.sparkSession, result)
    # Two's complement: one bit for the sign.
    bits = 1 + max(int(x if x >= 0 else -x - 1).bit_length() for x in (least or 0, most or 0))
    width = _width(dims)
    size = 2 * bits + max(dims, 1).bit_length()
    if size > 62:
        raise ArithmeticError(f"scores of {dims} components of {bits} bits do not fit 62 bits")
    number = np.int32 if size <= 31 else np.int64
    a_parts, c_parts = ceil(n_anchors / part_rows[0]), ceil(n / part_rows[1])
    candidates = _packed(d, dims, bits, c_parts)
    key = F.xxhash64("label", "x")
    anchors = staged(d.filter(anchor).select("vec_id", "label", "x").distinct().select("vec_id", "label", "x", key.alias("a_key"), F.pmod(F.xxhash64("vec_id", "label", "x"), F.lit(a_parts)).cast("int").alias("a_part")), "anchors")

    def scored(a: pa.Table, block: Block, own: bool):
        """(place of an anchor, places of the candidates of its own or of other labels, their scores), a few anchors at a time."""
        x, labels = _dense(a.column("x"), width).astype(number), a.column("label").to_numpy()
        for value in np.unique(labels):
            places, some = np.flatnonzero(labels == value), np.flatnonzero((block.labels == value) == own)
            planes = np.ascontiguousarray(block.planes[:, :, some])
            for k in range(0, len(places), BESIDE):
                found = np.ascontiguousarray(scores(subset_sums(x[places[k : k + BESIDE]]), planes).T)
                yield from ((place, some, s) for place, s in zip(places[k : k + BESIDE], found, strict=True))

    def positives(_, a: pa.Table, c: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and c.num_rows:
            block, ids = Block(c, bits, width), a.column("vec_id").to_numpy()
            for place, same, s in scored(a, block, True):
                for at in best(s, np.flatnonzero(block.ids[same] != ids[place]), n_positives):
                    out.append((place, block.ids[same[at]], s[at]))
        place, found, score = (np.array(v, np.int64) for v in (zip(*out, strict=True) if out else ((), (), ())))
        return pa.table([a.column("vec_id").take(place), a.column("a_key").take(place), pa.array(found), pa.array(score)], ["vec_id", "a_key", "positive_id", "positive_score"])

    found = _grid(anchors, candidates, a_parts, c_parts, positives, "vec_id long, a_key long, positive_id long, positive_score long")
    place = Window.partitionBy("vec_id", "a_key").orderBy(F.desc("positive_score"), "positive_id")
    found = found.withColumn("place", F.row_number().over(place)).filter(F.col("place") <= n_positives)
    chosen = found.groupBy("vec_id", "a_key").agg(F.sort_array(F.collect_list(F.struct("place", "positive_id", "positive_score"))).alias("p"))
    chosen = chosen.select("vec_id", "a_key", F.col("p.positive_id").alias("p_ids"), F.col("p.positive_score").alias("p_scores"))
    anchors = staged(anchors.join(chosen, ["vec_id", "a_key"]), "positives")

    def negatives(_, a: pa.Table, c: pa.Table) -> pa.Table:
        out = []
        if a.num_rows and c.num_rows:
            block, ids = Block(c, bits, width), a.column("vec_id").to_numpy()
            p_scores = a.column("p_scores").to_pylist()
            for place, other, s in scored(a, block, False):
                windows = [(-(-low * p // 100), high * p // 100) for p in p_scores[place]]
                bottom, top = min(w[0] for w in windows), max(w[1] for w in windows)
                near = np.flatnonzero((s >= bottom) & (s <= top))
                near = near[block.ids[other[near]] != ids[place]]
                for k, (lo, hi) in enumerate(windows):
                    for at in best(s, near[(s[near] >= lo) & (s[near] <= hi)], n_negatives):
                        out.append((place, k, block.ids[other[at]], s[at]))
        place, k, found, score = (np.array(v, np.int64) for v in (zip(*out, strict=True) if out else ((), (), (), ())))
        return pa.table([a.column("vec_id").take(place), a.column("a_key").take(place), pa.array(k, pa.int32()), pa.array(found), pa.array(score)], ["vec_id", "a_key", "place", "negative_id", "negative_score"])

    found = _grid(anchors, candidates, a_parts, c_parts, negatives, "vec_id long, a_key long, place int, negative_id long, negative_score long")
    rank = Window.partitionBy("vec_id", "a_key", "place").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(rank)).filter(F.col("rank") <= n_negatives)
    found = found.join(anchors.select("vec_id", "a_key", "p_ids", "p_scores"), ["vec_id", "a_key"])
    real = lambda c: F.when(c != NO_ID, c)
    return found.select(F.col("vec_id").alias("anchor_id"), real(F.get("p_ids", "place")).alias("positive_id"), "rank", real(F.col("negative_id")).alias("negative_id"), F.get("p_scores", "place").alias("positive_score"), "negative_score")
