"""SimHash near-dedup with a Gray-order hierarchical index.

Fingerprints: 64 bits over word shingles; a bit is set if it is set in over half of the shingles'
XXH64 hashes. Documents with equal fingerprints are one node from then on, so copies cost nothing.

Links are fingerprints that differ in at most ``max_bits`` bits. The 64 bits are cut into b blocks;
two linked fingerprints agree on some b - max_bits of them (pigeonhole), so each fingerprint is sent
to one bucket per choice of blocks and no link is lost. b grows with the count of fingerprints, which
keeps the expected bucket small at any size. In a bucket the fingerprints are sorted by Gray rank and
indexed as a hierarchy: a node holds the bits that all below it share (mask and pattern), a pair of nodes adds
the differences in the bits that are shared only from its level on to those found above it, and is pruned with
everything below it once they are too many. Every bucket is searched this way, all buckets of a task at once.
Buckets above ``bucket_rows`` are split into parts, and every pair of parts is a bucket of its own.

A bucket returns a spanning set of its links, not all pairs. Components are then found by
alternating large-star and small-star steps, staged in the shared folder.

Defined cases: null text counts as empty; a text without words has fingerprint zero and is linked
like any other; a repeated row is a document like any other with the same id; an empty table gives an
empty result; other columns are ignored. A null id stands for itself and is never a group's smallest
id unless the group has no other.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import fresh_names, keyed, staged

U = np.uint64


def fingerprint_of(text: bytes, size: int, seed: int) -> int:
    """The fingerprint of one text in UTF-8."""
    import xxhash

    words = text.lower().split()  # of bytes: A-Z only, and exactly the six ASCII white spaces
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(line, seed)], U)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())), U, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded memory for very long texts
        counts += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(U)[0])


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, fingerprint as a long) of every row."""
    d = keyed(docs, id_col, text_col).select("doc_id", F.encode("text", "utf-8").alias("text"), "text_key")
    schema = T.StructType([T.StructField("doc_id", d.schema["doc_id"].dataType), T.StructField("text_key", T.LongType()), T.StructField("fp", T.LongType())])

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint_of(x.as_buffer().to_pybytes(), shingle, seed) for x in b.column(1)], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps)], ["doc_id", "text_key", "fp"])

    return d.mapInArrow(run, schema)


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each value in the Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> U(s)
    return x


#: Children of a node, and node pairs that are tested at a time.
FAN, PIECE = 16, 1 << 12


def hierarchies(tree: np.ndarray, fps: np.ndarray, fan: int = FAN):
    """The levels of one hierarchy per tree, leaves first; ``fps`` are sorted by tree and, in a tree, by Gray rank.

    A level is (mask, pattern, above, first, count): the bits that all below a node share, the mask of its parent, and
    its children in the level below. The last level has one node per tree.
    """
    mask, pattern, owner = np.full(len(fps), ~U(0)), fps, tree
    out = [[mask, pattern, None, None, None]]
    while True:
        start = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
        size = np.diff(np.append(start, len(owner)))
        if size.max(initial=0) <= 1:
            break
        first = np.flatnonzero((np.arange(len(owner)) - np.repeat(start, size)) % fan == 0)
        count = np.diff(np.append(first, len(owner)))
        ones, zeros = np.bitwise_and.reduceat(pattern, first), np.bitwise_and.reduceat(~pattern & mask, first)
        mask, pattern, owner = ones | zeros, ones, owner[first]
        out[-1][2] = np.repeat(mask, count)
        out.append([mask, pattern, None, first, count])
    out[-1][2] = np.zeros(len(mask), U)
    return out


def linked_pairs(levels, left: np.ndarray, right: np.ndarray, max_bits: int):
    """Yields index arrays (i, j) of linked leaves of the tree pairs (left, right).

    A pair of nodes carries the differences found above it and adds those in the bits that are shared only from here on;
    it is dropped with all below it once they are over ``max_bits``. A tree is paired with itself to find its own links.
    """
    stack = [(len(levels) - 1, left, right, np.zeros(len(left), np.uint8))]
    while stack:
        k, i, j, found = stack.pop()
        if len(i) > PIECE:  # depth first in pieces, so that the front stays small
            stack += [(k, i[s : s + PIECE], j[s : s + PIECE], found[s : s + PIECE]) for s in range(0, len(i), PIECE)]
            continue
        mask, pattern, above, first, count = levels[k]
        fresh = mask[i] & mask[j] & ~(above[i] & above[j])
        found = found + np.bitwise_count((pattern[i] ^ pattern[j]) & fresh)
        ok = found <= max_bits
        i, j, found = i[ok], j[ok], found[ok]
        if k == 0:
            yield i[i != j], j[i != j]
        elif len(i):
            n = count[i] * count[j]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            width = np.repeat(count[j], n)
            a, b = np.repeat(first[i], n) + at // width, np.repeat(first[j], n) + at % width
            ok = a <= b  # equal only below a node paired with itself; trees of a pair are in order
            stack.append((k - 1, a[ok], b[ok], np.repeat(found, n)[ok]))


class Groups:
    """Labels of linked rows, the smallest row of each group."""

    def __init__(self, size: int):
        self.label = np.arange(size)

    def join(self, i: np.ndarray, j: np.ndarray):
        while True:
            a, b = self.label[i], self.label[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            np.minimum.at(self.label, np.maximum(a, b), np.minimum(a, b))
            while True:
                short = self.label[self.label]
                if np.array_equal(short, self.label):
                    break
                self.label = short


def forest_links(tree: np.ndarray, fps: np.ndarray, left: np.ndarray, right: np.ndarray, max_bits: int) -> np.ndarray:
    """A spanning set of links, (n, 2), of the tree pairs; ``tree`` numbers the trees from 0, in order, ``left`` < ``right`` or equal."""
    order = np.lexsort((gray_rank(fps), tree))
    fps = fps[order]
    groups = Groups(len(fps))
    for i, j in linked_pairs(hierarchies(tree[order], fps), left, right, max_bits):
        groups.join(i, j)
    moved = np.flatnonzero(groups.label != np.arange(len(fps)))
    return np.stack((fps[moved], fps[groups.label[moved]]), 1)


def bucket_links(fps: np.ndarray, other: np.ndarray | None, max_bits: int) -> np.ndarray:
    """A spanning set of links, (n, 2), of one bucket or of two parts of one."""
    if other is None:
        return forest_links(np.zeros(len(fps), np.int64), fps, np.zeros(1, np.int64), np.zeros(1, np.int64), max_bits)
    tree = np.repeat([0, 1], [len(fps), len(other)])
    return forest_links(tree, np.concatenate((fps, other)), np.zeros(1, np.int64), np.ones(1, np.int64), max_bits)


def blocks_for(n: int, max_bits: int, bucket: int = 64) -> int:
    """The fewest blocks whose buckets hold about ``bucket`` of n random fingerprints at most."""
    b = max_bits + 1
    while n / 2 ** (64 * (b - max_bits) // b) > bucket and comb(b + 1, max_bits) <= 128:
        b += 1
    return b


def links(fps: DataFrame, max_bits: int = 4, bucket_rows: int = 20_000, blocks: int | None = None) -> DataFrame:
    """(a, b): a spanning set of the links between the distinct fingerprints of ``fps`` (column fp)."""
    b = blocks or blocks_for(fps.count(), max_bits)
    edges = [64 * k // b for k in range(b + 1)]
    masks = []
    for chosen in combinations(range(b), b - max_bits):
        m = sum(((1 << (edges[k + 1] - edges[k])) - 1) << edges[k] for k in chosen)
        masks.append(m - (1 << 64) if m >> 63 else m)
    table = F.array(*[F.struct(F.lit(k).cast("int").alias("c"), F.lit(m).cast("long").alias("m")) for k, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(table).alias("x")).select("fp", F.col("x.c").alias("c"), F.col("fp").bitwiseAND(F.col("x.m")).alias("bits"))
    sizes = rows.groupBy("c", "bits").agg(F.count("*").alias("n")).filter("n > 1")
    rows = rows.join(sizes, ["c", "bits"])
    # Part p of a large bucket goes to the pairs (p, q) and (q, p), smaller part first.
    parts = F.ceil(F.col("n") / bucket_rows).cast("int")
    rows = rows.withColumn("parts", parts).withColumn("p", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
    rows = rows.select("fp", "c", "bits", "p", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("q"))
    rows = rows.select("c", "bits", F.least("p", "q").alias("lo"), F.greatest("p", "q").alias("hi"), (F.col("p") > F.col("q")).alias("second"), "fp")
    rows = rows.repartition("c", "bits", "lo", "hi").sortWithinPartitions("c", "bits", "lo", "hi")

    def emit(found):
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0].view(np.int64)), pa.array(found[:, 1].view(np.int64))], ["a", "b"])

    def run(batches):
        held: list = []  # the columns of the bucket that goes on in the next batch

        def buckets(final):
            nonlocal held
            if not held:
                return None
            c = [np.concatenate(x) for x in zip(*held)]
            new = np.concatenate(([True], np.any([x[1:] != x[:-1] for x in c[:4]], 0)))
            upto = len(new) if final else int(np.flatnonzero(new)[-1])
            held = [] if final else [[x[upto:] for x in c]]
            if not upto:
                return None
            lo, hi, second, fp = c[2][:upto], c[3][:upto], c[4][:upto], c[5][:upto].view(U)
            bucket = np.cumsum(new[:upto]) - 1
            # A bucket is one tree, or the trees of its two parts; all buckets are searched at once.
            side = bucket * 2 + second
            trees, tree = np.unique(side, return_inverse=True)
            own = np.flatnonzero(new[:upto])
            single = lo[own] == hi[own]
            a, b = np.arange(len(own)) * 2, np.arange(len(own)) * 2 + ~single
            there = np.isin(a, trees) & np.isin(b, trees)
            return forest_links(tree, fp, np.searchsorted(trees, a[there]), np.searchsorted(trees, b[there]), max_bits)

        size = 0
        for b_ in batches:
            held.append([b_.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 4, 5)])
            size += b_.num_rows
            if size >= 100_000:
                if (found := buckets(False)) is not None and len(found):
                    yield emit(found)
                size = 0
        if (found := buckets(True)) is not None and len(found):
            yield emit(found)

    return rows.mapInArrow(run, "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable from every node of ``edges`` (a, b), by alternating star steps."""
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionAll(low.select("u", F.col("m").alias("v"))).distinct()
        new = staged(small, "edges")
        sums = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
        done = new.agg(*sums).first() == e.agg(*sums).first()
        e = new
        if done:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", bucket_rows: int = 20_000) -> DataFrame:
    """Per row: doc_id, text_key, fp (long), root (the component), component_id (smallest id of the linked documents, itself included)."""
    fp = staged(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    nodes = staged(fp.groupBy("fp").agg(F.min("doc_id").alias("low")), "nodes")
    comp = components(links(nodes.select("fp"), max_bits, bucket_rows))
    named = nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = named.join(lowest, "root").select("fp", "root", "component_id")
    return fp.join(named, "fp").select("doc_id", "text_key", "fp", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int = 4, max_bits: int = 4, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """Of each component the document with the smallest id, with all its columns; of rows that repeat its id and text, one.

    If several texts of a component have that id, or no document of it has an id, the smallest text key decides.
    """
    id_, key, own_key = fresh_names(docs, "id", "key", "text_key")
    low = near_duplicates(docs, shingle, max_bits, id_col=id_col, text_col=text_col, **kw).filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = low.groupBy("root", F.col("doc_id").alias(id_)).agg(F.min("text_key").alias(key)).drop("root")
    d = docs.withColumn(own_key, F.xxhash64(F.col(f"`{text_col}`").cast("string")))
    d = d.join(kept, F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & (F.col(own_key) == F.col(key)), "left_semi")
    return d.dropDuplicates([id_col, own_key]).drop(own_key)
