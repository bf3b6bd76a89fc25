"""Suffix-array dedup: removes every byte of a string of ``length`` bytes that starts at two places or more.

Bucket-pointer refinement over the suffixes, kept sparse. Each window of starts has one place that is
chosen by its content (the smallest hash of a short gram), so that equal strings choose equal places.
The suffixes at these places get their initial buckets by the q-gram that stands there, q being what every
string of the window has in common; buckets of one suffix are settled at once. The others are refined
by the identifiers of what stands at their later and earlier offsets, and each result is reused by the next,
finer step:

1. whole windows: suffixes of one bucket that also agree on all that their window's strings cover are settled
   (all those strings are repeated);
2. blocks of 32 starts, only in buckets that step 1 left mixed: blocks whose common part is unique are settled
   (nothing repeated), blocks that agree on all they cover too (all repeated);
3. single starts, only in blocks that step 2 left mixed.

Bucket identifiers are 64-bit hashes of the bytes; a string counts as repeated if two independent ones agree,
128 bits in all. One copy of a settled bucket stands for all in later steps, so thousands of copies cost one
row there; counting goes over partial sums, never over all rows of a bucket in one task.

Defined cases: null text is empty; texts under ``length`` bytes have nothing removed; matches never cross documents;
a repeated document row counts as one document, and gets its result once per row; an empty table gives an empty
result; other columns are ignored. The kept bytes need not be valid UTF-8, so they are binary.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import frugal, keyed, staged, text_blocks

U = np.uint64
GRAM, STEP = 24, 32
#: Bytes of text that a task joins to one run; the tables of powers for two of these take 17 MB.
BLOCK = 1 << 17
BROADCAST_DOCS = 1_000_000


#: Tables of powers of this process, by function and size. A plain dictionary, which travels (empty) with the functions that use it.
_TABLES: dict = {}


def _powers(which: int, size: int):
    """A random value per byte, the powers of an odd base, and those of its inverse; modulo 2^64."""
    if (which, size) in _TABLES:
        return _TABLES[which, size]
    if len(_TABLES) >= 4:
        _TABLES.clear()
    rng = np.random.default_rng(20_240_101 + which)
    values = rng.integers(0, 1 << 63, 256, dtype=U) * U(2) + rng.integers(0, 2, 256, dtype=U)
    base = int(rng.integers(0, 1 << 62)) * 4 + 3
    row = lambda b: np.multiply.accumulate(np.concatenate((np.ones(1, U), np.full(size, b, U))))
    _TABLES[which, size] = values, row(base), row(pow(base, -1, 1 << 64))
    return _TABLES[which, size]


class Rolling:
    """Hashes of any stretch of a run of bytes, by two independent functions."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(16, int(len(data)).bit_length())
        self.sums, self.back = [], []
        for which in (0, 1):
            values, power, back = _powers(which, size)
            self.sums.append(np.concatenate((np.zeros(1, U), np.cumsum(values[data] * power[: len(data)], dtype=U))))
            self.back.append(back)

    def __call__(self, which: int, start, end) -> np.ndarray:
        x = (self.sums[which][end] - self.sums[which][start]) * self.back[which][start]
        x ^= x >> U(29)
        x *= U(0xBF58476D1CE4E5B9)
        return x ^ (x >> U(32))


def window_of(length: int) -> int:
    """Starts per window; what their strings have in common is length - window + 1 bytes."""
    return max(1, min(320, length - GRAM + 1, length * 4 // 5))


def anchors_of(data: np.ndarray, valid: np.ndarray, length: int):
    """(a, s, e, bucket, context): for each chosen place its run of starts s..e and the hashes of both."""
    w = window_of(length)
    gram = min(GRAM, length - w + 1)
    h = Rolling(data)
    n = len(data) - gram + 1
    at = np.arange(n)
    v = (h(0, at, at + gram) & ~U(0xFFFFFFFF)) | at.astype(U)
    padded = np.full(-(-n // w) * w + w, ~U(0))
    padded[:n] = v
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    p = np.flatnonzero(valid)
    a = (np.minimum(behind[p], ahead[p + w - 1]) & U(0xFFFFFFFF)).astype(np.int64)
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1)))
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(p)])) - 1
    a, s, e = a[first], p[first], p[last]
    return a, s, e, h(0, a, a + length - w + 1), h(1, s, e + length)


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """(doc_id, text_key, a, s, e, bucket, context) of every chosen place of ``docs`` (doc_id, text_key, raw)."""
    names = ["doc_id", "text_key", "a", "s", "e", "bucket", "context"]
    schema = T.StructType([docs.schema["doc_id"], *[T.StructField(x, T.LongType() if x in ("text_key", "bucket", "context") else T.IntegerType()) for x in names[1:]]])

    def run(batches):
        for b in batches:
            held, size = [], 0

            def done():
                data = np.frombuffer(b"".join(x for _, _, x in held), np.uint8)
                starts = np.cumsum([0] + [len(x) for _, _, x in held])
                valid = np.zeros(len(data), np.int8)
                for x, y in zip(starts[:-1], starts[1:]):
                    valid[x : y - length + 1] = 1
                a, s, e, bucket, context = anchors_of(data, valid, length)
                piece = np.searchsorted(starts, s, "right") - 1
                shift = np.array([c for _, c, _ in held])[piece] - starts[piece]
                row = pa.array(np.array([r for r, _, _ in held])[piece])
                return pa.RecordBatch.from_arrays([b.column(0).take(row), b.column(1).take(row), *[pa.array((x + shift).astype(np.int32)) for x in (a, s, e)], pa.array(bucket.view(np.int64)), pa.array(context.view(np.int64))], names)

            for r, x in enumerate(b.column(2)):
                text = memoryview(x.as_buffer())
                for c in range(0, len(text) - length + 1, BLOCK):  # starts c to c + BLOCK; strings overlap into the next piece
                    piece = text[c : c + BLOCK + length - 1]
                    held.append((r, c, piece))
                    size += len(piece)
                    if size >= BLOCK:
                        yield done()
                        held, size = [], 0
            if held:
                yield done()

    return docs.select("doc_id", "text_key", "raw").mapInArrow(frugal(run), schema)


def _pieces(batch):
    """The run of bytes of a batch's slices, and where each begins; columns s, piece."""
    column = batch.column("piece")
    offsets = np.concatenate(([0], np.cumsum(pc.binary_length(column).to_numpy(zero_copy_only=False)))).astype(np.int64)
    data = np.frombuffer(b"".join(x.as_buffer() for x in column), np.uint8)
    return data, offsets[:-1]


def _numbers(batch, *names):
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in names]


def blocks(slices: DataFrame, length: int) -> DataFrame:
    """Step 2: each slice's starts in blocks of STEP by their distance to the chosen place, with the hashes of what a block's strings share and cover."""
    names = ["doc_id", "text_key", "a", "s", "bucket", "k", "lo", "hi", "core", "cover"]
    schema = T.StructType([slices.schema["doc_id"], *[T.StructField(x, T.IntegerType() if x in ("a", "s", "k", "lo", "hi") else T.LongType()) for x in names[1:]]])

    def run(batches):
        for b in (part for batch in batches for part in text_blocks(batch, "piece", BLOCK)):
            data, base = _pieces(b)
            h = Rolling(data)
            a, s, e = _numbers(b, "a", "s", "e")
            first, last = (a - e) // STEP, (a - s) // STEP
            n = last - first + 1
            row = np.repeat(np.arange(b.num_rows), n)
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[row]
            lo, hi = np.maximum(k * STEP, (a - e)[row]), np.minimum(k * STEP + STEP - 1, (a - s)[row])
            zero = base[row] + (a - s)[row]  # the chosen place in the run of bytes
            # What all starts of the full block share; inside the slice, since a start of the block is.
            core = h(1, zero - k * STEP, zero - k * STEP - STEP + 1 + length)
            cover = h(1, zero - hi, zero - lo + length)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([*[b.column(x).take(take) for x in ("doc_id", "text_key", "a", "s", "bucket")], *[pa.array(x.astype(np.int32)) for x in (k, lo, hi)], pa.array(core.view(np.int64)), pa.array(cover.view(np.int64))], names)

    return slices.select("doc_id", "text_key", "a", "s", "e", "bucket", "piece").mapInArrow(frugal(run), schema)


def starts(slices: DataFrame, length: int) -> DataFrame:
    """Step 3: each start lo..hi of the slices' blocks with the hash of its string."""
    names = ["doc_id", "text_key", "p", "bucket", "d", "string"]
    schema = T.StructType([slices.schema["doc_id"], *[T.StructField(x, T.IntegerType() if x in ("p", "d") else T.LongType()) for x in names[1:]]])

    def run(batches):
        for b in (part for batch in batches for part in text_blocks(batch, "piece", BLOCK)):
            data, base = _pieces(b)
            h = Rolling(data)
            a, s, lo, hi = _numbers(b, "a", "s", "lo", "hi")
            n = hi - lo + 1
            row = np.repeat(np.arange(b.num_rows), n)
            d = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + lo[row]
            at = base[row] + (a - s)[row] - d
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("text_key").take(take), pa.array((a[row] - d).astype(np.int32)), b.column("bucket").take(take), pa.array(d.astype(np.int32)), pa.array(h(1, at, at + length).view(np.int64))], names)

    return slices.select("doc_id", "text_key", "a", "s", "bucket", "lo", "hi", "piece").mapInArrow(frugal(run), schema)


DOC = ["doc_id", "text_key"]


def _several(*member: str):
    """Whether a group has two places or more; rows that repeat a document repeat its places and do not count."""
    place = F.xxhash64(*member)
    return (F.min(place) != F.max(place)).alias("several")


def repeated_spans(docs: DataFrame, length: int = 400, broadcast_docs: int = BROADCAST_DOCS) -> DataFrame:
    """(doc_id, text_key, start, end): spans, not merged, that cover exactly the bytes of repeated strings.

    ``docs`` is (doc_id, text_key, raw), a document known by both keys; neither is null.
    """
    found = staged(anchors(docs, length), "anchors")
    # As a table of its own, so that Spark can split the rows of a hot bucket in the join.
    shared = staged(found.groupBy("bucket").agg(_several(*DOC, "a")).filter("several").select("bucket"), "shared")
    found = staged(found.join(shared, "bucket", "left_semi"), "repeated")
    same = ["bucket", "before", "after", "context"]
    found = found.withColumn("before", F.col("a") - F.col("s")).withColumn("after", F.col("a") - F.col("e"))
    one = F.min(F.struct("doc_id", "text_key", "a")).alias("one")
    contexts = staged(found.groupBy(*same).agg(_several(*DOC, "a"), one), "contexts")
    whole = found.join(contexts.filter("several").select(*same), same, "left_semi").select(*DOC, F.col("s").alias("start"), (F.col("e") + length).alias("end"))

    mixed = contexts.groupBy("bucket").agg(F.count("*").alias("m"), F.bool_and("several").alias("settled")).filter("m > 1 and not settled").select("bucket")
    open_ = contexts.join(mixed, "bucket", "left_semi").select("bucket", "one.*", (F.col("one.a") - F.col("before")).alias("s"), (F.col("one.a") - F.col("after")).alias("e"))
    per_doc = open_.groupBy(*DOC).agg(F.collect_list(F.struct("bucket", "a", "s", "e")).alias("places"))
    per_doc = staged(per_doc, "places")
    if per_doc.count() <= broadcast_docs:  # only the ids and places of documents that take part, a bounded count of them
        touched = docs.join(F.broadcast(per_doc.select(*DOC)), DOC, "left_semi")
    else:
        touched = docs
    cut = touched.join(per_doc, DOC).select(*DOC, "raw", F.explode("places").alias("x"))
    cut = cut.select(*DOC, "x.*", F.expr(f"substring(raw, x.s + 1, x.e - x.s + {length})").alias("piece"))
    cut = staged(cut, "slices")

    parts = staged(blocks(cut, length), "blocks")
    shared = parts.groupBy("bucket", "k", "core").agg(_several(*DOC, "a", "s")).filter("several").drop("several")
    parts = parts.join(shared, ["bucket", "k", "core"], "left_semi")
    same = ["bucket", "k", "core", "lo", "hi", "cover"]
    covers = staged(parts.groupBy(*same).agg(_several(*DOC, "a", "s"), F.min(F.struct("doc_id", "text_key", "a", "s")).alias("one")), "covers")
    some = parts.join(covers.filter("several").select(*same), same, "left_semi").select(*DOC, (F.col("a") - F.col("hi")).alias("start"), (F.col("a") - F.col("lo") + length).alias("end"))

    mixed = covers.groupBy("bucket", "k", "core").agg(F.count("*").alias("m"), F.bool_and("several").alias("settled")).filter("m > 1 and not settled").drop("m", "settled")
    last = covers.join(mixed, ["bucket", "k", "core"], "left_semi").select("bucket", "lo", "hi", F.col("one.doc_id").alias("i"), F.col("one.text_key").alias("t"), F.col("one.a").alias("o"), F.col("one.s").alias("f"))
    last = last.join(cut, (last["i"] == cut["doc_id"]) & (last["t"] == cut["text_key"]) & (last["o"] == cut["a"]) & (last["f"] == cut["s"]) & (last["bucket"] == cut["bucket"])).select(*DOC, "a", "s", cut["bucket"], "lo", "hi", "piece")
    single = staged(starts(last, length), "starts")
    again = single.groupBy("bucket", "d", "string").agg(_several(*DOC, "p")).filter("several").drop("several")
    few = single.join(again, ["bucket", "d", "string"], "left_semi").select(*DOC, F.col("p").alias("start"), (F.col("p") + length).alias("end"))
    return whole.unionAll(some).unionAll(few)


def _cut(raw, start, end):
    """Sizes and what is left of one text; its spans are merged first."""
    if not len(start):
        return len(raw), 0, 0, raw
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    fresh = np.flatnonzero(np.concatenate(([True], start[1:] > end[:-1])))
    start, end = start[fresh], end[np.append(fresh[1:] - 1, len(end) - 1)]
    left = b"".join(raw[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(raw)]))
    return len(raw), int((end - start).sum()), len(start), left


def _cut_texts(batches):
    """Batches (id, raw, spans) as (doc_id, n_bytes, n_removed, n_spans, kept), about 8 blocks of bytes at a time."""
    for b in (part for batch in batches for part in text_blocks(batch, batch.schema.names[1], 8 * BLOCK)):
        spans = b.column(2)
        flat = spans.flatten()
        start, end = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
        at = np.concatenate(([0], np.cumsum(pc.list_value_length(spans).fill_null(0).to_numpy(zero_copy_only=False))))
        found = [_cut(memoryview(r.as_buffer()), start[x:y], end[x:y]) for r, x, y in zip(b.column(1), at[:-1], at[1:])]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
        columns = [pa.array([f[k] for f in found], t) for k, t in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b.column(0), *columns], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def suffix_dedup(docs: DataFrame, length: int = 400, broadcast_docs: int = BROADCAST_DOCS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept (binary)."""
    # Two hashes of id and text make a document's key: never null, so joins and groups on it share one shuffle.
    d = keyed(docs, id_col, text_col).select(F.col("doc_id").alias("id"), F.xxhash64("doc_id", "text").alias("doc_id"), F.xxhash64(F.lit(7), "text", "doc_id").alias("text_key"), F.encode("text", "utf-8").alias("raw"))
    spans = repeated_spans(d.drop("id"), length, broadcast_docs).groupBy(*DOC).agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    rows = d.join(spans, DOC, "left").select("id", "raw", "spans")
    schema = T.StructType([T.StructField("doc_id", d.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("n_spans", T.LongType()), T.StructField("kept", T.BinaryType())])
    return rows.mapInArrow(frugal(_cut_texts), schema)
