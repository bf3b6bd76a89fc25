"""Counts of word pairs for the quality classifier, and the sharded count join that scores documents with them.

Pairs are sent as blocks: a block of documents names each of its distinct pairs once, with the documents that have it,
and each part of the pairs returns one sum per document. The most frequent words of the trusted text have short ids (a table of at
most 65,535 words, broadcast), so that a pair of two of them is 32 bits, sorted and sent as differences. Another pair is the 48-bit
key of a rare word, sorted and sent as differences too, and a 32-bit code of the word beside it, which also says if that word stands
before; so the pairs on both sides of a rare word name it once. A word that the trusted text has not is
taken for one of its n words with a chance of n / 2**47: one in 140,000 for a thousand million words. What a frequent word's
spelling is worth is in the broadcast table and is not sent.

A pair of frequent words goes to its part by both, so a word that a third of all places follow is spread
over all parts; what all its pairs have in common, its count and discounted mass, is in the broadcast table. Other pairs go by their
rare word, the first if both are. All counts, sums and joins are Spark's; a part holds about PART_BYTES of text, and parts are doubled as the
text grows. A part is a range of scrambled keys, so its keys lie as close together whether there are few parts or many, and cost as many bytes;
a block sends a row to a part only if it has a pair of it, so there are never more rows than pairs. The documents' own rows are one group for each block. The most frequent pairs of frequent words, at most
HOT_PAIRS of them, are in a broadcast table too, so a block adds their gains itself and sends only the others.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import frugal, text_blocks
from caseloom.llm.kn_words import BEGIN, MIXER, word_keys

U = np.uint64
#: Ids of frequent words are below RARE; the last of them is the begin of a text. Codes from RARE to HASHED are ids of frequent words
#: that stand before the rare word of a pair, those from HASHED on are hashes.
RARE, HASHED = 1 << 16, 2 << 16
BEGIN_ID = RARE - 1
#: Bytes and documents of a block, bytes and places in a block of a word that can be frequent, bits of the parts at least, bytes of text of a part.
PAIR_BLOCK, BLOCK_DOCS, WORD_BYTES, WORD_PLACES, PART_BITS, PART_BYTES = 3 << 20, 1 << 12, 64, 4, 4, 128 << 20
#: Bytes of a block when there are many parts; pairs of frequent words in the broadcast table at most, and the count from which all are alike for that.
BLOCK_BYTES, HOT_PAIRS, MANY = 4 << 20, 1 << 21, 1 << 16
DEALT = "part long, block long, payload binary"
#: Odd numbers that scramble 32 bits, and their inverses.
SCRAMBLE = (0x9E3779B1, 0x85EBCA77)
UNSCRAMBLE = tuple(pow(x, -1, 1 << 32) for x in SCRAMBLE)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * MIXER
    x = (x ^ (x >> U(29))) * MIXER
    return x ^ (x >> U(32))


def scrambled(x: np.ndarray) -> np.ndarray:
    """A permutation of 32-bit numbers."""
    x = x.astype(np.uint32) * np.uint32(SCRAMBLE[0])
    return (x ^ (x >> np.uint32(16))) * np.uint32(SCRAMBLE[1])


def unscrambled(x: np.ndarray) -> np.ndarray:
    x = x * np.uint32(UNSCRAMBLE[1])
    return (x ^ (x >> np.uint32(16))) * np.uint32(UNSCRAMBLE[0])


def discounts_of(n: list[float]) -> list[float]:
    """D1, D2 and D3+ from counts of counts."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
    return [min(float(i), max(0.1, i - (i + 1) * y * n[i] / n[i - 1])) if n[i - 1] else 0.5 for i in (1, 2, 3)]


def part_bits(docs: DataFrame) -> int:
    """Parts are doubled with the text, so that one fits in memory at any size."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(PART_BITS, math.ceil(math.log2(max(1, size / PART_BYTES))))


# --- arrays as bytes ----------------------------------------------------------------------------

def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each byte of their values on its own: as one byte if it never changes, else compressed if that is shorter."""
    import zstandard

    coder, out = zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False), [np.array([len(a) for a in arrays], np.uint32).tobytes()]
    for a in arrays:
        rows = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize)
        for k in range(a.dtype.itemsize if len(a) else 0):
            plane = rows[:, k]
            if (plane == plane[0]).all():
                out += [b"\0", plane[:1].tobytes()]
                continue
            x = coder.compress(plane.tobytes())
            out += [b"\2", np.uint32(len(x)).tobytes(), x] if len(x) + 4 < len(a) else [b"\1", plane.tobytes()]
    return b"".join(out)


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    import zstandard

    coder, out, view = zstandard.ZstdDecompressor(), [], memoryview(data)
    sizes, at = np.frombuffer(view, np.uint32, len(kinds)), 4 * len(kinds)
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        width = np.dtype(kind).itemsize
        rows = np.empty((n, width), np.uint8)
        for k in range(width if n else 0):
            how, at = view[at], at + 1
            if how == 2:
                m = int(np.frombuffer(view, np.uint32, 1, at)[0])
                rows[:, k] = np.frombuffer(coder.decompress(view[at + 4 : at + 4 + m], max_output_size=n), np.uint8)
                at += 4 + m
            else:
                m = n if how else 1
                rows[:, k] = np.frombuffer(view, np.uint8, m, at)
                at += m
        out.append(rows.view(kind).ravel())
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """A sorted array as its differences; summed up again by np.cumsum."""
    return np.diff(x, prepend=x.dtype.type(0))


def runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where rows in order differ from the one before, and how many follow alike."""
    if not len(keys[0]):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate(([True], np.any([k[1:] != k[:-1] for k in keys], 0))))
    return first, np.diff(np.append(first, len(keys[0])))


def batch_of(rows) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["part", "block", "payload"])


# --- words --------------------------------------------------------------------------------------

def frequent_words(texts: DataFrame, most: int = RARE - 1, least: int = WORD_PLACES) -> list[str]:
    """Frequent words of all of ``texts`` (column text), by falling count: a coding table of bounded size.

    A block names only words that it has ``least`` times; which words have short ids changes no score.
    """

    def run(batches):
        for b in (part for batch in batches for part in text_blocks(batch, "text", PAIR_BLOCK)):
            words = pc.ascii_split_whitespace(b.column(0).cast(pa.string())).flatten()
            found = words.value_counts()
            word, n = found.field(0), found.field(1)
            size = pc.binary_length(word)
            fit = pc.and_(pc.and_(pc.greater(size, 0), pc.less_equal(size, WORD_BYTES)), pc.greater_equal(n, least))
            yield pa.RecordBatch.from_arrays([word.filter(fit), n.filter(fit)], ["word", "n"])

    counts = texts.select("text").mapInArrow(frugal(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).select("word").collect()]


class Frequent:
    """Ids, spelling and, once they are known, counts of the frequent words; broadcast."""

    def __init__(self, spark, words: list[str], keys: np.ndarray, q: np.ndarray):
        order = np.argsort(keys)
        spell = np.zeros(RARE, np.float32)
        spell[: len(words)] = q
        self.sent = spark.sparkContext.broadcast((keys[order], order.astype(np.uint32), spell))

    def codes(self, keys: np.ndarray) -> np.ndarray:
        """The id of each frequent word's key, and a 32-bit hash from HASHED on of others."""
        known, ids, _ = self.sent.value
        other = (mixed(keys) >> U(32)) % U((1 << 32) - HASHED) + U(HASHED)
        if not len(known):
            return other.astype(np.uint32)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, ids[at].astype(U), other).astype(np.uint32)

    @property
    def spelling(self) -> np.ndarray:
        return self.sent.value[2]


def places_of(texts: pa.Array, spelling):
    """(n, base, v, w, doc, q): characters and summed spelling of each text; then of each place its pair, its text and its word's
    spelling, which is left to the table for frequent words.

    A pair is (id of the first word, id of the second) if both are frequent, (key of the second, RARE + id of the first) if only the
    first is, and (key of the first, code of the second) if the first is not."""
    split = pc.ascii_split_whitespace(texts.cast(pa.string()))
    coded = split.flatten().dictionary_encode()
    doc = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(split.offsets.to_numpy(zero_copy_only=False)))
    real = pc.not_equal(split.flatten(), "").to_numpy(zero_copy_only=False).astype(bool)  # white space at an end leaves an empty word
    at, doc = coded.indices.to_numpy(zero_copy_only=False)[real], doc[real]
    if not len(at):
        none = np.zeros(0)
        return np.zeros(len(texts), np.int64), np.zeros(len(texts)), none.astype(U), none.astype(np.uint32), doc, none.astype(np.float32)
    words = pc.if_else(pc.equal(coded.dictionary, ""), BEGIN, coded.dictionary)
    keys, q = word_keys(words), spelling(words)
    code = spelling.frequent.codes(keys)
    first = np.where(code < RARE, code.astype(U), (keys >> U(17)) | (U(1) << U(47)))
    n = np.bincount(doc, (pc.utf8_length(words).to_numpy(zero_copy_only=False) + 1)[at], len(texts)).astype(np.int64)
    v = np.concatenate((np.zeros(1, U), first[at[:-1]]))
    v[np.concatenate(([True], doc[1:] != doc[:-1]))] = U(BEGIN_ID)
    w = code[at]
    turned = (v < RARE) & (w >= RARE)
    v, w = np.where(turned, first[at], v), np.where(turned, v.astype(np.uint32) + np.uint32(RARE), w)
    return n, np.bincount(doc, q[at], len(texts)), v, w, doc, np.where(code < RARE, 0, q)[at].astype(np.float32)


def turned_of(w: np.ndarray) -> np.ndarray:
    """Which pairs with a rare word have a frequent word before it."""
    return (w >= RARE) & (w < HASHED)


def parts_of(v: np.ndarray, bits: int) -> np.ndarray:
    """The parts of pairs with a rare word, by that word; its key has 47 bits besides the mark."""
    return (v & U((1 << 47) - 1)) >> U(47 - bits)


def short_pairs(v: np.ndarray, w: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Pairs of frequent words, scrambled, with their document in one number each, sorted; documents are below BLOCK_DOCS.

    The upper bits of a scrambled pair are its part."""
    return np.sort((scrambled((v << U(16)) | w).astype(U) << U(12)) | doc.astype(U))


def block_bytes(bits: int) -> int:
    return min(BLOCK_BYTES, PAIR_BLOCK << max(0, bits - PART_BITS))


def by_part(part: np.ndarray):
    """(part, slice) of rows in order of part."""
    first, n = runs(part)
    return {int(part[a]): slice(a, a + m) for a, m in zip(first.tolist(), n.tolist())}


EMPTY = slice(0, 0)


def known(sorted_keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(asked), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)] == asked


def found(sorted_keys: np.ndarray, values: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The value of each key that is asked for, 0 where there is none."""
    if not len(sorted_keys):
        return np.zeros(len(asked))
    at = np.minimum(np.searchsorted(sorted_keys, asked), len(sorted_keys) - 1)
    return np.where(sorted_keys[at] == asked, values[at], 0.0)


# --- training -----------------------------------------------------------------------------------

#: A part's counts: pairs of frequent words as differences, their counts; then rare word (differences), word beside it, spelling and count of other pairs.
KINDS = (np.uint32, np.uint32, U, np.uint32, np.float32, np.uint32)


def _summed_short(key: np.ndarray, c: np.ndarray):
    order = np.argsort(key, kind="stable")
    key, c = key[order], c[order]
    first, _ = runs(key)
    return key[first], (np.add.reduceat(c, first) if len(first) else c).astype(np.uint32)


def _summed_long(v, w, q, c):
    order = np.lexsort((w, v))
    v, w, q, c = v[order], w[order], q[order], c[order]
    first, _ = runs(v, w)
    return v[first], w[first], q[first], (np.add.reduceat(c, first) if len(first) else c).astype(np.uint32)


def word_counts(texts: DataFrame, spelling, bits: int = PART_BITS) -> DataFrame:
    """(part, n1 to n4, payload): the counts of all word pairs, summed per block and then per part, with counts of counts."""

    def count(batches):
        for batch in (part for whole in batches for part in text_blocks(whole, "text", block_bytes(bits))):
            _, _, v, w, _, q = places_of(batch.column(0), spelling)
            short = v < RARE
            key = short_pairs(v[short], w[short], np.zeros(int(short.sum()), U)) >> U(12)
            first, n = runs(key)
            key = key[first]
            own = by_part(key >> U(32 - bits))
            order = np.lexsort((w[~short], v[~short]))
            rest = [x[~short][order] for x in (v, v, w, q)]
            rest[0] = parts_of(rest[0], bits)
            at, m = runs(*rest[:3])
            rest = [x[at] for x in rest]
            other = by_part(rest[0])
            rows = []
            for p in sorted({*own, *other}):
                a, b = own.get(p, EMPTY), other.get(p, EMPTY)
                rows.append((p, 0, packed(steps(key[a].astype(np.uint32)), n[a].astype(np.uint32), steps(rest[1][b]), *[x[b] for x in rest[2:]], m[b].astype(np.uint32))))
            if rows:
                yield batch_of(rows)

    def merge(t: pa.Table) -> pa.Table:
        parts = [unpacked(x, *KINDS) for x in t.column("payload").to_pylist()]
        key, c = _summed_short(*[np.concatenate(x) for x in zip(*[(np.cumsum(p[0], dtype=np.uint32), p[1]) for p in parts])])
        v, w, q, m = _summed_long(*[np.concatenate(x) for x in zip(*[(np.cumsum(p[2], dtype=U), *p[3:]) for p in parts])])
        of_counts = [int((c == i).sum() + (m == i).sum()) for i in (1, 2, 3, 4)]
        names = pa.schema([("part", pa.int64()), *[(f"n{i}", pa.int64()) for i in (1, 2, 3, 4)], ("payload", pa.binary())])
        return pa.table([t.column("part").slice(0, 1).combine_chunks(), *[[x] for x in of_counts], [packed(steps(key), c, steps(v), w, q, m)]], names)

    schema = "part long, n1 long, n2 long, n3 long, n4 long, payload binary"
    return texts.select("text").mapInArrow(frugal(count), DEALT).groupBy("part").applyInArrow(merge, schema)


def first_words(counts: DataFrame) -> DataFrame:
    """(v, total, n1, n2, n3): of each frequent first word its count, and how many of its pairs have count 1, 2 and 3 or more."""
    names = ["v", "total", "n1", "n2", "n3"]

    def run(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                key, c, _, w, _, m = unpacked(x, *KINDS)
                key, turned = unscrambled(np.cumsum(key, dtype=np.uint32)), turned_of(w)
                ids = np.concatenate((key >> np.uint32(16), w[turned] - np.uint32(RARE))).astype(np.int64)
                c = np.concatenate((c, m[turned])).astype(np.int64)
                sums = [np.bincount(ids, x, RARE).astype(np.int64) for x in (c, c == 1, c == 2, c >= 3)]
                there = np.flatnonzero(sums[0])
                yield pa.RecordBatch.from_arrays([pa.array(there), *[pa.array(s[there]) for s in sums]], names)

    rows = counts.select("payload").mapInArrow(run, ", ".join(f"{n} long" for n in names))
    return rows.groupBy("v").agg(*[F.sum(n).alias(n) for n in names[1:]])


def hot_pairs(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The scrambled pairs of frequent words with the highest counts, in order of the pair, and their counts: at most ``most``, and all from some count on."""

    def tally(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                n = np.bincount(np.minimum(unpacked(x, *KINDS)[1], MANY))
                there = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(n[there])], ["c", "n"])

    left, least = most, None
    for r in counts.select("payload").mapInArrow(tally, "c long, n long").groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.desc("c")).collect():  # at most MANY rows
        left -= r["n"]
        if left < 0:
            break
        least = r["c"]
    if not least:
        return np.zeros(0, np.uint32), np.zeros(0, np.uint32)

    def pick(batches):
        for b in batches:
            for x in b.column(0).to_pylist():
                key, c = unpacked(x, *KINDS)[:2]
                hot = c >= least
                yield batch_of([(0, 0, packed(steps(np.cumsum(key, dtype=np.uint32)[hot]), c[hot]))])

    rows = [unpacked(r["payload"], np.uint32, np.uint32) for r in counts.select("payload").mapInArrow(pick, DEALT).select("payload").collect()]
    key, c = (np.concatenate(x) for x in zip(*[(np.cumsum(k, dtype=np.uint32), n) for k, n in rows], strict=True))
    order = np.argsort(key)
    return key[order], c[order]


# --- scoring ------------------------------------------------------------------------------------

def score(docs: DataFrame, counts: DataFrame, spelling, bits: int = PART_BITS, most: int = HOT_PAIRS) -> DataFrame:
    """``docs`` (doc_id, text, ...) without the text, with n (characters and word ends) and perplexity.

    log p(w | v) = log weight(v) + log q(w), plus for a known pair the gain over that. A block of documents adds the weights of
    frequent words and the gains of frequent pairs itself, sends its other pairs to their parts and gets a sum per document back from each.
    """
    row = counts.agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in (1, 2, 3, 4)]).first()
    d = np.array([0.0, *discounts_of([float(x or 0) for x in row])])
    total, held = np.zeros(RARE), np.zeros(RARE)
    for r in first_words(counts).collect():  # frequent words only, at most RARE rows
        total[r["v"]], held[r["v"]] = r["total"], d[1] * r["n1"] + d[2] * r["n2"] + d[3] * r["n3"]
    weight = np.where(total > 0, np.log(np.maximum(held, 1e-300) / np.maximum(total, 1)), 0.0)
    known_first = docs.sparkSession.sparkContext.broadcast((total, weight))

    def gains(c, of_total, of_weight, q):
        return np.log1p(np.maximum(c - d[np.minimum(c, 3)], 0) / of_total * np.exp(np.minimum(-of_weight - q, 600.0)))

    def short_gains(key, c, spelled):
        plain = unscrambled(key)
        ids = (plain >> np.uint32(16)).astype(np.int64)
        return gains(c, known_first.value[0][ids], known_first.value[1][ids], spelled[plain & np.uint32(RARE - 1)].astype(np.float64))

    hot, c = hot_pairs(counts, most)
    hot = docs.sparkSession.sparkContext.broadcast((hot, short_gains(hot, c, spelling.frequent.spelling)))
    kept = [f for f in docs.schema.fields if f.name != "text"]
    schema = T.StructType([*kept, T.StructField("n", T.LongType()), T.StructField("logp", T.DoubleType())])

    def blocks(batches):
        for part in (x for whole in batches for x in text_blocks(whole, "text", block_bytes(bits))):
            for k in range(0, part.num_rows, BLOCK_DOCS):
                yield part.slice(k, BLOCK_DOCS)

    def send(batches):
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in blocks(batches):
            n, base, v, w, doc, _ = places_of(batch.column("text"), spelling)
            short, turned = v < RARE, turned_of(w)
            for at, ids in ((short, v[short]), (turned, w[turned] - np.uint32(RARE))):
                base = base + np.bincount(doc[at], known_first.value[1][ids.astype(np.int64)], batch.num_rows)
            places = short_pairs(v[short], w[short], doc[short])
            first, times = runs(places)
            places = places[first]
            pair, many = runs(places >> U(12))
            asked = (places[pair] >> U(12)).astype(np.uint32)
            gain, others = np.repeat(found(*hot.value, asked), many), np.repeat(~known(hot.value[0], asked), many)
            base = base + np.bincount((places & U(BLOCK_DOCS - 1)).astype(np.int64), gain * times, batch.num_rows)
            places, times = places[others], times[others]
            own = by_part(places >> U(44 - bits))
            order = np.lexsort((doc[~short], w[~short], v[~short]))
            rest = [x[~short][order] for x in (v, v, w, doc)]
            rest[0] = parts_of(rest[0], bits)
            at, more = runs(*rest)
            rest = [x[at] for x in rest]
            other = by_part(rest[0])
            head = pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], pa.array(n), pa.array(base)], schema.names)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, head.schema) as out:
                out.write_batch(head)
            # The documents' own row goes by a part of its own, which hands it on.
            rows = [(-1 - block, block, sink.getvalue().to_pybytes())]
            for p in sorted({*own, *other}):
                a, b = places[own.get(p, EMPTY)], other.get(p, EMPTY)
                key = (a >> U(12)).astype(np.uint32)
                pair, docs_of = runs(key)
                v_, w_, doc_ = (x[b] for x in rest[1:])
                long, docs_of_long = runs(v_, w_)
                rare, pairs_of = runs(v_[long])
                doc_a, doc_b = (a & U(BLOCK_DOCS - 1)).astype(np.uint16), doc_.astype(np.uint16)
                rows.append((p, block, packed(steps(key[pair]), docs_of.astype(np.uint16), doc_a, times[own.get(p, EMPTY)].astype(np.uint32), steps(v_[long][rare]), pairs_of.astype(np.uint32), w_[long], docs_of_long.astype(np.uint16), doc_b, more[b].astype(np.uint32))))
            yield batch_of(rows)
            block += 1

    def look_up(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and left.column("part")[0].as_py() < 0:
            return left
        key, c, v, w, q, m = unpacked(right.column("payload")[0].as_py(), *KINDS) if right.num_rows else [np.zeros(0, k) for k in KINDS]
        total, weight = known_first.value
        key, v = np.cumsum(key, dtype=np.uint32), np.cumsum(v, dtype=U)
        turned, known_word = turned_of(w), w < RARE
        q[known_word] = spelling.frequent.spelling[w[known_word]]
        gain = short_gains(key, c, spelling.frequent.spelling)
        # Other pairs: a first word that is not frequent has all its pairs here; the weight of a frequent one has been added where it stands.
        first, n = runs(v)
        firsts, begins = v[first], np.where(turned, 0, m)
        own_total = np.add.reduceat(begins, first).astype(float) if len(first) else np.zeros(0)
        own_held = np.add.reduceat(d[np.minimum(begins, 3)], first) if len(first) else np.zeros(0)
        own_weight = np.where(own_total > 0, np.log(np.maximum(own_held, 1e-300) / np.maximum(own_total, 1)), 0.0)
        before = np.where(turned, w - np.uint32(RARE), 0).astype(np.int64)
        pair_total, pair_weight = (np.where(turned, of[before], np.repeat(own, n)) for of, own in ((total, own_total), (weight, own_weight)))
        long_gain = gains(m, pair_total, pair_weight, q.astype(np.float64))
        spot = mixed(v ^ (w.astype(U) * MIXER))
        by = np.argsort(spot)
        spot, long_gain = spot[by], long_gain[by]

        for block, x in zip(left.column("block").to_pylist(), left.column("payload")):
            k2, n_a, doc_a, times_a, v2, n_v, w2, n_b, doc_b, times_b = unpacked(x.as_py(), np.uint32, np.uint16, np.uint16, np.uint32, U, np.uint32, np.uint32, np.uint16, np.uint16, np.uint32)
            a = np.repeat(found(key, gain, np.cumsum(k2, dtype=np.uint32)), n_a) * times_a
            v2 = np.repeat(np.cumsum(v2, dtype=U), n_v)
            b = np.repeat(np.where(turned_of(w2), 0.0, found(firsts, own_weight, v2)) + found(spot, long_gain, mixed(v2 ^ (w2.astype(U) * MIXER))), n_b) * times_b
            sums = np.bincount(np.concatenate((doc_a, doc_b)).astype(np.int64), np.concatenate((a, b)))
            there = np.flatnonzero(sums)
            if len(there):
                out.append((0, block, packed(steps(there.astype(np.uint16)), sums[there].astype(np.float32))))
        return pa.Table.from_batches([batch_of(out)])

    def add_up(t: pa.Table) -> pa.Table:
        rows = list(zip(t.column("part").to_pylist(), t.column("payload").to_pylist()))
        own = pa.ipc.open_stream(next(x for p, x in rows if p < 0)).read_all()
        logp = own.column("logp").to_numpy().copy()
        for _, x in sorted(r for r in rows if r[0] >= 0):
            doc, value = unpacked(x, np.uint16, np.float32)
            logp[np.cumsum(doc, dtype=np.uint16)] += value
        return own.set_column(len(own.column_names) - 1, "logp", pa.array(logp))

    sent = docs.select(*[f.name for f in kept], "text").mapInArrow(frugal(send), DEALT)
    sums = sent.groupBy("part").cogroup(counts.select("part", "payload").groupBy("part")).applyInArrow(look_up, DEALT)
    summed = sums.groupBy("block").applyInArrow(add_up, schema)
    return summed.select(*[f.name for f in kept], "n", F.when(F.col("n") > 0, F.exp(-F.col("logp") / F.col("n"))).alias("perplexity"))
