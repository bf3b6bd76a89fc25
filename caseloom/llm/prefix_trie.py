"""Prefix trie of conversations that share heads, by composable fingerprints.

A conversation c is rebuilt from the first h turns of a base conversation and its own turns after its first h. The texts are never
put together: the fingerprint of a sequence of turns is its product in a monoid, here t1*B^(n-1) + ... + tn modulo 2**127 - 1
with t the 127-bit digest of a turn's role and text. With P the products of the prefixes of an original conversation, m the
turns that the base gives, and d = m + i - h, the first d rebuilt turns have the product

    P_c[i] + (P_base[m] - P_c[h]) * B^(i - h)

so a row of an original turn needs two numbers of its conversation, and no text. Prefixes with equal depth and product are one node.
Nodes are then verified: all members have the same parent, and where they refer to different stored turns, the role and text of those turns
are compared in full, so that equality follows from the root down. A collision stops the job (another ``seed`` gives other digests).

Products of the prefixes come from a scan that does not need a conversation in one task: turns are sorted by range, each part has
its local products, and the products of earlier parts are put before them. At most two conversations of a part reach beyond it, so that table is
bounded by the count of parts, and is broadcast.

Sums over subtrees are sums over members. Each childless node counts for its smallest member, and so does what each node saves; a
node's members are then all that its subtree has, but for what its ancestors save on account of the same smallest member,
which is a running sum along that conversation. Rows in all: 9 for each conversation and one for each turn.

Defined cases: null role or text is empty; null turns come first, equal ones go by role and text; rows without conv_id belong to no
conversation; repeated rows are turns each; a base that does not exist gives no turns; a conversation without rebuilt turns is a
member of the root only; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import staged

PRIME = (1 << 127) - 1
BASE = 0x2D51_8A3F_77C1_9E0B_6F24_D9A5_13B7_E86D
ROOT = bytes(16)
#: Bits of the depths of a chunk of running sums, and of the member ids of a chunk of digests.
DEPTH_BITS, ID_BITS = 12, 16


def _packed(x: int) -> bytes:
    return x.to_bytes(16, "big")


def turn_digest(role: bytes, text: bytes, seed: bytes = b"") -> int:
    """A number from 1 on, below the modulus."""
    h = hashlib.blake2b(len(role).to_bytes(8, "big"), digest_size=16, key=seed)
    h.update(role)
    h.update(text)
    return int.from_bytes(h.digest(), "big") % (PRIME - 1) + 1


def _turns(rows: DataFrame, cols: tuple[str, str, str, str], seed: bytes) -> DataFrame:
    """(conv_id, part, at, turn_fp, local, role, text): turns in the order of their conversation, with the product of those of the part so far."""
    conv, turn, role, text = (F.col(f"`{c}`") for c in cols)
    d = rows.select(conv.cast("long").alias("conv_id"), turn.alias("turn"), F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text")).filter("conv_id is not null")
    # Equal rows are interchangeable; their numbers only let them be dealt to several parts.
    order = ["conv_id", F.asc_nulls_first("turn"), "role", "text", "row"]
    d = d.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches):
        part, conv, at, product = TaskContext.get().partitionId(), None, 0, 0
        for b in batches:
            turns, local, ats = [], [], []
            for c, r, t in zip(b.column("conv_id").to_pylist(), b.column("role").cast(pa.binary()).to_pylist(), b.column("text").cast(pa.binary()).to_pylist(), strict=True):
                if c != conv:
                    conv, at, product = c, 0, 0
                x = turn_digest(r, t, seed)
                at, product = at + 1, (product * BASE + x) % PRIME
                turns.append(_packed(x))
                local.append(_packed(product))
                ats.append(at)
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([part] * b.num_rows, pa.int32()), pa.array(ats, pa.int64()), pa.array(turns, pa.binary()), pa.array(local, pa.binary()), b.column("role"), b.column("text")], names)

    names = ["conv_id", "part", "at", "turn_fp", "local", "role", "text"]
    return staged(d.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, part int, at long, turn_fp binary, local binary, role string, text string"), "turns")


def _offsets(turns: DataFrame) -> DataFrame:
    """(conv_id, part, before, head): for the later parts of conversations that reach over several, the count and product of the turns before."""
    parts = turns.groupBy("conv_id", "part").agg(F.max("at").alias("n"), F.max_by("local", "at").alias("product"))
    ends = turns.groupBy("part").agg(F.min("conv_id").alias("lo"), F.max("conv_id").alias("hi"))
    ends = ends.select("part", F.explode(F.array("lo", "hi")).alias("conv_id")).distinct()
    # Only the first and last conversation of a part can reach beyond it.
    over = parts.join(ends, ["part", "conv_id"]).withColumn("parts", F.count("*").over(Window.partitionBy("conv_id"))).filter("parts > 1").drop("parts")

    def scan(table: pa.Table) -> pa.Table:
        rows = sorted(table.select(["part", "n", "product"]).to_pylist(), key=lambda r: r["part"])
        n, product, out = 0, 0, []
        for r in rows:
            out.append((r["part"], n, _packed(product)))
            n, product = n + r["n"], (product * pow(BASE, r["n"], PRIME) + int.from_bytes(r["product"], "big")) % PRIME
        conv = table.column("conv_id")[0].as_py()
        return pa.table({"conv_id": pa.array([conv] * len(out), pa.int64()), "part": pa.array([x[0] for x in out], pa.int32()), "before": pa.array([x[1] for x in out], pa.int64()), "head": pa.array([x[2] for x in out], pa.binary())})

    return staged(over.groupBy("conv_id").applyInArrow(scan, "conv_id long, part int, before long, head binary"), "offsets")


def _prefixes(turns: DataFrame, offsets: DataFrame) -> DataFrame:
    """(conv_id, i, fp, turn_fp, n_bytes): each original turn with its place from 1 and the product of all turns up to it."""
    d = turns.join(F.broadcast(offsets), ["conv_id", "part"], "left")
    d = d.select("conv_id", "at", "turn_fp", "local", F.octet_length("text").cast("long").alias("n_bytes"), F.coalesce("before", F.lit(0)).alias("before"), "head")

    def run(batches):
        for b in batches:
            out = []
            for at, local, head in zip(b.column("at").to_pylist(), b.column("local").to_pylist(), b.column("head").to_pylist(), strict=True):
                out.append(local if head is None else _packed((int.from_bytes(head, "big") * pow(BASE, at, PRIME) + int.from_bytes(local, "big")) % PRIME))
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([x + y for x, y in zip(b.column("at").to_pylist(), b.column("before").to_pylist(), strict=True)], pa.int64()), pa.array(out, pa.binary()), b.column("turn_fp"), b.column("n_bytes")], ["conv_id", "i", "fp", "turn_fp", "n_bytes"])

    return staged(d.mapInArrow(run, "conv_id long, i long, fp binary, turn_fp binary, n_bytes long"), "prefixes")


def _conversations(prefixes: DataFrame, base_of: Column, kept: Column, most: int) -> DataFrame:
    """(conv_id, base, h, n, heads, own): per conversation its own turns' count, the first h prefixes of its base, and its own product at h."""
    h = kept.alias("h")
    convs = prefixes.select("*", h).groupBy("conv_id", "h").agg(F.count("*").alias("n"), F.max(F.when(F.col("i") == F.col("h"), F.col("fp"))).alias("own"))
    heads = prefixes.filter(F.col("i") <= most).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("i", "fp", "n_bytes"))).alias("heads"))  # at most ``most`` each
    heads = heads.select(F.col("conv_id").alias("base"), "heads")
    d = convs.withColumn("base", base_of).join(heads, "base", "left")
    none = F.array().cast("array<struct<i: bigint, fp: binary, n_bytes: bigint>>")
    d = d.withColumn("heads", F.when(F.col("h") > 0, F.slice(F.coalesce("heads", none), 1, F.greatest(F.col("h"), F.lit(1)).cast("int"))).otherwise(none))
    return staged(d.select("conv_id", "base", "h", "n", "heads", "own"), "conversations")


def _rows(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, fp, above, n_bytes, ref_conv, ref_i, ends): each prefix of each rebuilt conversation, with its parent and its last turn's place."""
    m = F.size("heads").cast("long")
    length = m + F.greatest(F.lit(0), F.col("n") - F.col("h"))
    root = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(ROOT).alias("fp"), F.lit(None).cast("binary").alias("above"), F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("long").alias("ref_conv"), F.lit(None).cast("long").alias("ref_i"), (length == 0).alias("ends"))
    head = convs.select("conv_id", "base", "heads", length.alias("length"), F.posexplode("heads").alias("k", "x"))
    head = head.select("conv_id", (F.col("k") + 1).cast("long").alias("depth"), "x.fp", F.when(F.col("k") == 0, F.lit(ROOT)).otherwise(F.get("heads", F.col("k") - 1)["fp"]).alias("above"), "x.n_bytes", F.col("base").alias("ref_conv"), F.col("x.i").alias("ref_i"), (F.col("k") + 1 == F.col("length")).alias("ends"))
    c = convs.filter("n > h").select("conv_id", "h", "n", m.alias("m"), F.get("heads", F.size("heads") - 1)["fp"].alias("head"), "own")
    own = prefixes.join(c, "conv_id").filter(F.col("i") > F.col("h")).select("conv_id", "i", "fp", "turn_fp", "n_bytes", "h", "n", "m", "head", "own")
    inverse = pow(BASE, -1, PRIME)
    number = lambda x: int.from_bytes(x, "big") if x is not None else 0

    def run(batches):
        for b in batches:
            rows = b.to_pylist()
            fp = [(number(r["fp"]) + (number(r["head"]) - number(r["own"])) * pow(BASE, r["i"] - r["h"], PRIME)) % PRIME for r in rows]
            depth = [r["m"] + r["i"] - r["h"] for r in rows]
            above = [ROOT if d == 1 else _packed((x - number(r["turn_fp"])) * inverse % PRIME) for d, x, r in zip(depth, fp, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array(depth, pa.int64()), pa.array(map(_packed, fp), pa.binary()), pa.array(above, pa.binary()), b.column("n_bytes"), b.column("conv_id"), b.column("i"), pa.array([r["i"] == r["n"] for r in rows], pa.bool_())], ["conv_id", "depth", "fp", "above", "n_bytes", "ref_conv", "ref_i", "ends"])

    own = own.mapInArrow(run, "conv_id long, depth long, fp binary, above binary, n_bytes long, ref_conv long, ref_i long, ends boolean")
    return staged(root.unionByName(head).unionByName(own), "rows")


def _verify(rows: DataFrame, nodes: DataFrame, turns: DataFrame, offsets: DataFrame) -> None:
    """Raises if a node's members differ in their parent, or in the role or text of their last turn."""
    several = nodes.filter("first_ref != last_ref").select("depth", "fp")
    refs = rows.join(several, ["depth", "fp"], "left_semi").select("depth", "fp", "ref_conv", "ref_i").distinct()
    texts = turns.join(F.broadcast(offsets), ["conv_id", "part"], "left").select(F.col("conv_id").alias("ref_conv"), (F.col("at") + F.coalesce("before", F.lit(0))).alias("ref_i"), F.struct("role", "text").alias("turn"))
    differ = refs.join(texts, ["ref_conv", "ref_i"]).groupBy("depth", "fp").agg(F.min("turn").alias("a"), F.max("turn").alias("b")).filter("a != b")
    bad = nodes.filter("depth > 0 and first_above != last_above").select("depth", "fp").union(differ.select("depth", "fp")).limit(1).collect()
    if bad:
        raise ArithmeticError(f"two texts have one fingerprint at depth {bad[0]['depth']}; choose another seed")


def _end_digests(rows: DataFrame) -> DataFrame:
    """(depth, fp, ends_sha256) of the nodes where conversations end. Ids are joined by chunks of their range, and the chunks are hashed one after the other."""
    chunk = F.shiftright("conv_id", ID_BITS)
    ids = rows.filter("ends").groupBy("depth", "fp", chunk.alias("chunk")).agg(F.array_join(F.transform(F.sort_array(F.collect_set("conv_id")), lambda x: x.cast("string")), ",").alias("ids"))
    ids = ids.repartition("depth", "fp").sortWithinPartitions("depth", "fp", "chunk")

    def run(batches):
        key, digest = None, None
        for b in batches:
            out = []
            for d, fp, part in zip(b.column("depth").to_pylist(), b.column("fp").to_pylist(), b.column("ids").to_pylist(), strict=True):
                if (d, fp) != key:
                    if key:
                        out.append((*key, digest.hexdigest()))
                    key, digest = (d, fp), hashlib.sha256(part.encode())
                else:
                    digest.update(b"," + part.encode())
            yield _ends(out)
        yield _ends([(*key, digest.hexdigest())] if key else [])

    def _ends(out):
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.string())], ["depth", "fp", "ends_sha256"])

    return ids.select("depth", "fp", "ids").mapInArrow(run, "depth long, fp binary, ends_sha256 string")


def prefix_trie(rows: DataFrame, base_of: Column, kept: Column, most: int = 8, cols: tuple[str, str, str, str] = ("conv_id", "turn", "role", "text"), seed: bytes = b"") -> DataFrame:
    """Per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``base_of`` and ``kept`` are expressions of conv_id: the conversation that gives the head, and how many turns (0 to ``most``) it gives.
    """
    turns = _turns(rows, cols, seed)
    offsets = _offsets(turns)
    prefixes = _prefixes(turns, offsets)
    convs = _conversations(prefixes, base_of, kept, most)
    members = _rows(prefixes, convs)
    ref = F.struct("ref_conv", "ref_i")
    nodes = members.groupBy("depth", "fp").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min("above").alias("first_above"), F.max("above").alias("last_above"), F.min(ref).alias("first_ref"), F.max(ref).alias("last_ref"), F.min("n_bytes").alias("n_bytes"))
    nodes = staged(nodes, "nodes")
    _verify(members, nodes, turns, offsets)
    children = nodes.filter("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("first_above").alias("fp")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, ["depth", "fp"], "left").na.fill(0, ["n_children"]).withColumn("saves", (F.col("n_convs") - 1) * F.col("n_bytes"))
    # What a node saves so far along its smallest member: chunks of depths, then the depths of a chunk.
    chunk = nodes.withColumn("chunk", F.shiftright("depth", DEPTH_BITS))
    before = chunk.groupBy("conv_id", "chunk").agg(F.sum("saves").alias("s"))
    before = before.select("conv_id", "chunk", F.coalesce(F.sum("s").over(Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("earlier"))
    within = F.coalesce(F.sum("saves").over(Window.partitionBy("conv_id", "chunk").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    nodes = staged(chunk.withColumn("within", within).join(before, ["conv_id", "chunk"]).select("depth", "fp", "conv_id", "n_convs", "n_children", F.col("first_above").alias("above"), "saves", (F.col("within") + F.col("earlier")).alias("earlier")), "trie")
    own = nodes.groupBy("conv_id").agg(F.sum("saves").alias("saved"), F.sum((F.col("n_children") == 0).cast("long")).alias("leaves"))
    sums = members.select("conv_id", "depth", "fp").join(own, "conv_id").groupBy("depth", "fp").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("n_leaves"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("fp").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(sums, ["depth", "fp"]).join(_end_digests(members), ["depth", "fp"], "left").join(parents, ["depth", "above"], "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", (F.col("saved") - F.col("earlier")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
