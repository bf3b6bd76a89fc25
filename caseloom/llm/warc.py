"""WARC archives: an index first, archives from the index, sorted byte-range reads.

Each page becomes one gzip member, so a record can be read by its byte range alone. The index is
made before any archive: it has each record's archive, offset, length, URL and digest, from the lengths
of the compressed records. The archives are then written in index order by Spark's own writer, whose
commit survives lost executors; the members are joined with one zero byte, which readers of gzip skip.
Of records with equal payloads the one with the smallest page id is the response, the others revisit it.

Reading takes index rows, sorts their byte ranges by archive and offset, merges ranges that are close
together, reads each merged range once, and cuts the records out of it.

Every row of pages is a record. Rows that repeat a page id, URL and payload differ in their ``copy`` number;
the further copies stand in archives of their own (numbers from ``archives`` on), where they are spread by copy,
so that a row that was delivered very often is no large archive.

Defined cases: null html is an empty payload and a null URL an empty one; rows that repeat a page id and payload,
with one URL or several, are all responses if that id is the payload's smallest, and all revisits if not; rows that
share a page id only are records of their own; a null page id is a page id (the smallest of its payload only if
it has no other); an empty table gives an empty index; other columns are ignored.
"""

from __future__ import annotations

import zlib
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseloom.llm.common import shared_dir, staged

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
PAGES_PER_ARCHIVE, GAP, MAX_RANGE = 8192, 64 << 10, 4 << 20
#: Compressed bytes that a task reads back.
TASK_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_of_hex(h: Column) -> Column:
    """Base32 of 40 hexadecimal digits: 20 bits, four letters, at a time."""
    parts = []
    for i in range(8):
        v = F.conv(F.substring(h, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.lit(BASE32).substr(F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def page_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_digest, payload_bytes)."""
    payload = F.encode(F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")), "utf-8")
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit("")).alias("url"), payload.alias("payload"))
    return p.withColumns({"payload_digest": base32_of_hex(F.sha1("payload")), "payload_bytes": F.octet_length("payload").cast("long")})


def record(page_id, url: str, digest: str, payload: bytes | None, refers_to=None) -> bytes:
    """One record as a gzip member; without a payload it is a revisit."""
    urn = lambda x: "<urn:page>" if x is None else f"<urn:page:{quote(str(x), safe='')}>"
    head = ["WARC/1.1", "WARC-Type: " + ("revisit" if payload is None else "response"), f"WARC-Target-URI: {url}", f"WARC-Date: {DATE}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Payload-Digest: sha1:{digest}"]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http + (payload or b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    coder = zlib.compressobj(1, zlib.DEFLATED, 31)
    return coder.compress("\r\n".join(h.replace("\r", " ").replace("\n", " ") for h in head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + coder.flush()


def page_of(urn: str | None) -> str | None:
    """The page id that a record names, as text; None for a null id or no name."""
    return unquote(urn[10:-1]) if urn and urn != "<urn:page>" else None


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]


def _packed(rows: DataFrame, length_only: bool) -> DataFrame:
    """Adds each row's compressed response record, or only its length."""
    kept = ["page_id", "url", "payload_digest", "payload_bytes"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept) + (", packed long" if length_only else ", packed binary")

    def run(batches):
        for b in batches:
            members = (record(p, u, d, x) for p, u, d, x in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload_digest", "payload"))))
            last = pa.array([len(m) for m in members], pa.int64()) if length_only else pa.array(members, pa.binary())
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], last], [*kept, "packed"])

    return rows.select(*kept, "payload").mapInArrow(run, schema)


@F.arrow_udf(T.LongType())
def revisit_length(page_id: pa.Array, url: pa.Array, digest: pa.Array, refers_to: pa.Array) -> pa.Array:
    return pa.array([len(record(*x[:3], None, x[3])) for x in zip(*(c.to_pylist() for c in (page_id, url, digest, refers_to)))], pa.int64())


def _count(pages: DataFrame, pages_per_archive: int) -> int:
    return max(1, -(-pages.count() // pages_per_archive))


def build_index(pages: DataFrame, min_bytes: int = 0, pages_per_archive: int = PAGES_PER_ARCHIVE, **cols) -> DataFrame:
    """(page_id, url, payload_digest, payload_bytes, record_type, refers_to, copy, archive, offset, length) of every record."""
    archives = _count(pages, pages_per_archive)
    rows = page_rows(pages, **cols)
    key = ["page_id", "url", "payload_digest", "payload_bytes"]
    found = _packed(rows, True).groupBy(*key).agg(F.max("packed").alias("packed"), F.count("*").alias("n"))
    found = found.select(*key, "packed", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"))
    # The smallest page id of each payload, over partial minima: a payload that a third of all pages share is one row per task.
    first = rows.select("page_id", "payload_digest", "payload_bytes").filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("first_id"))
    found = found.join(first, ["payload_digest", "payload_bytes"], "left")
    again = F.coalesce(F.col("page_id") != F.col("first_id"), F.col("page_id").isNull() & F.col("first_id").isNotNull(), F.lit(False))
    found = found.withColumn("refers_to", F.when(again, F.col("first_id"))).withColumn("record_type", F.when(again, "revisit").otherwise("response"))
    size = revisit_length("page_id", "url", "payload_digest", "refers_to")
    plain, revisits = found.filter("record_type = 'response'"), found.filter("record_type = 'revisit'")
    found = plain.withColumn("length", F.col("packed")).unionByName(revisits.withColumn("length", size))
    spread = F.pmod(F.xxhash64("page_id", "url", "payload_digest", "copy"), F.lit(archives)).cast("int") + archives
    found = found.withColumn("archive", F.when(F.col("copy") == 0, _archive(archives)).otherwise(spread))
    before = Window.partitionBy("archive").orderBy("page_id", "url", "payload_digest", "copy").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.col("length") + 1).over(before), F.lit(0))
    return staged(found.select(*key, "record_type", "refers_to", "copy", "archive", offset.alias("offset"), "length"), "index")


def _archive(archives: int) -> Column:
    return F.pmod(F.xxhash64("page_id", "url", "payload_digest"), F.lit(archives)).cast("int")


def write_archives(pages: DataFrame, index: DataFrame, path: str | None = None, pages_per_archive: int = PAGES_PER_ARCHIVE, **cols) -> DataFrame:
    """Writes the archives that ``index`` describes, below ``path``; returns (archive, file).

    Index rows and compressed pages meet in one shuffle, by archive: sorted by key, an index row comes
    before its page, so a task merges them as they stream by.
    """
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/archives"
    archives = _count(pages, pages_per_archive)
    key = ["page_id", "url", "payload_digest"]
    ours = index.filter(F.col("copy") == 0).select("archive", *key, F.lit(0).alias("kind"), "offset", "refers_to", F.lit(None).cast("binary").alias("packed"), (F.col("record_type") == "revisit").alias("again"))
    theirs = _packed(page_rows(pages, **cols), False).select(_archive(archives).alias("archive"), *key, F.lit(1).alias("kind"), F.lit(None).cast("long").alias("offset"), F.lit(None).cast(index.schema["refers_to"].dataType).alias("refers_to"), "packed", F.lit(False).alias("again"))
    rows = ours.unionAll(theirs).repartitionById(archives, F.col("archive")).sortWithinPartitions("archive", *key, "kind")

    def merge(batches):
        waiting = None  # the index row whose page is still to come
        for b in batches:
            out = []
            for archive, page_id, url, digest, kind, offset, refers_to, packed, again in zip(*(c.to_pylist() for c in b.columns)):
                if kind == 0:
                    waiting = None if again else (archive, page_id, url, digest, offset)
                    if again:
                        out.append((archive, offset, record(page_id, url, digest, None, refers_to)))
                elif waiting and waiting[:4] == (archive, page_id, url, digest):
                    out.append((archive, waiting[4], packed))
                    waiting = None
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["archive", "offset", "packed"])

    _write(rows.mapInArrow(merge, "archive int, offset long, packed binary").sortWithinPartitions("archive", "offset"), path)
    further = index.filter(F.col("copy") > 0)
    if not further.isEmpty():
        _write(_copies(pages, further, **cols).repartitionById(archives, F.col("archive") - archives).sortWithinPartitions("archive", "offset"), path)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.regexp_extract("path", r"archive=(\d+)/", 1).cast("int").alias("archive"), F.col("path").alias("file"))


def _write(merged: DataFrame, path: str) -> None:
    """Archives of rows (archive, offset, packed), which are in order; each archive comes from one task."""
    merged.select("archive", F.col("packed").cast("string").alias("value")).write.mode("append").partitionBy("archive").option("lineSep", "\0").text(path)


def _copies(pages: DataFrame, further: DataFrame, **cols) -> DataFrame:
    """(archive, offset, packed) of the further copies of repeated rows, by a join of their index rows to one page row each."""
    key = ["page_id", "url", "payload_digest"]
    rows = page_rows(pages, **cols)
    wanted = further.select(*key).distinct()
    same = [rows[c].eqNullSafe(wanted[c]) for c in key]
    one = rows.join(wanted, same, "left_semi").groupBy(*key).agg(F.min("payload").alias("payload"))
    same = [further[c].eqNullSafe(one[c]) for c in key]
    found = further.join(one, same).select("archive", "offset", *[further[c] for c in key], "refers_to", (F.col("record_type") == "revisit").alias("again"), "payload")

    def pack(batches):
        for b in batches:
            archive, offset, *rest = b.columns
            packed = [record(p, u, d, None if again else x, r) for p, u, d, r, again, x in zip(*(c.to_pylist() for c in rest))]
            yield pa.RecordBatch.from_arrays([archive, offset, pa.array(packed, pa.binary())], ["archive", "offset", "packed"])

    return found.mapInArrow(pack, "archive int, offset long, packed binary")


def read_records(selected: DataFrame, files: DataFrame, gap: int = GAP, max_range: int = MAX_RANGE, tasks: int | None = None) -> DataFrame:
    """(archive, offset, record_type, page, digest, refers_to, payload) of the selected index rows, all from the archives, by merged byte ranges.

    ``tasks`` is how many tasks read; if it is not given, one for TASK_BYTES of the selected records, and the session's
    shuffle partitions at least, since ranges are a few bytes before they are read and megabytes after.
    """
    if not tasks:
        size = selected.agg(F.sum("length")).first()[0] or 0
        tasks = max(-(-size // TASK_BYTES), int(selected.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = selected.select("archive", "offset", "length").join(files, "archive")
    order = Window.partitionBy("archive").orderBy("offset")
    apart = F.col("offset") - F.lag(F.col("offset") + F.col("length")).over(order) > gap
    rows = rows.withColumn("piece", (F.col("offset") / max_range).cast("long"))
    fresh = F.coalesce(apart | (F.col("piece") != F.lag("piece").over(order)), F.lit(True))
    rows = rows.withColumn("range", F.sum(fresh.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    ranges = rows.groupBy("archive", "file", "range").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("cuts"))

    def run(batches):
        from pyarrow import fs

        for b in batches:
            for archive, file, cuts in zip(*(b.column(c).to_pylist() for c in ("archive", "file", "cuts"))):
                at = urlparse(file)
                where, name = (fs.LocalFileSystem(), unquote(at.path)) if at.scheme in ("", "file") else fs.FileSystem.from_uri(file)
                start, end = cuts[0]["offset"], max(c["offset"] + c["length"] for c in cuts)
                with where.open_input_file(name) as f:
                    block = f.read_at(end - start, start)
                out = []
                for c in cuts:
                    fields, payload = parse(block[c["offset"] - start : c["offset"] - start + c["length"]])
                    out.append((archive, c["offset"], fields["WARC-Type"], page_of(fields["WARC-Record-ID"]), fields["WARC-Payload-Digest"][5:], page_of(fields.get("WARC-Refers-To")), payload))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()))], ["archive", "offset", "record_type", "page", "digest", "refers_to", "payload"])

    return ranges.repartition(max(1, tasks), "archive", "range").mapInArrow(run, "archive int, offset long, record_type string, page string, digest string, refers_to string, payload binary")


def round_trip(pages: DataFrame, min_bytes: int = 0, **cols) -> DataFrame:
    """Writes the pages as archives and reads every record back: per record page_id, payload_bytes, payload_digest, record_type, refers_to.

    All that is returned of a record comes from the archive; a revisit has its payload's size from the response it refers to.
    """
    index = build_index(pages, min_bytes, **cols)
    files = write_archives(pages, index, **cols)
    kind = index.schema["page_id"].dataType
    back = read_records(index, files).select(F.col("page").cast(kind).alias("page_id"), F.col("refers_to").cast(kind).alias("refers_to"), "record_type", "digest", F.octet_length("payload").cast("long").alias("got_bytes"), base32_of_hex(F.sha1("payload")).alias("got_digest"))
    back = staged(back, "records")
    whole = back.filter("record_type = 'response'")
    again = back.filter("record_type = 'revisit'").select("page_id", "refers_to", "record_type", "digest")
    target = whole.groupBy(F.col("page_id").alias("target"), F.col("got_digest").alias("digest")).agg(F.max("got_bytes").alias("got_bytes")).withColumnRenamed("digest", "target_digest")
    again = again.join(target, (F.col("refers_to") == F.col("target")) & (F.col("digest") == F.col("target_digest")), "left")
    return whole.select("page_id", F.col("got_bytes").alias("payload_bytes"), F.col("got_digest").alias("payload_digest"), "record_type", "refers_to").unionAll(
        again.select("page_id", "got_bytes", "digest", "record_type", "refers_to")
    )
