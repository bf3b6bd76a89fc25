"""What the text operators share: row keys, byte-exact text helpers, staged tables."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The six white-space characters that split words, as a regular-expression class.
SPACE = r"[\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"
#: Everything that is not part of a word of letters, digits or non-ASCII characters.
NON_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", raw: bool = False) -> DataFrame:
    """(doc_id, text, text_key): the columns the operators work on, whatever else ``docs`` has.

    A document is known by its id and a hash of its text, so that rows that repeat an id with
    another text stay apart, and rows that repeat both count as one document. Null text becomes
    the empty string, unless ``raw``.
    """
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), (text if raw else F.coalesce(text, F.lit(""))).alias("text"), F.xxhash64(text).alias("text_key"))


def fresh_names(df: DataFrame, *names: str) -> list[str]:
    """``names``, each with as many underscores before it as make it none of the columns of ``df`` (by letters of any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def same_document(a: DataFrame, b: DataFrame) -> Column:
    """Null-safe equality of the document key."""
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["text_key"] == b["text_key"])


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only: lower() is that for pure ASCII, other texts go through translate()."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def spaced_words(c: Column) -> Column:
    """Words between ASCII white space."""
    return F.filter(F.split(c, SPACE + "+", -1), lambda w: w != "")


def plain_words(c: Column) -> Column:
    """Words of a-z, 0-9 and non-ASCII characters, of text that is already lower-cased."""
    return F.filter(F.split(c, NON_WORD, -1), lambda w: w != "")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one the cluster names in spark.checkpoint.dir. Unset, that is an error on a cluster; on one machine a temporary one."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or getattr(spark, "_caseloom_shared", None)
    if not top:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = spark._caseloom_shared = "file://" + tempfile.mkdtemp(prefix="caseloom-")
    path = f"{top.rstrip('/')}/{uuid.uuid4().hex}"
    made(spark).append(path)
    return path


def made(spark: SparkSession) -> list[str]:
    """The folders that this session has made below the shared one and not discarded."""
    if not hasattr(spark, "_caseloom_made"):
        spark._caseloom_made = []
    return spark._caseloom_made


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders of ``made``. What still reads them must have been written before."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        made(spark).remove(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: cuts the lineage, survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def frugal(run):
    """``run``, a function of batches; what it has freed goes back to the machine when it ends, since its worker waits for the next task holding it."""

    def whole(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return whole


def text_blocks(batch: pa.RecordBatch, column: str, size: int):
    """Slices of an Arrow batch with about ``size`` bytes of text each, so that a task's memory does not follow its batches."""
    total = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < batch.num_rows:
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + size, "right")))
        yield batch.slice(start, end - start)
        start = end
