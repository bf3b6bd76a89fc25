"""Line dedup: explode normalised lines, hash, count documents per hash, drop, reassemble.

A line's key is the line without surrounding ASCII white space and with A-Z lower-cased, known
by two independent 64-bit hashes. Only hashes and positions are shuffled by line; texts move once,
by document. Counting is per distinct (document, key) with partial sums, so a line that a third
of all documents share is a few rows per task.

Defined cases: null or empty text is one empty line; keys shorter than ``min_chars`` are never
dropped; a repeated document row counts as one document and gets its result once per row; an
empty table gives an empty result; other columns are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import SPACE_CHARS, ascii_lower, fresh_names, keyed, same_document, staged


def _lines(docs: DataFrame, min_chars: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text_key, pos, a, b): the hashed key of each line, null where it is too short."""
    d = keyed(docs, id_col, text_col).select("doc_id", "text_key", F.posexplode(F.split(ascii_lower(F.col("text")), "\n", -1)).alias("pos", "line"))
    key = F.btrim("line", F.lit(SPACE_CHARS))
    d = d.select("doc_id", "text_key", "pos", key.alias("key")).filter(F.length("key") >= min_chars)
    return d.select("doc_id", "text_key", "pos", F.xxhash64("key").alias("a"), F.xxhash64(F.lit(7), "key").alias("b"))


def dropped_positions(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, gone): per document with a common line, the sorted positions that go."""
    lines = _lines(docs, min_chars, id_col, text_col)
    common = lines.select("doc_id", "text_key", "a", "b").distinct().groupBy("a", "b").agg(F.count("*").alias("n")).filter(F.col("n") >= min_docs).select("a", "b")
    # As a table of known size: Spark broadcasts it if it is small, and can split a hot line's rows if it is not.
    common = staged(common, "common")
    gone = lines.join(common, ["a", "b"], "left_semi")
    return gone.groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("pos")).alias("gone"))


def _kept(lines: Column, gone: Column) -> Column:
    """The lines that stay. A run of them lies between two dropped positions; slices keep this linear in the lines."""
    ends = F.concat(F.array(F.lit(-1)), gone, F.array(F.size(lines)))
    runs = F.transform(F.arrays_zip(F.slice(ends, 1, F.size(ends) - 1).alias("a"), F.slice(ends, 2, F.size(ends) - 1).alias("b")), lambda x: F.slice(lines, x["a"] + 2, x["b"] - x["a"] - 1))
    return F.when(gone.isNull(), lines).otherwise(F.flatten(runs))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document row: n_lines, n_dropped and the kept lines joined by a newline (``kept_text``)."""
    gone = dropped_positions(docs, min_docs, min_chars, id_col, text_col)
    d = keyed(docs, id_col, text_col)
    d = d.join(gone, same_document(d, gone), "left").select(d["doc_id"], d["text_key"], F.split("text", "\n", -1).alias("lines"), "gone")
    n_gone = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone"))
    return d.select("doc_id", "text_key", F.size("lines").cast("long").alias("n_lines"), n_gone.cast("long").alias("n_dropped"), F.array_join(_kept(F.col("lines"), F.col("gone")), "\n").alias("kept_text"))


def rewrite(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """The documents with their kept lines as ``text``, and ``n_chars`` to match; other columns, whatever their names, as they are."""
    id_, key, gone, lines = fresh_names(docs, "id", "key", "gone", "lines")
    found = dropped_positions(docs, min_docs, min_chars).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key), F.col("gone").alias(gone))
    text = F.col("text").cast("string")
    d = docs.join(found, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64(text) == F.col(key)), "left")
    d = d.withColumn(lines, F.split(F.coalesce(text, F.lit("")), "\n", -1))
    kept = F.array_join(_kept(F.col(lines), F.col(gone)), "\n")
    new = {"text": kept, "n_chars": F.length(kept).cast("long")}
    return d.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in docs.columns])
