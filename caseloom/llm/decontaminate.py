"""Benchmark decontamination: token windows of the documents against the set of benchmark windows.

A window is ten consecutive words of an item, or the whole item if it is shorter. Places that do not begin like
a window are left out by a hash of the first words; windows are compared as their words, joined, so a hit is a verified one. The benchmark's windows are broadcast
while there are at most ``broadcast_rows`` of them and their words and item ids take at most BROADCAST_BYTES; beyond that
the same join is shuffled.

Defined cases: null or wordless text has no windows and is never contaminated; items without
words are ignored; repeated item texts all count as items; item ids of any type are taken as text, a null one counts for no item; a repeated document row gets the
result once per row; an empty benchmark leaves every document clean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseloom.llm.common import ascii_lower, fresh_names, keyed, plain_words, same_document, staged

#: The benchmark's windows are broadcast up to so many of them and so many bytes of words and item ids, with ROW_BYTES for what a row takes besides.
BROADCAST_ROWS, BROADCAST_BYTES, ROW_BYTES = 200_000, 32 << 20, 64
#: Words by which a place is told to begin like a window, and beginnings that are looked up as a fixed set.
LEAD, LEADS = 3, 20_000


def item_windows(benchmark: DataFrame, window: int = 10, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(gram, n, items): each distinct window of the benchmark, its words and the items that have it."""
    words = plain_words(ascii_lower(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))))
    b = benchmark.select(F.col(f"`{item_col}`").cast("string").alias("item_id"), words.alias("words")).filter(F.size("words") > 0)
    b = b.withColumn("n", F.least(F.size("words"), F.lit(window)))
    grams = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.array_join(F.slice("words", i, F.col("n")), " "))
    return b.select("item_id", "n", F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram", "n").agg(F.collect_set("item_id").alias("items"))


def places(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n_words, at): per document the places p, from 1, where a window can stand, with as many words as the window has.

    The first words of the windows are known by a hash of LEAD of them, as a fixed set up to LEADS hashes; only places that begin
    like a window have their words joined. Beyond that every place has. The documents are read and split once, and the result is a table.
    """
    lead = F.least(F.col("n"), F.lit(LEAD))
    words = F.transform(F.split("gram", " "), lambda w: F.xxhash64(w))
    of = known.select("n", "gram", lead.alias("m"), words.alias("hashes"))
    starts = {}
    for n, m in sorted({(r["n"], min(r["n"], LEAD)) for r in known.select("n").distinct().collect()}):  # at most ``window`` numbers
        found = [r[0] for r in of.filter(F.col("n") == n).select(_rolling(F.col("hashes"), F.lit(0), m)).distinct().limit(LEADS + 1).collect()]
        starts[n] = (m, found if len(found) <= LEADS else None)
    d = keyed(docs, id_col, text_col).select("doc_id", "text_key", plain_words(ascii_lower(F.col("text"))).alias("words"))
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))

    def grams(n):
        m, first = starts[n]
        every = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n)).otherwise(F.array().cast("array<int>"))
        some = every if first is None else F.filter(every, lambda i: _rolling(F.col("hashes"), i, m).isin(first))
        return F.transform(some, lambda i: F.struct((i + 1).alias("p"), F.array_join(F.slice("words", i + 1, n), " ").alias("gram")))

    at = [grams(n) for n in starts] or [F.array().cast("array<struct<p:int,gram:string>>")]
    return staged(d.select("doc_id", "text_key", F.size("words").cast("long").alias("n_words"), (F.concat(*at) if len(at) > 1 else at[0]).alias("at")), "places")


def _rolling(hashes: Column, i: Column, m: int) -> Column:
    return F.xxhash64(*[F.get(hashes, i + j) for j in range(m)])


def windows(benchmark: DataFrame, window: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, bool]:
    """The benchmark's windows as a table, and whether they are few enough to be broadcast."""
    known = staged(item_windows(benchmark, window), "windows")
    ids = F.aggregate("items", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 16)
    rows, size = known.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("gram") + ids + ROW_BYTES), F.lit(0))).first()
    return known, rows <= broadcast_rows and size <= BROADCAST_BYTES


def hits(found: DataFrame, known: DataFrame, few: bool) -> DataFrame:
    """(doc_id, text_key, p, n, items): each place of ``places`` where a benchmark window does stand; the join compares the words."""
    d = found.select("doc_id", "text_key", F.inline("at"))
    return d.join(F.broadcast(known) if few else known, "gram").select("doc_id", "text_key", "p", "n", "items")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, broadcast_rows: int = BROADCAST_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, items (array, sorted as strings), contaminated."""
    known, few = windows(benchmark, window, broadcast_rows)
    d = places(docs, known, id_col, text_col)
    found = hits(d, known, few).distinct()
    before = Window.partitionBy("doc_id", "text_key").orderBy("p", "n").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("reached", F.coalesce(F.max(F.col("p") + F.col("n")).over(before), F.lit(0)))
    fresh = F.greatest(F.lit(0), F.col("p") + F.col("n") - F.greatest(F.col("p"), F.col("reached")))
    found = found.groupBy("doc_id", "text_key").agg(F.sum(fresh).alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    d = d.select("doc_id", "text_key", "n_words")
    items = F.sort_array(F.coalesce(found["items"], F.array().cast("array<string>")))
    n_hit = F.coalesce(found["n_hit"], F.lit(0)).cast("long")
    return d.join(found, same_document(d, found), "left").select(d["doc_id"], d["text_key"], "n_words", n_hit.alias("n_hit"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, **kw) -> DataFrame:
    """The documents without a hit, with all their columns."""
    id_, key = fresh_names(docs, "id", "key")
    names = {c: kw[c] for c in ("id_col", "text_col") if c in kw}
    known, few = windows(benchmark, **{k: v for k, v in kw.items() if k not in names})
    bad = hits(places(docs, known, **names), known, few).select(F.col("doc_id").alias(id_), F.col("text_key").alias(key)).distinct()
    bad = staged(bad, "bad")  # of known size: if it is small Spark sends it to the documents and leaves their texts where they are
    own_id, text = (F.col(f"`{kw.get(c, of)}`") for c, of in (("id_col", "doc_id"), ("text_col", "text")))
    return docs.join(bad, own_id.eqNullSafe(F.col(id_)) & (F.xxhash64(text.cast("string")) == F.col(key)), "left_anti")
