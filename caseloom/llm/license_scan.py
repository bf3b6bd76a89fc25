"""License scans by diagonal voting.

Every rolling word k-gram of a document is joined to the places of that k-gram in the license
templates (a fixed table, far below any broadcast bound). A hit votes for its diagonal: document
position minus template position. Base phrases need the votes of their whole diagonal. For a passage
the hits that follow each other on a diagonal are a run; runs of ``min_run`` hits or more are merged with runs of
neighbouring diagonals that go on after them, at most ``max_gap`` words later in the text and in the template, so that words that
were put in, lost or replaced do not split a match, however far they move its diagonal. Of all chains of runs the best one that ends in each run is
taken, which verifies the order of the span; it has to have ``min_share`` of the template's k-grams.

The join compares the words themselves, so every vote is a real match of k words. Runs are chained only with those of their
neighbourhood: a text is cut where it has no run of the template for ``max_gap`` words.

Defined cases: null or wordless text has no places and score 0; a repeated document row gets its
result once per row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.llm.common import ascii_lower, keyed, plain_words, same_document, staged
from caseloom.llm.license_texts import BASE_PHRASES, PASSAGES

K, MIN_SHARE, MAX_GAP, MIN_RUN = 2, 0.85, 20, 2
DOC = ["doc_id", "text_key"]


def template_grams(spark: SparkSession, k: int = K) -> DataFrame:
    """(gram, label, exact, tpos, n_grams): the places of each k-gram in the templates."""
    rows = []
    for exact, templates in ((True, BASE_PHRASES), (False, PASSAGES)):
        for label, phrase in templates:
            words = phrase.split()
            grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)]
            rows += [(gram, label, exact, i, len(grams)) for i, gram in enumerate(grams)]
    return spark.createDataFrame(rows, "gram string, label string, exact boolean, tpos int, n_grams int")


def hits(docs: DataFrame, min_share: float = MIN_SHARE, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, label, exact, n_grams, at): all (pos, tpos) where a k-gram of a document stands in a template.

    The hashes of a text's rolling k-grams are looked up in those of the templates, a fixed set; only places found
    there are exploded and joined, by their words. Templates of which a document has too few hits for any match are left out.
    """
    templates = template_grams(docs.sparkSession, k)

    def rolling(hashes: Column, i: Column) -> Column:
        return F.xxhash64(*[F.get(hashes, i + j) for j in range(k)])

    one = templates.select("gram", F.transform(F.split("gram", " "), lambda w: F.xxhash64(w)).alias("hashes"))
    known = [r[0] for r in one.select(rolling(F.col("hashes"), F.lit(0))).distinct().collect()]
    words = plain_words(ascii_lower(F.col("text"))).alias("words")
    d = keyed(docs, id_col, text_col).select(*DOC, words)
    d = d.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))
    every = F.when(F.size("words") >= k, F.sequence(F.lit(0), F.size("words") - k))
    places = F.filter(every, lambda i: rolling(F.col("hashes"), i).isin(known))
    at = F.transform(places, lambda i: F.struct(i.alias("pos"), F.array_join(F.slice("words", i + 1, k), " ").alias("gram")))
    d = d.select(*DOC, F.explode(at).alias("w"))
    d = d.select(*DOC, F.col("w.pos").alias("pos"), F.col("w.gram").alias("gram"))
    found = d.join(F.broadcast(templates), "gram").groupBy(*DOC, "label", "exact", "n_grams").agg(F.collect_set(F.struct("pos", "tpos")).alias("at"))
    return found.filter(F.size("at") >= F.when(F.col("exact"), F.col("n_grams")).otherwise(least(min_share)))


def least(min_share: float) -> Column:
    """k-grams that a match of a passage has at least."""
    return F.ceil(F.col("n_grams") * min_share - 1e-9)


def best_chains(runs: Column, gap: int) -> Column:
    """For each run (s, e, t, u: its first and next place in the text and in the template), in order of s, the best chain that ends with it: its hits (n) and first place (a)."""

    def add(done, x):
        before = F.filter(done, lambda y: (y["e"] <= x["s"]) & (y["u"] <= x["t"]) & (x["s"] - y["e"] <= gap) & (x["t"] - y["u"] <= gap))
        best = F.array_max(F.transform(before, lambda y: F.struct(y["n"], (-y["a"]).alias("back"))))
        n = x["e"] - x["s"] + F.coalesce(best["n"], F.lit(0))
        return F.concat(done, F.array(F.struct(x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), x["u"].alias("u"), n.alias("n"), F.coalesce(-best["back"], x["s"]).alias("a"))))

    return F.aggregate(runs, F.array().cast("array<struct<s:int,e:int,t:int,u:int,n:int,a:int>>"), add)


def base_matches(hit: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, text_key, base, label, start, end, share): each place of a base phrase."""
    diagonal = (F.col("pos") - F.col("tpos")).alias("start")
    whole = hit.filter("exact").groupBy(*DOC, "label", "n_grams", diagonal).agg(F.count("*").alias("votes")).filter("votes = n_grams")
    end = (F.col("start") + F.col("n_grams") + k - 1).alias("end")
    return whole.select(*DOC, F.lit(True).alias("base"), "label", "start", end, F.lit(1.0).alias("share"))


def passage_matches(hit: DataFrame, min_share: float = MIN_SHARE, max_gap: int = MAX_GAP, k: int = K, min_run: int = MIN_RUN) -> DataFrame:
    """(doc_id, text_key, base, label, start, end, share): each verified span of a passage."""
    one, gap = [*DOC, "label", "n_grams"], max_gap + k - 1  # k-grams without a hit around so many words
    # All that follows is within a document and label: one shuffle.
    voted = hit.filter(~F.col("exact")).select(*one, "pos", "tpos", (F.col("pos") - F.col("tpos")).alias("diagonal")).repartition(*one)
    on = Window.partitionBy(*one, "diagonal").orderBy("pos")
    run = voted.withColumn("first", F.col("pos") - F.row_number().over(on)).groupBy(*one, "diagonal", "first")
    run = run.agg(F.min("pos").alias("s"), (F.max("pos") + 1).alias("e"), F.min("tpos").alias("t"), (F.max("tpos") + 1).alias("u")).filter(F.col("e") - F.col("s") >= min_run)
    order = Window.partitionBy(*one).orderBy("s", "t")
    apart = F.coalesce(F.col("s") - F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)) > gap, F.lit(True)).cast("int")
    run = run.withColumn("apart", apart).withColumn("block", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = run.groupBy(*one, "block").agg(F.sum(F.col("e") - F.col("s")).alias("votes"), F.sort_array(F.collect_list(F.struct("s", "t", "e", "u"))).alias("runs"))
    blocks = blocks.filter(F.col("votes") >= least(min_share))
    merged = blocks.select(*one, F.inline(best_chains(F.col("runs"), gap))).filter(F.col("n") >= least(min_share))
    merged = merged.select(*DOC, "label", F.col("a").alias("start"), (F.col("e") + k - 1).alias("end"), (F.col("n") / F.col("n_grams")).alias("share"))
    one = Window.partitionBy(*DOC, "label")
    # Several runs may each end a chain that is long enough: spans that overlap are one.
    order = one.orderBy("start", "end")
    reached = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce(F.col("start") >= reached, F.lit(True)).cast("int")
    merged = merged.withColumn("fresh", fresh).withColumn("match", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = merged.groupBy(*DOC, "label", "match").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("share").alias("share"))
    return merged.select(*DOC, F.lit(False).alias("base"), "label", "start", "end", "share")


def license_scan(
    docs: DataFrame, min_share: float = MIN_SHARE, max_gap: int = MAX_GAP, k: int = K, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Per document: n_words, n_base, first_word, last_word, base_labels, labels (arrays, sorted), score, spans.

    ``spans`` has (label, start, end, share) of every verified match, in words from 0.
    ``score`` is the largest share of a template that a match has; a base phrase is 1.
    """
    hit = staged(hits(docs, min_share, k, id_col, text_col), "hits").select(*DOC, "label", "exact", "n_grams", F.inline("at"))
    base = F.col("base")
    found = base_matches(hit, k).unionByName(passage_matches(hit, min_share, max_gap, k)).groupBy(*DOC).agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"),
        F.sort_array(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        F.sort_array(F.collect_set("label")).alias("labels"),
        F.max("share").alias("score"),
        F.sort_array(F.collect_list(F.struct("start", "end", "label", "share"))).alias("spans"),
    )
    d = keyed(docs, id_col, text_col).select(*DOC, F.size(plain_words(ascii_lower(F.col("text")))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return d.join(found, same_document(d, found), "left").select(
        d["doc_id"],
        d["text_key"],
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"),
        F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", none).alias("base_labels"),
        F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )
