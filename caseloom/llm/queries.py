"""The registered query of each operator: it applies the operator to its whole table and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.llm import bpe, decontaminate, hard_negatives, kn_quality, langid, license_scan, line_dedup, prefix_trie, quality_rules, simhash, suffix_dedup, url_filter, warc
from caseloom.llm.oracles import ORACLES  # noqa: F401

QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(c):
    return F.sha2(F.encode(c, "utf-8"), 256)


@query
def op1_line_dedup(spark, sf_dir):
    d = line_dedup.line_dedup(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return d.select("doc_id", "n_lines", "n_dropped", sha256(F.col("kept_text")).alias("kept_sha256"))


@query
def op2_suffix_dedup(spark, sf_dir):
    d = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"), length=400)
    return d.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op3_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"), min_bytes=0)


@query
def op4_quality_classifier(spark, sf_dir):
    d = kn_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return d.select("doc_id", "lang", "n_chars_scored", "perplexity", "threshold", "kept")


@query
def op5_license_scan(spark, sf_dir):
    d = license_scan.license_scan(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


@query
def op6_simhash(spark, sf_dir):
    d = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return d.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query
def op7_bpe(spark, sf_dir):
    return bpe.digests(table(spark, sf_dir, "documents"))


@query
def op8_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    dicts = langid.dictionaries(docs.filter(~langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull()))
    d = langid.identify(docs, dicts)
    return d.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


@query
def op9_decontamination(spark, sf_dir):
    d = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    return d.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha256(F.array_join("items", ",")).alias("items_sha256"), "contaminated")


@query
def op10_quality_rules(spark, sf_dir):
    d = quality_rules.quality_rules(table(spark, sf_dir, "documents"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


#: (host, path, verdict)
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op11_url_filter(spark, sf_dir):
    # A page is labelled by the row of labels with its number: bad if of low quality or toxic.
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judge(table(spark, sf_dir, "pages"), outcomes, URL_RULES)


@query
def op12_hard_negatives(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label, n_positives=5, n_negatives=3, low=50, high=95, scale=256)


@query
def op13_prefix_trie(spark, sf_dir):
    c = F.col("conv_id")
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"), base_of=c - c % 5, kept=F.crc32(c.cast("string")) % 9, most=8)
