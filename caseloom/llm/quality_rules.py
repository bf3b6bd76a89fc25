"""Quality rules: a threshold table compiled into one projection of built-in functions.

Defined cases: null text counts as empty; a text without words fails the base rule; repeated
rows each get their own result row; an empty table gives an empty result; other columns are
ignored. Everything is computed inside the row, so there is no shuffle and no skew.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import keyed, spaced_words

#: Frequent function words of the languages that the rules know.
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on are this an or at from "
    "de la le et les des en un une du que est pour dans il par sur "
    "der die das und den von zu mit ist im dem nicht ein eine auf für als auch "
    "el los las y del se por con su para al es lo"
).split()

#: (measure, least, most): a document that has a measure outside its bounds is not kept; None is no bound.
THRESHOLDS = (
    ("mean_word_chars", 2.0, 20.0),
    ("symbol_ratio", None, 0.3),
    ("letter_word_ratio", 0.5, None),
    ("stop_word_ratio", 0.01, None),
    ("dup_line_ratio", None, 0.5),
    ("ellipsis_line_ratio", None, 0.3),
    ("bullet_line_ratio", None, 0.9),
)

WINDOW = 5


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of each document: base counts and what the threshold table refers to."""
    d = keyed(docs, id_col, text_col)
    d = d.select("doc_id", "text", spaced_words(F.col("text")).alias("words"), F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"))
    stop = F.array(*[F.lit(w) for w in dict.fromkeys(STOP_WORDS)])
    d = d.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        F.size(F.filter("words", lambda w: w.rlike(r"\p{L}"))).cast("long").alias("n_letter_words"),
        F.size(F.filter("words", lambda w: F.array_contains(stop, F.lower(F.regexp_replace(w, r"[^\p{L}]+$", ""))))).cast("long").alias("n_stop_words"),
        F.size(F.filter("lines", lambda x: x.rlike(r"(\.\.\.|…)\s*$"))).cast("long").alias("n_ellipsis_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"^\s*[-*•●]\s"))).cast("long").alias("n_bullet_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"),
    )
    # Windows of five words as one hash each; only texts in which one is found twice go on to the positions.
    gram = lambda i: F.xxhash64(*[F.get("hashes", i + j) for j in range(WINDOW)])
    d = d.withColumn("grams", F.when(F.col("n_words") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("hashes") - WINDOW), gram)).otherwise(F.array().cast("array<bigint>"))).drop("hashes")
    d = d.withColumn("ordered", F.when(F.size(F.array_distinct("grams")) < F.size("grams"), F.sort_array(F.transform("grams", lambda g, i: F.struct(g.alias("g"), i.alias("i")))))).drop("grams")
    twice = F.filter("ordered", lambda x, j: (F.get("ordered", j - 1)["g"] == x["g"]) | F.coalesce(F.get("ordered", j + 1)["g"] == x["g"], F.lit(False)))
    d = d.withColumn("starts", F.sort_array(F.transform(twice, lambda x: x["i"]))).drop("ordered")
    covered = F.aggregate(F.transform("starts", lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get("starts", j + 1) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)
    return d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("starts")


def ratios(d: DataFrame) -> DataFrame:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("n_lines"), F.lit(1))
    return d.withColumns(
        {
            "mean_word_chars": F.col("word_chars") / words,
            "symbol_ratio": F.col("n_symbols") / words,
            "letter_word_ratio": F.col("n_letter_words") / words,
            "stop_word_ratio": F.col("n_stop_words") / words,
            "dup_line_ratio": F.col("n_dup_lines") / lines,
            "ellipsis_line_ratio": F.col("n_ellipsis_lines") / lines,
            "bullet_line_ratio": F.col("n_bullet_lines") / lines,
        }
    )


def verdict(thresholds=THRESHOLDS) -> Column:
    """The threshold table as one Boolean expression."""
    tests = []
    for name, least, most in thresholds:
        if least is not None:
            tests.append(F.col(name) >= least)
        if most is not None:
            tests.append(F.col(name) <= most)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """Per document its counts, its ratios, ``base_failed`` and ``kept``."""
    d = ratios(measures(docs, id_col, text_col))
    d = d.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return d.withColumn("kept", ~F.col("base_failed") & verdict(thresholds))
