"""Pattern scores, evidence checklists and readiness, for all cases at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pattern_scores(case_edges: DataFrame, patterns: DataFrame, required: DataFrame, optional: DataFrame) -> DataFrame:
    """(case_id, pattern, matched, found_optional, score, least, labels) where every required label is present.

    ``case_edges`` is (case_id, edge, label, node). A slot of a label binds to the case's smallest vertex of it,
    as one lookup per label would; its edge counts if that vertex has it. An edge binds if its own smallest
    vertex is the label's, so a case is a handful of minima, and all patterns are matched inside its row.
    """
    low = case_edges.groupBy("case_id", "label", "edge").agg(F.min("node").alias("node"))
    case = low.groupBy("case_id").agg(F.collect_list(F.struct("label", "edge", "node")).alias("x"))
    first = lambda e: F.array_min(F.transform(F.filter("x", lambda y: y["label"] == e["label"]), lambda y: y["node"]))
    bound = F.transform(F.filter("x", lambda e: e["node"] == first(e)), lambda e: F.concat_ws("|", e["edge"], e["label"]))
    case = case.select("case_id", F.array_distinct(F.transform("x", lambda e: e["label"])).alias("labels"), bound.alias("bound"))
    need = required.groupBy("pattern").agg(F.collect_set("label").alias("req_labels"), F.collect_list(F.concat_ws("|", "edge", "label")).alias("req_edges"))
    need = patterns.join(need, "pattern").join(optional.groupBy("pattern").agg(F.collect_set("label").alias("opt_labels")), "pattern", "left")
    s = case.crossJoin(F.broadcast(need)).filter(F.size(F.array_except("req_labels", "labels")) == 0)  # a handful of patterns
    n_opt = F.coalesce(F.size("opt_labels"), F.lit(0))
    found = F.when(n_opt > 0, F.size(F.array_intersect("opt_labels", "labels"))).otherwise(0)
    s = s.withColumn("matched", F.size(F.array_intersect("req_edges", "bound")).cast("long")).withColumn("found_optional", found.cast("long"))
    score = F.col("matched") / F.size("req_edges") * F.col("w_required") + F.when(n_opt > 0, F.col("found_optional") / n_opt).otherwise(0.0) * F.col("w_optional")
    return s.select("case_id", "pattern", "matched", "found_optional", F.round(score, 3).alias("score"), "least", "labels")


def best_patterns(scores: DataFrame) -> DataFrame:
    """Matched patterns of each case by score, the first one primary."""
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "pattern")
    return scores.filter("score >= least").withColumn("place", F.row_number().over(w)).withColumn("primary", F.col("place") == 1)


def checklist(chosen: DataFrame, required: DataFrame, optional: DataFrame) -> DataFrame:
    """(case_id, pattern, kind, label, weight, done): what each case's pattern asks for, and whether it is there; ``chosen`` has the case's labels."""
    items = required.select("pattern", F.lit("required").alias("kind"), "label", F.lit(1.0).alias("weight")).distinct().unionAll(optional.select("pattern", F.lit("optional").alias("kind"), "label", "weight"))
    return chosen.select("case_id", "pattern", "labels").join(F.broadcast(items), "pattern").select("case_id", "pattern", "kind", "label", "weight", F.array_contains("labels", F.col("label")).alias("done"))


def evidence_completeness(items: DataFrame) -> DataFrame:
    """Share of required evidence for 0.7 and of optional for 0.3, with its band."""
    part = lambda kind: F.coalesce(F.avg(F.when(F.col("kind") == kind, F.col("done").cast("double"))), F.lit(0.0))
    c = items.groupBy("case_id", "pattern").agg(F.round(part("required") * 0.7 + part("optional") * 0.3, 3).alias("completeness"))
    x = F.col("completeness")
    return c.withColumn("band", F.when(x >= 0.9, "excellent").when(x >= 0.75, "good").when(x >= 0.6, "fair").otherwise("poor"))


def recommendations(items: DataFrame, most: int = 5) -> DataFrame:
    """What is missing, required first and then by weight, at most ``most`` for a case; light optional items are left out."""
    w = Window.partitionBy("case_id", "pattern").orderBy(F.when(F.col("kind") == "required", 0).otherwise(1), F.desc("weight"), "label")
    m = items.filter(~F.col("done") & ((F.col("kind") == "required") | (F.col("weight") >= 0.15)))
    text = F.when(F.col("kind") == "required", F.concat(F.lit("[필수] "), "label", F.lit(" 확보 필요"))).otherwise(F.concat(F.lit("[권장] "), "label", F.lit(" 확보 권장")))
    return m.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("case_id", "pattern", "place", text.alias("advice"))


def readiness(case_labels: DataFrame, crimes: DataFrame) -> DataFrame:
    """(case_id, crime, score, band, missing_required, missing_optional) against every crime type's evidence."""
    have = case_labels.groupBy("case_id").agg(F.collect_set("label").alias("have"))
    c = crimes.select("crime", F.split("required", ",").alias("req"), F.split("optional", ",").alias("opt"))
    x = have.crossJoin(F.broadcast(c))  # five crime types
    share = lambda n: F.size(F.array_intersect(n, "have")) / F.size(n)
    score = F.round(share("req") * 0.7 + share("opt") * 0.3, 2)
    missing = lambda n: F.array_join(F.sort_array(F.array_except(n, "have")), ",")
    x = x.select("case_id", "crime", score.alias("score"), missing("req").alias("missing_required"), missing("opt").alias("missing_optional"))
    return x.withColumn("band", F.when(F.col("score") >= 0.85, "ready").when(F.col("score") >= 0.6, "partial").otherwise("weak"))
