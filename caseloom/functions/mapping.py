"""What the columns of landed files mean, as jobs over a table columns(file, ordinal, column)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Type, vertex label, words that name it in a column; earlier types win ties.
COLUMN_WORDS = (
    ("caller", "vt_telno", "발신번호 발신 caller dsptch_no"), ("callee", "vt_telno", "수신번호 수신 callee rcptn_no"),
    ("sender", "vt_bacnt", "출금계좌번호 출금계좌 송금계좌 송금 sender"), ("receiver", "vt_bacnt", "입금계좌번호 입금계좌 수취계좌 수취 receiver"),
    ("case", "vt_case", "접수번호 사건번호 flnm incdnt_no"), ("account", "vt_bacnt", "계좌번호 계좌 actno account bacnt"), ("phone", "vt_telno", "전화번호 전화 telno phone 휴대폰"),
    ("src_ip", "vt_ip", "src_ip"), ("dst_ip", "vt_ip", "dst_ip"), ("ip", "vt_ip", "IP주소 ip ip_addr"), ("site", "vt_site", "사이트 url domain site"), ("file", "vt_file", "파일명 파일 filename file"),
    ("suspect", "vt_psn", "피의자 suspect"), ("name", "vt_psn", "이름 성명 name"), ("nickname", "vt_psn", "닉네임 nickname"), ("amount", None, "거래금액 이체금액 금액 amount"), ("date", None, "발생일 거래일시 이체일시 일시 date"), ("crime", None, "죄명 crime"), ("bank", None, "은행명 은행 bank"),
)
#: Fixed values: (type, type) -> relation.
RELATION_RULES = (
    ("case", "account", "eg_used_account"), ("case", "phone", "eg_used_phone"), ("case", "ip", "digital_trace"), ("case", "site", "digital_trace"), ("case", "suspect", "involves"),
    ("sender", "receiver", "transferred_to"), ("caller", "callee", "contacted"), ("src_ip", "dst_ip", "communicated_with"), ("suspect", "account", "has_account"), ("suspect", "phone", "owns_phone"),
)
#: Action, words that show it.
ACTION_WORDS = (("Transfer", "출금|입금|송금|이체|거래금액|sender|receiver", 0.9), ("Call", "발신|수신|통화|caller|callee", 0.9), ("Access", "ip|port|protocol|접속", 0.85), ("Message", "메시지|문자|message|sms", 0.85))


def column_types(columns: DataFrame) -> DataFrame:
    """(file, ordinal, column, type, label, method, confidence); exact names first, then contained words, longer words first.

    One column has one type and, in a file, one type one column; the rest is 'unmapped'.
    """
    spark = columns.sparkSession
    rows = [(t, label, w.lower(), n) for n, (t, label, words) in enumerate(COLUMN_WORDS) for w in words.split()]
    dim = F.broadcast(spark.createDataFrame(rows, "type string, label string, word string, priority int"))  # a fixed table
    c = columns.withColumn("low", F.lower(F.trim("column")))
    exact, part = F.col("low") == F.col("word"), F.contains("low", F.col("word"))
    m = c.join(dim, exact | (part & ((F.length("word") > 2) | (F.col("word") != "ip"))), "left")
    m = m.withColumn("score", F.when(F.col("low") == F.col("word"), 3.0).when(F.col("word").isNotNull(), 1.0 + F.least(F.length("word"), F.lit(20)) / 20.0).otherwise(0.0))
    per_column = Window.partitionBy("file", "ordinal").orderBy(F.desc("score"), "priority")
    m = m.withColumn("r", F.row_number().over(per_column)).filter("r = 1").drop("r")
    per_type = Window.partitionBy("file", "type").orderBy(F.desc("score"), "ordinal")
    m = m.withColumn("own", F.col("type").isNull() | (F.row_number().over(per_type) == 1))
    kind = lambda x: F.when(F.col("own"), F.col(x))
    method = F.when(F.col("type").isNull() | ~F.col("own"), "unmapped").when(F.col("score") == 3.0, "exact").otherwise("partial")
    return m.select("file", "ordinal", "column", kind("type").alias("type"), kind("label").alias("label"), method.alias("method"), F.when(method == "exact", 0.95).when(method == "partial", 0.9).otherwise(0.0).alias("confidence"))


def relations(types: DataFrame) -> DataFrame:
    """(file, source, target, relation): for each file the column pairs that a rule links."""
    rules = F.broadcast(types.sparkSession.createDataFrame(RELATION_RULES, "type string, to_type string, relation string"))
    a = types.filter("type is not null").select("file", F.col("column").alias("source"), "type")
    b = types.filter("type is not null").select("file", F.col("column").alias("target"), F.col("type").alias("to_type"))
    return a.join(rules, "type").join(b, ["file", "to_type"]).select("file", "source", "target", "relation")


def actions(columns: DataFrame) -> DataFrame:
    """(file, action, confidence) from the words of all a file's columns, the first action that shows."""
    text = columns.groupBy("file").agg(F.lower(F.concat_ws(" ", F.collect_list("column"))).alias("t"))
    action, confidence = F, F
    for name, words, sure in ACTION_WORDS:
        action, confidence = action.when(F.col("t").rlike(words), name), confidence.when(F.col("t").rlike(words), sure)
    return text.select("file", action.otherwise("Unknown").alias("action"), confidence.otherwise(0.0).alias("confidence"))


def load_config(types: DataFrame) -> DataFrame:
    """(file, source, target, edge, source_label, target_label) for each relation."""
    label = types.select("file", F.col("column").alias("c"), "label")
    r = relations(types)
    r = r.join(label.select("file", F.col("c").alias("source"), F.col("label").alias("source_label")), ["file", "source"])
    return r.join(label.select("file", F.col("c").alias("target"), F.col("label").alias("target_label")), ["file", "target"]).select("file", "source", "target", F.col("relation").alias("edge"), "source_label", "target_label")


def mapping_errors(mapping: DataFrame, labels: DataFrame) -> DataFrame:
    """(file, errors) of mappings (file, source, target, edge, source_label, target_label); ``labels`` has the known ones."""
    missing = [F.when(F.coalesce(F.col(c), F.lit("")) == "", F.lit(f"{c} is missing")) for c in ("source", "target", "edge")]
    known = labels.select(F.col("label").alias("l"))
    m = mapping.join(F.broadcast(known.withColumn("ok", F.lit(True))), F.col("source_label") == F.col("l"), "left")
    return m.select("file", F.array_compact(F.array(*missing, F.when(F.col("ok").isNull(), F.concat(F.lit("unknown label "), F.coalesce("source_label", F.lit("")))))).alias("errors"))
