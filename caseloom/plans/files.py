"""Queries of files that are written from the driver's tables and landed again: named tables, predefined layouts, JSON lines; and of names and codes of vertices."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import ontology
from caseloom.operators import graph as g
from caseloom.operators.paths import shared_path
from caseloom.plans import projection as p
from caseloom.plans.projection import SQL, table
from caseloom.plans.registry import register
from caseloom.sources import csv


@register("s2_named_table_load", """SELECT c_custkey::VARCHAR AS id, CASE WHEN c_nationkey < 10 THEN 'kept' ELSE c_name END AS name, CASE WHEN c_nationkey < 10 THEN 'old' WHEN c_mktsegment <> 'HOUSEHOLD' THEN c_mktsegment END AS segment FROM customer""")
def named_table_load(spark, d):
    """A CSV file with other column names, empty values for nulls, put into a table; rows whose key is there already stay."""
    c = table(spark, d, "customer")
    path = shared_path(spark)
    segment = F.when(F.col("c_mktsegment") == "HOUSEHOLD", "").otherwise(F.col("c_mktsegment"))
    c.select(F.col("c_custkey").alias(" 번호"), F.col("c_name").alias("이름 "), segment.alias("구분")).write.option("header", True).option("emptyValue", "").csv(path)
    new = csv.read_csv(spark, path).select(F.col("번호").alias("id"), F.col("이름").alias("name"), F.col("구분").alias("segment"))
    old = c.filter("c_nationkey < 10").select(F.col("c_custkey").cast("string").alias("id"), F.lit("kept").alias("name"), F.lit("old").alias("segment"))
    return g.upsert_ignore(old, new, ["id"])


def _files(spark, d):
    """File name -> its rows, in the columns of the predefined layouts."""
    s = lambda c: F.col(c).cast("string")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    calls, t, o = p.calls(spark, d), p.transfers(spark, d), table(spark, d, "orders")
    return {
        "tbl_vt_psn.csv": table(spark, d, "customer").select(F.col("c_name").alias("flnm"), F.lit("M").alias("gndr")),
        "tbl_vt_telno.csv": table(spark, d, "part").select(s("p_partkey").alias("telno"), F.col("p_name").alias("flnm"), F.lit("SKT").alias("tlcmco")),
        "tbl_eg_call.csv": calls.select(s("call_id").alias("id"), s("src").alias("dsptch_no"), s("dst").alias("rcptn_no"), at("ts").alias("bgng_ymdhm"), at(F.col("ts") + F.make_dt_interval(secs=F.col("duration") % 500)).alias("end_ymdhm"), F.lit("KT").alias("tlcmco"), F.when(F.col("kind") == "click", "음성").otherwise("인터넷접속").alias("se")),
        "tbl_eg_rmt.csv": t.select(F.concat_ws("-", "case_id", "seq").alias("id"), F.lit("출금").alias("se"), s("src").alias("dpstr"), F.lit("국민").alias("bank"), s("src").alias("actno"), F.lit("0").alias("dpst_amt"), F.format_number("amount", 0).alias("tkmny_amt"), F.lit("신한").alias("rlt_bank"), s("dst").alias("rlt_dpstr"), s("dst").alias("rlt_actno"), F.when(F.col("seq") == 1, F.concat(F.lit("10.0.0."), s("src"))).alias("Ip"), at("ts").alias("rmt_ymdhm")),
        "tbl_eg_case.csv": o.select(s("o_orderkey").alias("incdnt_no"), F.col("o_orderpriority").alias("incdnt_nm"), F.col("o_orderstatus").alias("incdnt_typ_cd"), at("o_orderdate").alias("occrn_dt"), F.lit("").alias("incdnt_smry_cn")),
        "tbl_eg_case_prsn.csv": o.select(s("o_orderkey").alias("incdnt_no"), s("o_custkey").alias("prsn_id"), F.col("o_orderstatus").alias("role")),
    }


@register("s3_predefined_loads", f"""WITH {SQL['calls']}, {SQL['transfers']}
SELECT 'TB_PRSN' AS table_name, count(DISTINCT c_name) AS n, NULL::BIGINT AS total FROM customer UNION ALL SELECT 'TB_TELNO_MST', (SELECT count(*) FROM (SELECT p_partkey AS k FROM part UNION SELECT src FROM calls UNION SELECT dst FROM calls)), NULL
UNION ALL SELECT 'TB_TELNO_CALL_DTL', count(*), sum(duration % 500)::BIGINT FROM calls UNION ALL SELECT 'TB_FIN_BACNT', (SELECT count(*) FROM (SELECT src AS k FROM transfers UNION SELECT dst FROM transfers)), NULL
UNION ALL SELECT 'TB_FIN_BACNT_DLNG', count(*), sum(amount)::BIGINT FROM transfers UNION ALL SELECT 'TB_SYS_LGN_EVT', count(DISTINCT (case_id, src, ts)), NULL FROM transfers WHERE seq = 1
UNION ALL SELECT 'TB_INCDNT_MST', count(*), NULL FROM orders UNION ALL SELECT 'TB_INCDNT_PRSN', count(*), NULL FROM orders""")
def predefined_loads(spark, d):
    """S3: six files in predefined layouts, told apart by their names, merged into their target tables; with the seconds and amounts that came through."""
    loads = []
    for name, rows in _files(spark, d).items():
        path = f"{shared_path(spark)}/{name}"
        rows.write.option("header", True).csv(path)
        loads.append(csv.load_layout(name, csv.read_csv(spark, path)))
    tables, out = csv.merge_loads(loads), None
    sums = {"TB_TELNO_CALL_DTL": "CALL_DUR_SEC", "TB_FIN_BACNT_DLNG": "DLNG_AMT"}
    for name, rows in tables.items():
        total = F.sum(F.col(sums[name]).cast("long")) if name in sums else F.lit(None).cast("long")
        x = rows.agg(F.count("*").alias("n"), total.alias("total")).select(F.lit(name).alias("table_name"), "n", "total")
        out = x if out is None else out.unionAll(x)
    return out


@register("s14_json_lines", "SELECT conv_id, turn, role AS instruction, md5(text) AS output_md5 FROM conversations")
def json_lines(spark, d):
    """Training records written as JSON lines and read with a stated schema."""
    path = shared_path(spark)
    table(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("instruction"), F.col("text").alias("output")).write.json(path)
    return csv.read_jsonl(spark, path, "conv_id long, turn long, instruction string, output string").select("conv_id", "turn", "instruction", F.md5("output").alias("output_md5"))


@register("f28_display_names", "SELECT 'vt_case:' || o_orderkey::VARCHAR AS v_id, o_orderkey::VARCHAR AS name FROM orders UNION ALL SELECT 'vt_psn:' || c_custkey::VARCHAR, c_name FROM customer UNION ALL SELECT 'vt_bacnt:' || s_suppkey::VARCHAR, s_suppkey::VARCHAR FROM supplier UNION ALL SELECT 'vt_telno:' || p_partkey::VARCHAR, p_partkey::VARCHAR FROM part UNION ALL SELECT 'vt_org:' || n_nationkey::VARCHAR, NULL FROM nation")
def display_names(spark, d):
    """what each vertex is called, by the first of its naming properties."""
    return p.vertices(spark, d).select("v_id", ontology.first_of(F.col("props"), ontology.NAME_KEYS).alias("name"))


_BANK = "CASE n_regionkey WHEN 0 THEN '국민' WHEN 1 THEN '신한' WHEN 2 THEN '004' WHEN 3 THEN '없는은행' ELSE '' END"


@register("f6_enriched_accounts", "SELECT s_suppkey AS account, CASE n_regionkey WHEN 0 THEN '004' WHEN 1 THEN '088' WHEN 2 THEN '004' END AS bnk_cd, CASE n_regionkey WHEN 0 THEN '국민' WHEN 1 THEN '신한' WHEN 2 THEN '004' WHEN 3 THEN '없는은행' ELSE '' END AS bank FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def enriched_accounts(spark, d):
    """accounts with the standard code of the bank that their properties name, where it is known."""
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    x = s.join(n, s["s_nationkey"] == n["n_nationkey"]).select("s_suppkey", F.create_map(F.lit("actno"), F.col("s_suppkey").cast("string"), F.lit("bank"), F.expr(_BANK)).alias("props"))
    e = x.select("s_suppkey", ontology.enrich(F.lit("vt_bacnt"), F.col("props")).alias("props"))
    return e.select(F.col("s_suppkey").alias("account"), F.try_element_at("props", F.lit("bnk_cd")).alias("bnk_cd"), F.col("props")["bank"].alias("bank"))
