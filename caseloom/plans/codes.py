"""Queries of the code, clean-up and naming functions, over texts derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseloom.functions import ontology
from caseloom.functions import standardize as st
from caseloom.plans import projection as p
from caseloom.plans.projection import SQL, table
from caseloom.plans.registry import register


def spelling(names: tuple[str, ...], key: str) -> str:
    """One of some spellings by a key, as an expression of both dialects."""
    cases = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(names))
    return f"CASE {key} % {len(names)} {cases} END"


#: Spellings of banks, carriers and hash algorithms, with the code that each has (none for the last).
BANKS = (("KB", "004"), ("신한은행", "088"), ("020", "020"), (" 하나 ", "081"), ("농협", "011"), ("토스뱅크", "092"), ("", None), ("없는은행", None))
CARRIERS = (("SKT", "01"), ("케이티", "02"), ("03", "03"), ("LG유플러스", "03"), ("알뜰폰", "04"), ("다른통신", None))
HASHES = (("md5", "MD5"), ("SHA-1", "SHA1"), ("sha256", "SHA256"), ("SHA512", "SHA512"), ("crc32", "SHA256"))


def _codes_sql(pairs) -> str:
    known = ", ".join(f"('{a}', {chr(39) + b + chr(39) if b else 'NULL'})" for a, b in pairs)
    return f"k(word, code) AS (VALUES {known})"


def _coded(name, pairs, function):
    words = spelling(tuple(a for a, _ in pairs), "s_suppkey")

    @register(name, f"WITH {_codes_sql(pairs)} SELECT s_suppkey, word, code FROM (SELECT s_suppkey, {words} AS word FROM supplier) JOIN k USING (word)")
    def run(spark, d):
        s = table(spark, d, "supplier").select("s_suppkey", F.expr(words).alias("word"))
        return s.select("s_suppkey", "word", function(F.col("word")).alias("code"))

    run.__doc__ = f"{name[:2].upper()}: code of each spelling."


_coded("f3_bank_codes", BANKS, st.bank_code)
_coded("f4_carrier_codes", CARRIERS, st.carrier_code)
_coded("f5_hash_algorithms", HASHES, st.hash_algorithm)


@register("f13_cash_machines", """WITH a AS (SELECT CASE s_suppkey % 4 WHEN 0 THEN 'ATM-강남-' || s_suppkey::VARCHAR WHEN 1 THEN 'atm' || s_suppkey::VARCHAR WHEN 2 THEN '현금인출' ELSE s_suppkey::VARCHAR END AS no, s_suppkey FROM supplier)
SELECT s_suppkey, no, s_suppkey % 4 < 3 AS is_atm, CASE s_suppkey % 4 WHEN 0 THEN '강남' WHEN 2 THEN '현금인출' ELSE '미상' END AS place, CASE WHEN s_suppkey % 4 = 2 THEN '' ELSE s_suppkey::VARCHAR END AS number FROM a""")
def cash_machines(spark, d):
    """accounts that stand for cash machines, with place and number."""
    k = F.col("s_suppkey").cast("string")
    no = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("ATM-강남-"), k)).when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("atm"), k)).when(F.col("s_suppkey") % 4 == 2, "현금인출").otherwise(k)
    a = table(spark, d, "supplier").select("s_suppkey", no.alias("no"))
    return a.select("s_suppkey", "no", st.is_atm(F.col("no")).alias("is_atm"), st.atm_place(F.col("no")).alias("place"), st.atm_number(F.col("no")).alias("number"))


@register("f15_case_references", "SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderkey::VARCHAR END AS \"case\" FROM orders")
def case_references(spark, d):
    """the case that a report's text refers to."""
    t = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("피해 신고 사건참조:"), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 3 == 1, "사건참조:").otherwise("없음")
    return table(spark, d, "orders").select("o_orderkey", st.case_reference(t).alias("case"))


@register("f17_call_durations", f"""WITH {SQL['calls']} SELECT call_id, CASE WHEN call_id % 7 = 0 THEN 0 ELSE duration % 500 END AS seconds, CASE kind WHEN 'click' THEN '01' ELSE '02' END AS call_type FROM calls""")
def call_durations(spark, d):
    """seconds between the texts of two times, 0 if one cannot be read, and the type of call."""
    c = p.calls(spark, d).withColumn("n", F.col("duration") % 500)
    start, end = F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.date_format(F.timestamp_add("SECOND", F.col("n"), F.col("ts")), "yyyy-MM-dd HH:mm:ss")
    end = F.when(F.col("call_id") % 7 == 0, "later").otherwise(end)
    kind = F.when(F.col("kind") == "click", "음성").otherwise("문자")
    return c.select("call_id", st.duration_seconds(start, end).alias("seconds"), st.call_type(kind).alias("call_type"))


@register("p9_names", "SELECT p_partkey, regexp_replace(p_name || '-#' || p_partkey::VARCHAR, '[^a-zA-Z0-9_]', '', 'g') AS label, regexp_matches(p_brand, '^[a-zA-Z_][a-zA-Z0-9_]*$') AS brand_ok, regexp_matches(split_part(p_name, ' ', 1), '^[a-zA-Z_][a-zA-Z0-9_]*$') AS word_ok FROM part")
def names(spark, d):
    """Labels cleaned, and names tested."""
    label = st.sanitize_label(F.concat(F.col("p_name"), F.lit("-#"), F.col("p_partkey").cast("string")))
    return table(spark, d, "part").select("p_partkey", label.alias("label"), st.valid_name(F.col("p_brand")).alias("brand_ok"), st.valid_name(F.get(F.split("p_name", " "), 0)).alias("word_ok"))


@register("f33_keywords", "SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 'acct' || conv_id::VARCHAR WHEN 1 THEN '12' || conv_id::VARCHAR ELSE 'one two three' END AS keyword, CASE turn % 3 WHEN 0 THEN 'acct' || conv_id::VARCHAR WHEN 1 THEN conv_id::VARCHAR ELSE '' END AS term FROM conversations")
def keywords(spark, d):
    """the keyword in an answer, and a search term without words that only name a kind."""
    k = F.col("conv_id").cast("string")
    three = lambda a, b, c: F.when(F.col("turn") % 3 == 0, a).when(F.col("turn") % 3 == 1, b).otherwise(c)
    answer = three(F.concat(F.lit("\"acct"), k, F.lit("\", because")), F.concat(F.lit("the number is for sure 12"), k, F.lit(" here.")), F.lit("`one two three`.\nmore"))
    term = three(F.concat(F.lit("acct"), k, F.lit(" 계좌")), F.concat(F.lit("전화번호 "), k), F.lit("사람"))
    return table(spark, d, "conversations").select("conv_id", "turn", st.keyword(answer).alias("keyword"), st.search_term(term).alias("term"))


@register("f10_edge_labels", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'paid' WHEN 1 THEN lower(event_type) WHEN 2 THEN 'related_to' ELSE 'known' END AS label FROM events")
def edge_labels(spark, d):
    """an edge's label from its properties."""
    e = F.col("event_id") % 4
    props = (
        F.when(e == 0, F.create_map(F.lit("domain_meaning"), F.lit("PAID"), F.lit("type"), F.col("event_type")))
        .when(e == 1, F.create_map(F.lit("type"), F.col("event_type")))
        .when(e == 2, F.create_map(F.lit("edge_type"), F.lit("")))
        .otherwise(F.create_map(F.lit("semantic_relation"), F.lit("Known"), F.lit("edge_type"), F.lit("x")))
    )
    return table(spark, d, "events").select("event_id", ontology.edge_label(props).alias("label"))


@register("f11_concepts", f"WITH {p.vertices_sql()} SELECT label, CASE label WHEN 'vt_case' THEN 'Case' WHEN 'vt_psn' THEN 'Person' WHEN 'vt_bacnt' THEN 'BankAccount' WHEN 'vt_telno' THEN 'Phone' ELSE 'Other' END AS concept, count(*) AS n FROM vertices GROUP BY ALL")
def concepts(spark, d):
    """concept class of every vertex from the names of its properties."""
    return p.vertices(spark, d).groupBy("label", ontology.concept(F.col("props")).alias("concept")).agg(F.count("*").alias("n"))
