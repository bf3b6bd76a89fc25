from pyspark.sql import functions as F

from caseloom.functions import mapping, ontology
from caseloom.functions import standardize as st


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_codes(spark):
    cases = {"국민": "004", "KB": "004", "국민은행": "004", "신한": "088", "SH": "088", "Sh": "007", "우리은행": "020", "토스": "092", "004": "004", "없는은행": None, None: None, " KB ": "004"}
    for value, want in cases.items():
        assert one(spark, value, st.bank_code) == want, value
    for value, want in {"SKT": "01", "SK": "01", "KT": "02", "LGU+": "03", "LG": "03", "알뜰폰": "04", "07": "07", "x": None}.items():
        assert one(spark, value, st.carrier_code) == want
    for value, want in {"md5": "MD5", "SHA-1": "SHA1", "sha256": "SHA256", "SHA512": "SHA512", "other": "SHA256"}.items():
        assert one(spark, value, st.hash_algorithm) == want


def test_text_functions(spark):
    assert one(spark, ' a\'b"\\ ', st.safe_text) == "ab"
    assert one(spark, None, st.safe_text) == ""
    assert one(spark, "1,234.9", st.amount) == 1234 and one(spark, "x", st.amount) == 0
    assert one(spark, "https://a.b/c", st.domain) == "a.b" and one(spark, "a.b/c", st.domain) == "a.b"
    assert one(spark, "사건참조:2024-1", st.case_reference) == "2024-1" and one(spark, "x", st.case_reference) is None
    assert one(spark, "ATM강남역12", st.atm_place) == "강남역" and one(spark, "ATM12", st.atm_place) == "미상" and one(spark, "ATM강남역12", st.atm_number) == "12"
    assert one(spark, "drop it; MATCH (n) SET n.x=1", st.write_keywords) == ["DROP", "SET"]
    assert one(spark, '"김철수", 외', st.keyword) == "김철수"
    assert one(spark, "123456", st.masked) == "**3456"


def test_node_label_and_enrich(spark):
    rows = [({"event_id": "1", "ip": "2"}, "vt_event"), ({"ip": "1", "actno": "2"}, "vt_ip"), ({"actno": "2", "name": "x"}, "vt_bacnt"), ({"name": "x"}, "vt_psn"), ({}, "vt_psn"), (None, "vt_psn"), ({"flnm": "1"}, "vt_flnm")]
    for props, want in rows:
        assert spark.createDataFrame([(props,)], "p map<string,string>").select(ontology.node_label(F.col("p")).alias("y")).first()["y"] == want
    df = spark.createDataFrame([("vt_bacnt", {"bank": "국민"}), ("vt_telno", {"carrier": "KT"}), ("vt_file", {"hash_alg": "sha1"}), ("vt_psn", {"name": "x"})], "l string, p map<string,string>")
    got = [r["e"] for r in df.select(ontology.enrich(F.col("l"), F.col("p")).alias("e")).collect()]
    assert got == [{"bank": "국민", "bnk_cd": "004"}, {"carrier": "KT", "carr_cd": "02"}, {"hash_alg": "SHA1", "evd_cd": "E09"}, {"name": "x"}]


def test_column_mapping(spark):
    files = {"bank": "순번 거래일시 출금계좌번호 입금은행 입금계좌번호 거래금액 적요", "telecom": "발신번호 수신번호 통화시간 기지국위치", "net": "Src_IP Dst_IP Port Protocol", "wide": "접수번호 죄명 발생일 피의자 닉네임 계좌 송금 수취 금액 전화 ip"}
    columns = spark.createDataFrame([(f, i, c) for f, names in files.items() for i, c in enumerate(names.split())], "file string, ordinal int, column string")
    types = mapping.column_types(columns)
    found = {(r["file"], r["column"]): r["type"] for r in types.collect()}
    assert found["bank", "출금계좌번호"] == "sender" and found["bank", "입금계좌번호"] == "receiver" and found["telecom", "발신번호"] == "caller"
    assert [found["wide", c] for c in files["wide"].split()] == ["case", "crime", "date", "suspect", "nickname", "account", "sender", "receiver", "amount", "phone", "ip"]
    edges = {(r["file"], r["edge"]) for r in mapping.load_config(types).collect()}
    assert {("bank", "transferred_to"), ("telecom", "contacted"), ("net", "communicated_with"), ("wide", "involves")} <= edges
    assert {r["file"]: r["action"] for r in mapping.actions(columns).collect()} | {"wide": ""} == {"bank": "Transfer", "telecom": "Call", "net": "Access", "wide": ""}
    labels = spark.createDataFrame([("vt_bacnt",)], "label string")
    bad = mapping.mapping_errors(spark.createDataFrame([("f", "", "b", "e", "vt_x", "vt_bacnt")], "file string, source string, target string, edge string, source_label string, target_label string"), labels)
    assert bad.first()["errors"] == ["source is missing", "unknown label vt_x"]
