"""Dictionaries of the ontology, the crime patterns and the laws: small fixed tables, broadcast in joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Concept, vertex label, Korean name, layer.
CONCEPTS = (
    ("Case", "vt_case", "사건", "Case"), ("Investigation", "vt_inv", "수사", "Case"), ("Event", "vt_event", "이벤트", "Event"),
    ("Person", "vt_psn", "인물", "Actor"), ("Persona", "vt_persona", "페르소나", "Actor"), ("Organization", "vt_org", "조직", "Actor"), ("Device", "vt_dev", "기기", "Actor"),
    ("Transfer", "vt_transfer", "이체", "Action"), ("Call", "vt_call", "통화", "Action"), ("Access", "vt_access", "접속", "Action"), ("Message", "vt_msg", "메시지", "Action"),
    ("LocationEvent", "vt_loc_evt", "위치이벤트", "Action"), ("LPREvent", "vt_lpr_evt", "LPR인식", "Action"),
    ("BankAccount", "vt_bacnt", "계좌", "Evidence"), ("CryptoWallet", "vt_crypto", "가상자산", "Evidence"), ("NetworkTrace", "vt_ip", "IP주소", "Evidence"),
    ("WebTrace", "vt_site", "사이트", "Evidence"), ("FileTrace", "vt_file", "파일", "Evidence"), ("Phone", "vt_telno", "전화번호", "Evidence"),
    ("ATM", "vt_atm", "ATM", "Evidence"), ("Location", "vt_loc", "위치", "Evidence"), ("Vehicle", "vt_vhcl", "차량", "Evidence"),
)

#: Rule, threshold, confidence.
INFERENCE_RULES = (
    ("OrganizedCrime", 3, 0.80), ("MoneyLaundering", 3, 0.75), ("Accomplice", 5, 0.70), ("RapidTransfer", 10, 0.85), ("NightActivity", 3, 0.65), ("CrossDomainLink", 2, 0.80),
)

#: Pattern, name, weight of required edges, weight of optional vertices, least score.
PATTERNS = (
    ("bodycam", "몸캠피싱", 0.70, 0.30, 0.85), ("voice", "보이스피싱", 0.75, 0.25, 0.80), ("phone_fraud", "전화금융사기", 0.70, 0.30, 0.80), ("investment", "투자사기", 0.70, 0.30, 0.80), ("smishing", "스미싱", 0.70, 0.30, 0.80),
    ("money_chain", "자금세탁체인", 0.80, 0.20, 0.75), ("call_network", "통화네트워크", 0.70, 0.30, 0.80), ("mule_account", "대포통장", 0.80, 0.20, 0.80),
)
#: Pattern, edge label of the case, vertex label at its end.
PATTERN_EDGES = (
    ("bodycam", "digital_trace", "vt_site"), ("bodycam", "related_to", "vt_file"), ("bodycam", "eg_used_account", "vt_bacnt"),
    ("voice", "eg_used_phone", "vt_telno"), ("voice", "eg_used_account", "vt_bacnt"),
    ("phone_fraud", "eg_used_phone", "vt_telno"), ("phone_fraud", "eg_used_account", "vt_bacnt"),
    ("investment", "digital_trace", "vt_site"), ("investment", "eg_used_account", "vt_bacnt"),
    ("smishing", "eg_used_phone", "vt_telno"), ("smishing", "digital_trace", "vt_site"), ("smishing", "eg_used_account", "vt_bacnt"),
    # Their edges are not incident to the case, whose subgraph is one hop: these three never reach their threshold here.
    ("money_chain", "from_account", "vt_transfer"), ("money_chain", "to_account", "vt_bacnt"), ("call_network", "caller", "vt_call"), ("call_network", "callee", "vt_telno"),
    ("mule_account", "eg_used_account", "vt_case"),
)
#: Pattern, optional vertex label, weight.
PATTERN_OPTIONAL = (
    ("bodycam", "vt_ip", 0.20), ("bodycam", "vt_telno", 0.10), ("voice", "vt_ip", 0.15), ("voice", "vt_site", 0.15),
    ("phone_fraud", "vt_atm", 0.30), ("investment", "vt_telno", 0.15), ("investment", "vt_id", 0.15), ("smishing", "vt_ip", 0.15), ("smishing", "vt_file", 0.15), ("call_network", "vt_case", 0.20), ("mule_account", "vt_transfer", 0.30),
)
#: Evidence label, laws, importance.
EVIDENCE_LAWS = (
    ("vt_site", "정보통신망법,전자상거래법", "high"), ("vt_bacnt", "형법 사기죄,범죄수익은닉규제법,전기통신금융사기법", "high"), ("vt_telno", "통신비밀보호법,전기통신사업법", "medium"),
    ("vt_ip", "정보통신망법,통신비밀보호법", "high"), ("vt_file", "형사소송법,정보통신망법", "high"), ("vt_id", "개인정보보호법", "medium"), ("vt_atm", "형사소송법", "medium"),
)
#: Crime type, required and optional evidence.
CRIME_EVIDENCE = (
    ("몸캠피싱", "vt_site,vt_file,vt_bacnt", "vt_ip,vt_telno"), ("보이스피싱", "vt_telno,vt_bacnt", "vt_ip,vt_atm"), ("투자사기", "vt_site,vt_bacnt", "vt_telno,vt_id"),
    ("전화금융사기", "vt_telno,vt_bacnt", "vt_atm"), ("스미싱", "vt_telno,vt_site,vt_bacnt", "vt_ip,vt_file"),
)
#: Relation, start and end concept, meaning class, whether it is transitive.
RELATIONS = (
    ("involves", "Case", "Person", False), ("eg_used_account", "Case", "BankAccount", False), ("eg_used_phone", "Case", "Phone", False),
    ("has_account", "Person", "BankAccount", False), ("owns_phone", "Person", "Phone", False), ("used_ip", "Person", "NetworkTrace", False),
    ("from_account", "BankAccount", "Transfer", False), ("to_account", "Transfer", "BankAccount", False), ("caller", "Phone", "Call", False), ("callee", "Call", "Phone", False),
    ("transferred_to", "BankAccount", "BankAccount", True), ("contacted", "Phone", "Phone", False), ("accomplice_of", "Person", "Person", True), ("related_case", "Case", "Case", False),
)

TABLES = {
    "concepts": ("concept string, label string, label_ko string, layer string", CONCEPTS),
    "rules": ("rule string, threshold int, confidence double", INFERENCE_RULES),
    "patterns": ("pattern string, name string, w_required double, w_optional double, least double", PATTERNS),
    "pattern_edges": ("pattern string, edge string, label string", PATTERN_EDGES),
    "pattern_optional": ("pattern string, label string, weight double", PATTERN_OPTIONAL),
    "evidence_laws": ("label string, laws string, importance string", EVIDENCE_LAWS),
    "crime_evidence": ("crime string, required string, optional string", CRIME_EVIDENCE),
    "relations": ("relation string, domain string, range string, transitive boolean", RELATIONS),
}


def dim(spark: SparkSession, name: str) -> DataFrame:
    schema, rows = TABLES[name]
    return spark.createDataFrame(rows, schema)


def dim_sql(name: str) -> str:
    """The dictionary as a common table expression."""
    schema, rows = TABLES[name]
    columns = ", ".join(x.split()[0] for x in schema.split(", "))
    text = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows) + ")"
