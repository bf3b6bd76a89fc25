"""Ontology metadata of vertices and edges, from fixed rules compiled into expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Property names, ontology type, subtype, concept, legal category; the first rule with a name that is there wins.
NODE_RULES = (
    (("flnm", "receipt_no"), "Case", "Case", "사건", "수사사건"),
    (("event_type", "event_id", "transfer_id", "call_id"), "Event", "Event", "이벤트", "수사단서"),
    (("actno", "bacnt", "account_no"), "FinancialEvidence", "BankAccount", "계좌", "금융거래정보"),
    (("wallet_addr", "crypto_addr"), "FinancialEvidence", "CryptoWallet", "가상자산", "가상자산거래정보"),
    (("ip", "ip_addr", "ipaddr"), "DigitalEvidence", "NetworkTrace", "IP주소", "통신자료"),
    (("url", "site", "domain"), "DigitalEvidence", "WebTrace", "사이트", "인터넷기록"),
    (("file", "filename", "filepath"), "DigitalEvidence", "FileTrace", "파일", "디지털증거"),
    (("telno", "phone"), "Suspect", "ContactInfo", "전화번호", "통신사실확인자료"),
    (("name", "suspect"), "Suspect", "Suspect", "용의자", "피의자정보"),
    (("id", "user_id", "nickname"), "Suspect", "DigitalIdentity", "디지털ID", "인터넷기록"),
    (("atm", "atm_id"), "PhysicalEvidence", "ATM", "ATM", "물리증거"),
)
#: What a vertex has that no rule knows.
UNKNOWN = ("Unknown", "Unknown", "알 수 없음", None)
#: Concept and legal category of events by their event_type.
EVENT_KINDS = (
    ("transfer", "이체이벤트", "금융거래정보"),
    ("call", "통화이벤트", "통신사실확인자료"),
    ("access", "접속이벤트", "통신자료"),
)
#: Edge type, relation, meaning, legal significance.
EDGE_MEANINGS = (
    ("digital_trace", "investigatesDigitalTrace", "디지털 흔적 조사", "디지털증거"),
    ("used_account", "usedFinancialResource", "금융 계좌 사용", "금융거래정보"),
    ("used_crypto", "usedCryptoAsset", "가상자산 사용", "가상자산거래정보"),
    ("used_phone", "usedCommunicationDevice", "전화번호 사용", "통신사실확인자료"),
    ("accessed_ip", "accessedFromIP", "IP 접속", "통신자료"),
    ("participated_in", "participatedInEvent", "이벤트 참여", "범죄사실"),
    ("event_involved", "involvedObject", "이벤트 관련 객체", "증거물"),
    ("supported_by", "supportedByEvidence", "증거에 의한 입증", "증거능력"),
    ("visited_site", "visitedWebsite", "사이트 방문", "인터넷기록"),
)
NODE_FIELDS = ("ontology_type", "entity_subtype", "domain_concept", "legal_category")
EDGE_FIELDS = ("semantic_relation", "domain_meaning", "legal_significance")


def _struct(names, values) -> Column:
    return F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(names, values)])


def node_metadata(props: Column) -> Column:
    """F8: struct (ontology_type, entity_subtype, domain_concept, legal_category) of a property map."""
    found = F
    for names, *values in NODE_RULES:
        here = reduce(lambda a, b: a | b, [F.map_contains_key(props, n) for n in names])
        if values[0] == "Event":  # the kind of event decides concept and category
            for kind, concept, legal in EVENT_KINDS:
                found = found.when(here & F.coalesce(props["event_type"] == kind, F.lit(False)), _struct(NODE_FIELDS, (*values[:2], concept, legal)))
        found = found.when(here, _struct(NODE_FIELDS, values))
    return found.otherwise(_struct(NODE_FIELDS, UNKNOWN))


def enriched_node(props: Column) -> Column:
    """F8: the property map with its metadata; a missing category is left out."""
    m = node_metadata(props)
    extra = F.create_map(*[x for n in NODE_FIELDS for x in (F.lit(n), m[n])], F.lit("kics_compliant"), F.lit("true"))
    own = F.map_filter(props, lambda k, _: ~k.isin(*NODE_FIELDS, "kics_compliant"))
    return F.map_concat(own, F.map_filter(extra, lambda _, v: v.isNotNull()))


def edge_metadata(kind: Column) -> Column:
    """struct (semantic_relation, domain_meaning, legal_significance) of an edge type; unknown types stand for themselves."""
    found = F
    for name, *values in EDGE_MEANINGS:
        found = found.when(kind == name, _struct(EDGE_FIELDS, values))
    itself = F.struct(kind.alias(EDGE_FIELDS[0]), kind.alias(EDGE_FIELDS[1]), F.lit(None).cast("string").alias(EDGE_FIELDS[2]))
    return found.otherwise(itself)
