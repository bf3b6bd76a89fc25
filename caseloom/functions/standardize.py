"""Codes, clean-up and typing as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bank names and abbreviations by bank code; case counts.
BANK_NAMES = {
    "004": "KB 국민 국민은행", "088": "SH 신한 신한은행", "020": "WR 우리 우리은행", "081": "HN 하나 하나은행", "011": "NH 농협 농협은행",
    "003": "IBK 기업 기업은행", "023": "SC SC제일 SC제일은행", "027": "CITI 씨티 씨티은행", "002": "KDB 산업 산업은행", "007": "Sh 수협 수협은행",
    "031": "DGB 대구 대구은행", "032": "BNK 부산 부산은행", "034": "KJB 광주 광주은행", "035": "JJB 제주 제주은행", "037": "JBB 전북 전북은행",
    "045": "MG 새마을 새마을금고", "048": "CU 신협", "071": "POST 우체국", "089": "KBANK 케이뱅크 K뱅크", "090": "KAKAO 카카오 카카오뱅크", "092": "TOSS 토스 토스뱅크",
}
#: Carriers by code, and hash algorithms.
CARRIER_NAMES = {"01": "SKT SK텔레콤 SK", "02": "KT 케이티", "03": "LGU LGU+ LG유플러스 LG", "04": "MVNO 알뜰폰 가상이동통신"}
HASH_NAMES = {"MD5": "md5 MD5", "SHA1": "sha1 SHA1 SHA-1", "SHA256": "sha256 SHA256 SHA-256", "SHA384": "sha384 SHA384 SHA-384", "SHA512": "sha512 SHA512 SHA-512"}
#: Keywords that write, for P10; words that F34 removes.
WRITE_KEYWORDS = ("CREATE", "DELETE", "DROP", "MERGE", "REMOVE", "SET")
SEARCH_NOISE = ("계좌", "번호", "인물", "사람", "사이트", "IP", "주소", "전화")


def _lookup(names: dict[str, str], c: Column) -> Column:
    pairs = [(n, code) for code, text in names.items() for n in text.split()]
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(pairs)])[c]


def _code(c: Column, digits: int, names: dict[str, str]) -> Column:
    c = F.trim(c)
    return F.when(c.rlike(rf"^\d{{{digits}}}$"), c).when(c != "", _lookup(names, c))


def bank_code(c: Column) -> Column:
    """three-digit bank code of a name, abbreviation or code; null if unknown."""
    return _code(c, 3, BANK_NAMES)


def carrier_code(c: Column) -> Column:
    """two-digit carrier code."""
    return _code(c, 2, CARRIER_NAMES)


def hash_algorithm(c: Column) -> Column:
    """normal name of a hash algorithm, SHA256 if unknown."""
    return F.coalesce(_lookup(HASH_NAMES, F.trim(c)), F.lit("SHA256"))


def safe_text(c: Column) -> Column:
    """null to empty, quotes and backslashes removed, trimmed."""
    return F.trim(F.translate(F.coalesce(c, F.lit("")), "'\\\"", ""))


def parse_props(c: Column) -> Column:
    """JSON object to map of strings; null, blank or bad gives an empty map."""
    return F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>"))


def sanitize_label(c: Column) -> Column:
    """Letters, digits and underscores of a label."""
    return F.regexp_replace(c, "[^a-zA-Z0-9_]", "")


def valid_name(c: Column) -> Column:
    """Whether a graph's name is allowed."""
    return c.rlike("^[a-zA-Z_][a-zA-Z0-9_]*$")


def write_keywords(c: Column) -> Column:
    """P10: the write keywords that stand in a query text as words."""
    u = F.upper(F.coalesce(c, F.lit("")))
    return F.array_compact(F.array(*[F.when(u.rlike(rf"\b{k}\b"), F.lit(k)) for k in WRITE_KEYWORDS]))


def masked(c: Column, shown: int = 4) -> Column:
    """All but the last ``shown`` characters as stars."""
    return F.concat(F.repeat(F.lit("*"), F.length(c) - shown), F.right(c, F.lit(shown)))


def amount(c: Column) -> Column:
    """F16: whole amount of a text with thousands marks, 0 if it is not a number."""
    return F.coalesce(F.regexp_replace(c, ",", "").try_cast("double").cast("bigint"), F.lit(0))


def duration_seconds(start: Column, end: Column) -> Column:
    """seconds from start to end, 0 if either is not a time."""
    t = lambda c: F.unix_timestamp(F.try_to_timestamp(c))
    return F.coalesce(t(end) - t(start), F.lit(0))


def call_type(c: Column) -> Column:
    """01 for voice, else 02."""
    return F.when(c == "음성", "01").otherwise("02")


def domain(c: Column) -> Column:
    """third part of a URL with a scheme, else the first; at most 200 characters."""
    parts = F.split(c, "/")
    return F.substring(F.when(c.startswith("http"), F.coalesce(F.get(parts, 2), F.lit(""))).otherwise(F.get(parts, 0)), 1, 200)


def extension(c: Column) -> Column:
    """what follows the last dot, at most ten characters."""
    return F.substring(F.regexp_extract(c, r"\.([^.]*)$", 1), 1, 10)


def case_reference(c: Column) -> Column:
    """the case named in a report text, null if none is."""
    return F.nullif(F.regexp_extract(c, "사건참조:(.*)", 1), F.lit(""))


def is_atm(c: Column) -> Column:
    """whether an account stands for a cash machine."""
    return F.upper(c).startswith("ATM") | (c == "현금인출")


def atm_place(c: Column) -> Column:
    return F.coalesce(F.nullif(F.regexp_extract(c, "[가-힣]+", 0), F.lit("")), F.lit("미상"))


def atm_number(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)$", 1)


def search_term(c: Column) -> Column:
    """a search term without the words that only name a kind."""
    return F.trim(F.regexp_replace(c, "|".join(SEARCH_NOISE), ""))


def keyword(c: Column) -> Column:
    """first part of an answer without quotes; of more than five words one with a digit."""
    k = F.trim(F.get(F.split(F.regexp_replace(c, "[\"'`]", ""), "[,\n]"), 0))
    words = F.split(k, r"\s+")
    digits = F.get(F.filter(words, lambda w: w.rlike(r"\d")), 0)
    return F.rtrim(F.when(F.size(words) > 5, F.coalesce(digits, k)).otherwise(k), F.lit("."))


def table_kind(c: Column) -> Column:
    """EDGE for eg_ tables and those named after a relation, else NODE."""
    return F.when(c.startswith("eg_") | c.contains("rel"), "EDGE").otherwise("NODE")


def grade(passed: Column, checks: Column) -> Column:
    """A from 95 %, B from 80 %, C from 60 %, else D."""
    share = 100 * passed
    return F.when(share >= 95 * checks, "A").when(share >= 80 * checks, "B").when(share >= 60 * checks, "C").otherwise("D")


def value_types(values: DataFrame) -> DataFrame:
    """(col, type) from all values of (col, v), in the order phone, ip, account, url."""
    f = values.groupBy("col").agg(
        F.bool_and(F.col("v").rlike(r"^0[0-9]{1,2}-?[0-9]{3,4}-?[0-9]{4}$")).alias("phone"),
        F.bool_and(F.col("v").rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")).alias("ip"),
        F.bool_and(F.col("v").rlike(r"^[0-9-]{10,20}$")).alias("account"),
        F.bool_or(F.col("v").rlike(r"^(https?://|www\.)")).alias("url"),
    )
    return f.select("col", F.when(F.col("phone"), "phone").when(F.col("ip"), "ip").when(F.col("account"), "account").when(F.col("url"), "url").otherwise("unknown").alias("type"))
