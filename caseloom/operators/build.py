"""Relational tables to vertices (v_id, label, key, props) and edges (src, dst, label, props)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions import standardize as st
from caseloom.operators.pairs import linked, sharing_two


def v_id(label: str, key: Column) -> Column:
    return F.concat(F.lit(label + ":"), key.cast("string"))


def _vertices(df: DataFrame, label: str, key: str, **props: Column | str) -> DataFrame:
    pairs = [x for name, c in props.items() for x in (F.lit(name), (F.col(c) if isinstance(c, str) else c).cast("string"))]
    clean = F.map_filter(F.create_map(*pairs), lambda k, v: F.coalesce(v, F.lit("")) != "") if pairs else F.create_map().cast("map<string,string>")
    return df.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != "").select(v_id(label, F.col(key)).alias("v_id"), F.lit(label).alias("label"), F.col(key).cast("string").alias("key"), clean.alias("props"))


def _edges(df: DataFrame, label: str, src: Column, dst: Column, **props) -> DataFrame:
    pairs = [x for name, c in props.items() for x in (F.lit(name), F.col(c).cast("string"))]
    m = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return df.select(src.alias("src"), dst.alias("dst"), F.lit(label).alias("label"), m.alias("props")).filter("src is not null and dst is not null")


def account_id(c: Column) -> Column:
    """An account's vertex: a cash machine if its number says so."""
    return F.when(st.is_atm(c), v_id("vt_atm", c)).otherwise(v_id("vt_bacnt", c))


_ACCOUNT = ("vt_bacnt", "vt_atm")
#: Of each edge label the vertex labels at its start and end, and which end is the vertex of the row that the edge is made of.
ENDS = {
    "has_account": (("vt_psn",), _ACCOUNT, "dst"),
    "from_account": (_ACCOUNT, ("vt_transfer",), "dst"),
    "to_account": (("vt_transfer",), _ACCOUNT, "src"),
    "caller": (("vt_telno",), ("vt_call",), "dst"),
    "callee": (("vt_call",), ("vt_telno",), "src"),
    "used_ip": (("vt_psn",), ("vt_ip",), "dst"),
    "involves": (("vt_case",), ("vt_psn",), None),
    "owns_phone": (("vt_psn",), ("vt_telno",), None),
    "eg_used_account": (("vt_case",), _ACCOUNT, None),
    "eg_used_phone": (("vt_case",), ("vt_telno",), None),
    "resolved_to": (("vt_ip",), ("vt_site",), "dst"),
    "sent_msg": (("vt_telno",), ("vt_msg",), "dst"),
    "received_msg": (("vt_msg",), ("vt_telno",), "src"),
    "located_at": (("vt_telno",), ("vt_loc_evt",), "dst"),
    "detected_at": (("vt_vhcl",), ("vt_lpr_evt",), "dst"),
    "belongs_to": (_ACCOUNT, ("vt_org",), "src"),
    "owns_vehicle": (("vt_psn",), ("vt_vhcl",), "dst"),
}


def _joined(edges: DataFrame, label: str, vertices: dict[str, DataFrame]) -> DataFrame:
    """The edges of a label whose ends are there. An end is looked up among the vertices of its own labels only, and not at all
    where it is the vertex of the edge's own row, which is there unless its key is empty."""
    *ends, own = ENDS[label]
    for end, labels in zip(("src", "dst"), ends, strict=True):
        if end == own:
            edges = edges.filter(~F.col(end).isin(*[f"{x}:" for x in labels]))
            continue
        ids = None
        for x in labels:
            if x in vertices:
                ids = vertices[x].select("v_id") if ids is None else ids.unionAll(vertices[x].select("v_id"))
        edges = edges.limit(0) if ids is None else edges.join(ids.withColumnRenamed("v_id", end), end, "left_semi")
    return edges.select("src", "dst", "label", "props")


def build(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """The graph of whatever tables are there; edges whose ends no table declares are left out."""
    vs, es, c = {}, {}, F.col
    if "TB_INCDNT_MST" in t:
        vs["vt_case"] = _vertices(t["TB_INCDNT_MST"], "vt_case", "INCDNT_NO", flnm="INCDNT_NO", crime="INCDNT_NM", date="OCCRN_DT")
    if "TB_PRSN" in t:
        vs["vt_psn"] = _vertices(t["TB_PRSN"], "vt_psn", "PRSN_ID", id="PRSN_ID", name="KORN_FLNM")
    if "TB_FIN_BACNT" in t:
        a = t["TB_FIN_BACNT"]
        vs["vt_bacnt"] = _vertices(a.filter(~st.is_atm(c("BACNT_NO"))), "vt_bacnt", "BACNT_NO", actno="BACNT_NO", bank_cd="BANK_CD")
        vs["vt_atm"] = _vertices(a.filter(st.is_atm(c("BACNT_NO"))), "vt_atm", "BACNT_NO", atm_id="BACNT_NO", location=st.atm_place(c("BACNT_NO")), atm_no=st.atm_number(c("BACNT_NO")))
        es["has_account"] = _edges(a.filter("coalesce(DPSTR_NM, '') <> ''"), "has_account", v_id("vt_psn", c("DPSTR_NM")), account_id(c("BACNT_NO")))
    if "TB_TELNO_MST" in t:
        vs["vt_telno"] = _vertices(t["TB_TELNO_MST"], "vt_telno", "TELNO", telno="TELNO")
    if "TB_FIN_BACNT_DLNG" in t:
        m = t["TB_FIN_BACNT_DLNG"]
        vs["vt_transfer"] = _vertices(m, "vt_transfer", "DLNG_SN", event_id="DLNG_SN", event_type=F.lit("transfer"), amount="DLNG_AMT", timestamp="DLNG_DT")
        # a deposit comes from the other account.
        deposit = c("DLNG_SE_CD") == "01"
        es["from_account"] = _edges(m, "from_account", account_id(F.when(deposit, c("TRRC_BACNT_NO")).otherwise(c("BACNT_NO"))), v_id("vt_transfer", c("DLNG_SN")))
        es["to_account"] = _edges(m, "to_account", v_id("vt_transfer", c("DLNG_SN")), account_id(F.when(deposit, c("BACNT_NO")).otherwise(c("TRRC_BACNT_NO"))))
    if "TB_TELNO_CALL_DTL" in t:
        m = t["TB_TELNO_CALL_DTL"]
        extra = {"duration": "CALL_DUR_SEC", "timestamp": "CALL_STRT_DT"} if "CALL_DUR_SEC" in m.columns else {}
        vs["vt_call"] = _vertices(m, "vt_call", "CALL_SN", event_id="CALL_SN", **extra)
        es["caller"] = _edges(m, "caller", v_id("vt_telno", c("DSPTCH_TELNO")), v_id("vt_call", c("CALL_SN")))
        es["callee"] = _edges(m, "callee", v_id("vt_call", c("CALL_SN")), v_id("vt_telno", c("RCPTN_TELNO")))
    if "TB_SYS_LGN_EVT" in t:
        m = t["TB_SYS_LGN_EVT"]
        vs["vt_ip"] = _vertices(m.select("CNNT_IP_ADDR").distinct(), "vt_ip", "CNNT_IP_ADDR", ip_addr="CNNT_IP_ADDR")
        es["used_ip"] = _edges(m.select("USER_ID", "CNNT_IP_ADDR").distinct(), "used_ip", v_id("vt_psn", c("USER_ID")), v_id("vt_ip", c("CNNT_IP_ADDR")))
    if "TB_INCDNT_PRSN" in t:
        es["involves"] = _edges(t["TB_INCDNT_PRSN"], "involves", v_id("vt_case", c("INCDNT_NO")), v_id("vt_psn", c("PRSN_ID")), role="ROLE_CD")
    if "TB_TELNO_JOIN" in t:
        es["owns_phone"] = _edges(t["TB_TELNO_JOIN"].select("JOIN_PSNNM", "TELNO").distinct(), "owns_phone", v_id("vt_psn", c("JOIN_PSNNM")), v_id("vt_telno", c("TELNO")))
    if "TB_FRD_VCTM_RPT" in t:
        r = t["TB_FRD_VCTM_RPT"].withColumn("case", st.case_reference(c("DAM_CN")))
        es["eg_used_account"] = _edges(r.filter("SUSPCT_BACNT_NO is not null").select("case", "SUSPCT_BACNT_NO").distinct(), "eg_used_account", v_id("vt_case", c("case")), account_id(c("SUSPCT_BACNT_NO")))
        es["eg_used_phone"] = _edges(r.filter("SUSPCT_TELNO is not null").select("case", "SUSPCT_TELNO").distinct(), "eg_used_phone", v_id("vt_case", c("case")), v_id("vt_telno", c("SUSPCT_TELNO")))
    if "TB_WEB_DMN" in t:
        vs["vt_site"] = _vertices(t["TB_WEB_DMN"], "vt_site", "DMN_ADDR", domain="DMN_ADDR", ip_addr="IP_ADDR")
        es["resolved_to"] = _edges(t["TB_WEB_DMN"].filter("coalesce(IP_ADDR, '') <> ''"), "resolved_to", v_id("vt_ip", c("IP_ADDR")), v_id("vt_site", c("DMN_ADDR")))
    if "TB_TELNO_SMS_MSG" in t:
        m = t["TB_TELNO_SMS_MSG"]
        vs["vt_msg"] = _vertices(m, "vt_msg", "SMS_SN", event_id="SMS_SN", event_type=F.lit("sms"), timestamp="DSPTCH_DT", summary=F.substring("MSG_CN", 1, 50))
        es["sent_msg"] = _edges(m, "sent_msg", v_id("vt_telno", c("DSPTCH_TELNO")), v_id("vt_msg", c("SMS_SN")))
        es["received_msg"] = _edges(m, "received_msg", v_id("vt_msg", c("SMS_SN")), v_id("vt_telno", c("RCPTN_TELNO")))
    if "TB_GEO_MBL_LOC_EVT" in t:
        m = t["TB_GEO_MBL_LOC_EVT"]
        vs["vt_loc_evt"] = _vertices(m, "vt_loc_evt", "LOC_EVT_SN", event_id="LOC_EVT_SN", lat="BSST_LAT", lng="BSST_LOT", timestamp="OCCRN_DT")
        es["located_at"] = _edges(m, "located_at", v_id("vt_telno", c("TELNO")), v_id("vt_loc_evt", c("LOC_EVT_SN")))
    if "TB_VHCL_LPR_EVT" in t:
        m = t["TB_VHCL_LPR_EVT"]
        vs["vt_lpr_evt"] = _vertices(m, "vt_lpr_evt", "RCGN_SN", event_id="RCGN_SN", lat="LAT", lng="LOT", timestamp="RCGN_DT")
        es["detected_at"] = _edges(m, "detected_at", v_id("vt_vhcl", c("VHCLNO")), v_id("vt_lpr_evt", c("RCGN_SN")))
    if "TB_FIN_BACNT" in t and "INST_ID" in t["TB_FIN_BACNT"].columns:
        es["belongs_to"] = _edges(t["TB_FIN_BACNT"], "belongs_to", account_id(c("BACNT_NO")), v_id("vt_org", c("INST_ID")))
    if "TB_INST" in t:
        vs["vt_org"] = _vertices(t["TB_INST"], "vt_org", "INST_ID", org_id="INST_ID", org_nm="INST_NM")
    if "TB_VHCL_MST" in t:
        vs["vt_vhcl"] = _vertices(t["TB_VHCL_MST"], "vt_vhcl", "VHCLNO", vhclno="VHCLNO")
        es["owns_vehicle"] = _edges(t["TB_VHCL_MST"].filter("OWNR_NM is not null"), "owns_vehicle", v_id("vt_psn", c("OWNR_NM")), v_id("vt_vhcl", c("VHCLNO")))
    if "TB_DGTL_FILE_INVNT" in t:
        vs["vt_file"] = _vertices(t["TB_DGTL_FILE_INVNT"], "vt_file", "FILE_SN", filename="FILE_NM", extension="FILE_EXTSN_NM")
    vertices = edges = None
    for x in vs.values():
        one = x.dropDuplicates(["v_id"])  # ids of labels differ
        vertices = one if vertices is None else vertices.unionByName(one)
    for label, x in es.items():
        one = _joined(x, label, vs)
        edges = one if edges is None else edges.unionByName(one)
    return vertices, edges


def related_cases(edges: DataFrame, confidence: float = 0.75, least: int = 1) -> DataFrame:
    """Case pairs that share ``least`` pieces of evidence, in both directions; evidence is known by its vertex, so kinds never mix."""
    used = edges.filter(F.col("label").isin("eg_used_account", "eg_used_phone")).select(F.col("src").alias("case_v"), F.col("dst").alias("evidence")).distinct()
    if least >= 2:
        pairs = sharing_two(used, "evidence", "case_v").filter(F.col("shared") >= least)
    else:
        pairs = linked(used, ["evidence"], "case_v", least).groupBy("a", "b").agg(F.count("*").alias("shared"))
    both = pairs.unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "shared"))
    return both.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("related_case").alias("label"), "shared", F.lit(confidence).alias("confidence"))
