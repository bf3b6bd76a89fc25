from itertools import product

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as s

from caseloom.operators import build, graph, paths, text
from caseloom.sources import csv


def write(path, name, header, rows):
    (path / name).write_text("﻿" + ",".join(header) + "\n" + "\n".join(",".join(r) for r in rows) + "\n", encoding="utf-8")


@pytest.fixture(scope="module")
def case_files(tmp_path_factory):
    d = tmp_path_factory.mktemp("case")
    write(d, "tbl_vt_psn.csv", [" flnm", "gndr"], [("kim", "m"), ("lee", "f"), ("park", "")])
    write(d, "tbl_vt_telno.csv", ["telno", "flnm", "tlcmco"], [("010-1", "kim", "KT"), ("010-2", "lee", "")])
    write(d, "tbl_vt_bacnt.csv", ["actno", "dpstr", "bank"], [("100", "kim", "KB"), ("200", "lee", "SH"), ("현금인출", "", "")])
    write(d, "tbl_eg_case.csv", ["incdnt_no", "incdnt_nm", "incdnt_typ_cd", "occrn_dt", "incdnt_smry_cn"], [("c1", "fraud", "A", "2024-01-01 00:00:00", "x")])
    write(d, "tbl_eg_case_prsn.csv", ["incdnt_no", "prsn_id", "role"], [("c1", "kim", "suspect"), ("c1", "lee", "victim")])
    write(d, "tbl_eg_telno_poss.csv", ["flnm", "telno"], [("kim", "010-1"), ("lee", "010-2")])
    write(d, "tbl_eg_rmt.csv", ["id", "se", "dpstr", "bank", "actno", "dpst_amt", "tkmny_amt", "rlt_bank", "rlt_dpstr", "rlt_actno", "Ip", "rmt_ymdhm"],
          [("1", "입금", "kim", "KB", "100", "5000", "0", "SH", "lee", "200", "1.2.3.4", "2024-01-01 10:00:00"), ("2", "출금", "kim", "KB", "100", "", "3000", "", "", "현금인출", "", "2024-01-01 10:05:00")])
    write(d, "tbl_eg_call.csv", ["id", "dsptch_no", "rcptn_no", "bgng_ymdhm", "end_ymdhm", "tlcmco", "se"], [("1", "010-1", "010-2", "2024-01-01 09:00:00", "2024-01-01 09:01:30", "KT", "음성"), ("2", "010-2", "010-1", "bad", "", "", "인터넷접속")])
    return d


def test_case_files_become_a_graph(spark, case_files):
    loads = [csv.load_layout(f.name, csv.read_csv(spark, str(f))) for f in sorted(case_files.iterdir())]
    tables = csv.merge_loads(loads)
    calls = {r["DSPTCH_TELNO"]: (r["CALL_DUR_SEC"], r["CALL_TYP_CD"]) for r in tables["TB_TELNO_CALL_DTL"].collect()}
    assert calls == {"010-1": (90, "01"), "010-2": (0, "02")}
    v, e = build.build(tables)
    assert {r["label"]: r["count"] for r in v.groupBy("label").count().collect()} == {"vt_case": 1, "vt_psn": 3, "vt_bacnt": 2, "vt_atm": 1, "vt_telno": 2, "vt_transfer": 2, "vt_call": 2, "vt_ip": 1}
    assert {r["label"]: r["count"] for r in e.groupBy("label").count().collect()} == {"from_account": 2, "to_account": 2, "caller": 2, "callee": 2, "involves": 2, "owns_phone": 2, "has_account": 2, "used_ip": 1}
    paid = {(r["src"], r["label"]) for r in e.filter("label = 'from_account'").collect()}
    assert paid == {("vt_bacnt:200", "from_account"), ("vt_bacnt:100", "from_account")}  # the deposit came from the other account


def test_wide_file(spark, tmp_path):
    write(tmp_path, "wide.csv", [" 접수번호", "피의자", "계좌", "송금", "수취", "금액", "ip", "url"], [("c1", "kim", "100", "100", "200", '"1,000"', "1.2.3.4", "http://a.b/c"), ("c2", "", "", "", "", "x", "", "")])
    out = csv.fan_out(csv.read_csv(spark, str(tmp_path)), {"case": "접수번호", "suspect": "피의자", "account": "계좌", "sender": "송금", "receiver": "수취", "amount": "금액", "ip": "ip", "url": "url"})
    n = {k: x.count() for k, x in out.items()}
    assert (n["TB_INCDNT_MST"], n["TB_PRSN"], n["TB_FIN_BACNT"], n["TB_FIN_BACNT_DLNG"], n["TB_SYS_LGN_EVT"], n["TB_FRD_VCTM_RPT"], n["TB_WEB_DMN"]) == (2, 1, 2, 1, 1, 1, 1)
    assert out["TB_FIN_BACNT_DLNG"].first()["DLNG_AMT"] == 1000


def test_related_cases_and_components(spark):
    e = spark.createDataFrame([("vt_case:A", "vt_bacnt:1", "eg_used_account"), ("vt_case:B", "vt_bacnt:1", "eg_used_account"), ("vt_case:A", "vt_telno:1", "eg_used_phone"), ("vt_case:B", "vt_telno:1", "eg_used_phone"), ("vt_case:C", "vt_bacnt:2", "eg_used_account")], "src string, dst string, label string")
    r = build.related_cases(e).collect()
    assert {(x["src"], x["dst"], x["shared"]) for x in r} == {("vt_case:A", "vt_case:B", 2), ("vt_case:B", "vt_case:A", 2)}
    comp = {x["v_id"]: x["component"] for x in paths.components(e.selectExpr("src as a", "dst as b")).collect()}
    assert len(set(comp.values())) == 2 and comp["vt_case:A"] == comp["vt_case:B"] != comp["vt_case:C"]


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(s.sets(s.tuples(s.integers(0, 7), s.integers(0, 7)).filter(lambda p: p[0] != p[1]), min_size=1, max_size=12))
def test_paths_and_walks_match_brute_force(spark, pairs):
    rows = [(f"{a}-{b}", str(a), str(b), "x") for a, b in sorted(pairs)]
    e = spark.createDataFrame(rows, "e_id string, src string, dst string, label string")
    near = {}
    for _, a, b, _ in rows:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def distance(a, b):
        front, seen = {a}, {a}
        for n in range(7):
            if b in front:
                return n
            front = {y for x in front for y in near.get(x, ())} - seen
            seen |= front

    want = {(a, b): distance(a, b) for a, b in product("0123", "4567") if distance(a, b) is not None}
    got = paths.shortest(e, spark.createDataFrame(list(product("0123", "4567")), "a string, b string")).collect()
    assert {(r["a"], r["b"]): r["hops"] for r in got} == want
    assert all(len(r["path"]) == r["hops"] + 1 <= 7 for r in got)
    both = [(i, a, b) for i, a, b, _ in rows] + [(i, b, a) for i, a, b, _ in rows]
    two = sorted(y for i, a, x in both if a == "0" for j, b, y in both if b == x and i != j)
    seeds = spark.createDataFrame([("0",)], "v_id string")
    assert sorted(r["at"] for r in paths.walks(e, seeds, 2).collect()) == two


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", None)], "k int, name string, extra string")
    new = spark.createDataFrame([(1, "", "y", 1), (1, None, "", 2), (3, "c", None, 1), (3, "d", None, 2)], "k int, name string, extra string, at int")
    got = {r["k"]: (r["name"], r["extra"]) for r in graph.upsert_coalesce(old, new, ["k"], "at").collect()}
    assert got == {1: ("a", "y"), 2: ("b", None), 3: ("d", None)}
    again = graph.upsert_ignore(old, new.drop("at"), ["k"])
    assert again.count() == 3 and graph.upsert_ignore(again, new.drop("at"), ["k"]).count() == 3


def test_chunks(spark):
    long = ("b" * 299 + ".") + "c" * 600
    found = text.chunks(spark.createDataFrame([(1, ""), (2, "a" * 500), (3, long)], "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["chunk_index"]): r["text"] for r in found}
    assert (1, 0) not in got and got[2, 0] == "a" * 500 and got[3, 0] == "b" * 299 + "." and got[3, 1].startswith("b")
