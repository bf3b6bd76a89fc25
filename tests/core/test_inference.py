"""Inference rules, edge ends by label, and paths from seeds, on small graphs."""

import random
from datetime import datetime, timedelta

from caseloom.operators import build, inference, paths, text

RULES = [("OrganizedCrime", 3, 0.8), ("MoneyLaundering", 3, 0.75), ("Accomplice", 5, 0.7), ("RapidTransfer", 10, 0.85), ("NightActivity", 3, 0.65), ("CrossDomainLink", 2, 0.8)]


def test_every_rule_finds_its_pattern_and_nothing_else(spark):
    noon, hour = datetime(2024, 1, 1, 12), timedelta(hours=1)
    edges = [(f"vt_case:{i}", "vt_telno:1", "eg_used_phone", None) for i in range(3)] + [(f"vt_case:{i}", "vt_telno:2", "eg_used_phone", None) for i in (0, 0, 1)]
    edges += [(f"vt_bacnt:s{i}", "vt_bacnt:m", "transferred_to", noon + 2 * i * hour) for i in range(3)] + [("vt_bacnt:m", "vt_bacnt:e", "transferred_to", noon)]
    edges += [(f"vt_psn:{a}", f"vt_telno:{k}", "contacted", noon) for a in (1, 2) for k in range(5)] + [("vt_psn:3", f"vt_telno:{k}", "contacted", noon) for k in range(4)]
    edges += [("vt_bacnt:fast", "vt_bacnt:x", "transferred_to", noon + i * timedelta(minutes=6)) for i in range(10)] + [("vt_bacnt:slow", "vt_bacnt:x", "transferred_to", noon + i * timedelta(minutes=7)) for i in range(10)]
    edges += [("vt_psn:9", "vt_ip:n", "seen", datetime(2024, 1, d, 3)) for d in (1, 2, 3)]
    edges += [("vt_psn:7", "vt_ip:7", "used_ip", None), ("vt_psn:7", "vt_bacnt:7", "has_account", None), ("vt_psn:7", "vt_telno:7", "owns_phone", None), ("vt_psn:8", "vt_ip:8", "used_ip", None), ("vt_psn:8", "vt_bacnt:8", "has_account", None)]
    e = spark.createDataFrame(edges, "src string, dst string, label string, ts timestamp")
    v = spark.createDataFrame(sorted({(x, x.split(":")[0]) for row in edges for x in row[:2]}), "v_id string, label string")
    rules = spark.createDataFrame(RULES, "rule string, threshold int, confidence double")
    got = {(r["rule"], r["v_id"], r["other"], r["n"]) for r in inference.infer(v, e, rules).collect()}
    assert got == {
        ("OrganizedCrime", "vt_telno:1", None, 3), ("MoneyLaundering", "vt_bacnt:m", None, 3), ("Accomplice", "vt_psn:1", "vt_psn:2", 5), ("RapidTransfer", "vt_bacnt:fast", None, 10),
        ("NightActivity", "vt_psn:9", None, 3), ("CrossDomainLink", "vt_ip:7", None, 2),
    }
    assert inference.infer(v.filter("v_id <> 'vt_bacnt:m'"), e, rules).filter("rule = 'MoneyLaundering'").count() == 0
    assert inference.infer(v, e.limit(0), rules).count() == 0


def test_edges_need_both_ends(spark):
    """An end is there if a table declares it; an event's own vertex is there unless its key is empty; other labels' keys do not count."""
    df = lambda rows, schema: spark.createDataFrame(rows, schema)
    t = {
        "TB_FIN_BACNT": df([("1", "9", "kim"), ("1", "9", "kim"), ("ATM-1", "9", "")], "BACNT_NO string, BANK_CD string, DPSTR_NM string"),
        "TB_PRSN": df([("kim", "kim"), ("1", "one")], "PRSN_ID string, KORN_FLNM string"),
        "TB_FIN_BACNT_DLNG": df([("t1", "1", "ATM-1", "02", 5), ("t2", "1", "missing", "02", 5), ("", "1", "1", "02", 5), (None, "1", "1", "02", 5)], "DLNG_SN string, BACNT_NO string, TRRC_BACNT_NO string, DLNG_SE_CD string, DLNG_AMT long").selectExpr("*", "current_date() AS DLNG_DT"),
        "TB_INCDNT_PRSN": df([("c1", "kim", "r")], "INCDNT_NO string, PRSN_ID string, ROLE_CD string"),
    }
    v, e = build.build(t)
    assert sorted(r["v_id"] for r in v.collect()) == ["vt_atm:ATM-1", "vt_bacnt:1", "vt_psn:1", "vt_psn:kim", "vt_transfer:t1", "vt_transfer:t2"]
    got = sorted((r["label"], r["src"], r["dst"]) for r in e.collect())
    assert got == [("from_account", "vt_bacnt:1", "vt_transfer:t1"), ("from_account", "vt_bacnt:1", "vt_transfer:t2"), ("has_account", "vt_psn:kim", "vt_bacnt:1"), ("has_account", "vt_psn:kim", "vt_bacnt:1"), ("to_account", "vt_transfer:t1", "vt_atm:ATM-1")]


def test_paths_from_seeds_are_shortest_and_smallest(spark):
    r = random.Random(2)
    edges = [(f"n{r.randint(0, 15):02}", f"n{r.randint(0, 15):02}") for _ in range(22)]
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    want = {}
    for seed in ("n00", "n05"):
        level, seen = {seed: [seed]}, {seed}
        for n in range(1, 5):
            new = {}
            for at, path in level.items():
                for to in near.get(at, ()):
                    if to not in seen:
                        new[to] = min(new.get(to, ["~"]), path + [to])
            level, seen = new, seen | set(new)
            want |= {(seed, b): (n, p) for b, p in new.items()}
    e = spark.createDataFrame([(*x, "l") for x in edges], "src string, dst string, label string")
    got = {(x["a"], x["b"]): (x["hops"], x["path"]) for x in paths.from_seeds(e, spark.createDataFrame([("n00",), ("n05",)], "seed string"), 4).collect()}
    assert got == want and len(want) > 10


def test_nearest_over_many_blocks(spark):
    r = random.Random(3)
    rows = [(i, [r.gauss(0, 1) for _ in range(5)]) for i in range(60)] + [(60, [0.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [text.nearest(df, df.filter("vec_id < 9"), 4, block).collect() for block in ((8192, 16384), (2, 7))]
    key = lambda rows: sorted((x["query_id"], x["rank"], x["vec_id"]) for x in rows)
    assert key(got[0]) == key(got[1]) and len(got[0]) == 36 and all(x["query_id"] != x["vec_id"] for x in got[0])
