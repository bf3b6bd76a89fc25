"""A cross-section of the registered queries against DuckDB on the smallest tables."""

import os

import pytest

from caseloom.plans import catalog

SF = "/root/testdata/sf0.001"
NAMES = (
    "a2_label_counts", "a4_degrees", "a9_mule_accounts", "a19_amount_into_accounts", "j16_chains", "j18_interval_join", "w3_first_write_last_props", "w6_rapid_transfers", "u5_upsert_coalesce", "u9_detach_delete",
    "p1_keyword_search", "f18_domains", "r10_pattern_scores", "r11_evidence_checklist", "r14_readiness", "r16_alerts", "r23_indirect_transfer", "g10_edge_counts", "g18_shortest_paths", "g25_components", "g28_circular_transfers",
    "s4_wide_file_load", "x1_fixed_chunks", "x4_nearest_vectors", "m1_rapid_stream", "m3_cash_out_stream", "m5_incremental_load", "r15_case_context", "g14_mapped_load",
    "g19_path_edges", "g27_money_trail_steps", "g28_cycles", "p1_search_around", "p2_search_matches", "r31_repointed_edges", "p12_rejected_rows", "x1_chunks", "d1_inference", "m4_mule_stream", "s3_predefined_loads", "x5_delete_chunks",
)

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def normal(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(normal, r)) for r in df.select(*columns).collect())
    out = duck.execute(catalog.ORACLES[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(normal(r[names.index(c)]) for c in columns) for r in out.fetchall())
