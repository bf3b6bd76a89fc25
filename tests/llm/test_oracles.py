"""The text operators that SQL can express against DuckDB on the smallest tables."""

import os

import pytest

from caseloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def normal(v):
    return f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES, key=lambda n: int(n[2:].split("_")[0])))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(tuple(map(normal, r)) for r in df.select(*columns).collect())
    out = duck.execute(ORACLES[name])
    names = [x[0] for x in out.description]
    assert sorted(names) == columns and len(got) > 0
    assert got == sorted(tuple(normal(r[names.index(c)]) for c in columns) for r in out.fetchall())
