"""Every query of the library against its SQL in DuckDB, on the smallest tables."""

import math

import duckdb
import pytest

from ledgerloom.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return str(int(v)) if isinstance(v, float) and v == int(v) else str(v)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_oracle(spark, db, name):
    rows = QUERIES[name](spark, SF)
    cols = sorted(rows.columns)
    got = sorted(tuple(plain(v) for v in r) for r in rows.select(*cols).collect())
    out = db.sql(ORACLES[name])
    assert sorted(out.columns) == cols
    want = sorted(tuple(plain(v) for v in r) for r in out.project(", ".join(f'"{c}"' for c in cols)).fetchall())
    assert got == want
