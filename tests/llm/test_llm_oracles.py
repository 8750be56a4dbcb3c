"""The training-data queries that SQL can say, against their SQL in DuckDB."""

import duckdb
import pytest

from ledgerloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_oracle(spark, name):
    db = duckdb.connect()
    for t in ("documents", "conversations", "labels"):
        db.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    rows = QUERIES[name](spark, SF)
    columns = sorted(rows.columns)
    out = db.sql(ORACLES[name])
    assert sorted(out.columns) == columns
    got = sorted(tuple(r) for r in rows.select(*columns).collect())
    assert got == sorted(out.project(", ".join(f'"{c}"' for c in columns)).fetchall()) and got
