"""Every query against its SQL at the smallest size."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from doclake.plans.queries import QUERIES, SQL


def rows(df: pd.DataFrame) -> list[tuple[str, ...]]:
    def cell(v: object) -> str:
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "~"
        return f"{v:.9g}" if isinstance(v, float) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf).toPandas()
    want = duck.sql(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) > 0
    assert rows(got) == rows(want)
