"""Every query that SQL expresses against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from tidewell import operators, registry  # noqa: F401
from tidewell.plans import stateful  # noqa: F401
from tidewell.plans.compose import TABLES

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return ""
        if isinstance(x, bool) or type(x).__name__ == "bool_":
            return str(bool(x))
        if isinstance(x, (int, float)) or hasattr(x, "dtype") and x.dtype.kind in "if":
            return f"{float(x):.4e}" if x else "0"
        return str(x)[:19].removesuffix(" 00:00:00")

    df = df[sorted(df.columns)]
    return sorted(tuple(map(plain, r)) for r in df.itertuples(index=False, name=None))


def close(a: str, b: str) -> bool:
    try:
        return a == b or abs(float(a) - float(b)) <= 2e-4 * (1 + abs(float(b)))
    except ValueError:
        return False


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, sf, duck, name):
    got = registry.queries()[name](spark, sf).toPandas()
    want = duck.execute(ORACLES[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    assert all(close(x, y) for r, s in zip(a, b) for x, y in zip(r, s)), next((r, s) for r, s in zip(a, b) if not all(map(close, r, s)))
