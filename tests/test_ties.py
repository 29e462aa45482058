"""Prices that equal their mean: the same in both engines, whatever the order of a sum."""

from __future__ import annotations

from datetime import date, timedelta

import duckdb
import pytest

from tidewell import operators  # noqa: F401
from tidewell.plans.compose import DUCK, apply, compose


@pytest.mark.parametrize("name", ["atr_zone", "breadth", "regimes"])
def test_price_that_equals_its_mean(spark, name):
    """Each price stays: it isn't above its mean of 50 rows, and in the zone below it."""
    rows = [(f"s{k}", date(2020, 1, 1) + timedelta(days=n), *[p] * 4, 1.0) for k in range(40) for n in range(60) for p in [round(97.1234 + 0.3571 * k, 4)]]
    df = spark.createDataFrame(rows, "symbol string, day date, open double, high double, low double, close double, volume double")
    got = apply(spark, name, {"bars": df}).toPandas()
    given = df.toPandas()  # noqa: F841  DuckDB reads it
    want = duckdb.sql(compose(name, DUCK, {"bars": "SELECT symbol, CAST(day AS DATE) AS day, open, high, low, close, volume FROM given"})).fetchall()
    assert len(got) == len(want) > 0
    if name == "atr_zone":
        assert got["in_zone"].all() and all(r[3] for r in want)
    elif name == "breadth":
        assert (got["share"] == 0).all() and all(r[1] == 0 for r in want)
    else:
        assert set(got["regime"].dropna()) == {"neutral"} == {r[2] for r in want if r[2]}
