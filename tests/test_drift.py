"""Resampled drift, deflated Sharpe ratios, fresh prices and the market's calendar, each against its rule by other means."""

from __future__ import annotations

import hashlib
import math
import random
from datetime import date, datetime, timedelta
from statistics import NormalDist

import duckdb
import numpy as np
import pytest

from tidewell.functions.dialect import Duck, Spark
from tidewell.operators import drift
from tidewell.plans.compose import apply


def relative(spark, v):
    return spark.createDataFrame([(float(x), i, len(v), float(np.mean(v))) for i, x in enumerate(v)], "v double, i long, n long, m double")


@pytest.mark.parametrize("n,draws,block,direction", [(10_000, 1000, 21, "outperform"), (300, 400, 21, "underperform"), (25, 50, 7, "outperform"), (5, 20, 21, "outperform"), (1, 3, 21, "outperform")])
def test_bootstrap_equals_numpy_on_the_same_starts(spark, n, draws, block, direction):
    rng = np.random.default_rng(n)
    v = rng.normal(0.0002, 0.01, n)
    starts = np.array([[int(hashlib.md5(f"7 {b} {k}".encode()).hexdigest()[:12], 16) % n for k in range(-(-n // block))] for b in range(1, draws + 1)])
    pos = (starts[:, :, None] + np.arange(block)) % n
    means = (v - v.mean())[pos].reshape(draws, -1)[:, :n].mean(axis=1)
    made = apply(spark, "block_means", {"relative_rows": relative(spark, v)}, draws=draws, block=block)
    got = {r.b: r.mean for r in made.collect()}
    assert len(got) == draws and all(abs(got[b + 1] - m) < 1e-12 for b, m in enumerate(means))
    one = apply(spark, "block_bootstrap", {"block_means": made}, direction=direction).first()
    hits = means >= v.mean() if direction == "outperform" else means <= v.mean()
    assert (one.n, one.draws) == (n, draws) and one.p == pytest.approx(max(hits.mean(), 1 / draws), abs=1e-4)


def test_bootstrap_of_no_rows(spark):
    assert apply(spark, "block_bootstrap", {"relative_rows": spark.createDataFrame([], "v double, i long, n long, m double")}).count() == 0


def test_normal_functions(spark):
    x = [-6, -3.1, -1, -0.2, 0, 0.4, 1.7, 2.5, 5]
    p = [0.0, 1e-9, 0.001, 0.0242, 0.0243, 0.3, 0.5, 0.8, 0.9757, 0.9758, 0.99999, 1.0]
    for d, ask in ((Spark(), lambda q: [tuple(r) for r in spark.sql(q).collect()]), (Duck(), lambda q: duckdb.sql(q).fetchall())):
        cdf = dict(ask(f"SELECT x, {d.normal_cdf('x')} FROM (VALUES {', '.join(f'({v}e0)' for v in x)}) AS t(x)"))
        inv = dict(ask(f"SELECT p, {d.normal_inv('p')} FROM (VALUES {', '.join(f'({v!r}e0)' if 'e' not in repr(v) else f'({v!r})' for v in p)}) AS t(p)"))
        assert all(abs(cdf[v] - NormalDist().cdf(v)) < 2e-7 for v in x)
        assert inv[0.0] is None and inv[1.0] is None
        assert all(inv[v] == pytest.approx(NormalDist().inv_cdf(v), rel=1e-8, abs=1e-8) for v in p if 0 < v < 1)
    assert Spark().digest("'a'") != Duck().digest("'a'")
    assert spark.sql(f"SELECT {Spark().digest(repr('a b'))} AS x").first().x == duckdb.sql(f"SELECT {Duck().digest(repr('a b'))}").fetchall()[0][0] == int(hashlib.md5(b"a b").hexdigest()[:12], 16)


def test_deflated_sharpe_of_every_trial(spark):
    rng = random.Random(4)
    rows = [(o, k, f"s{k}", rng.choice([20, 29, 30, 400, 2500]), rng.gauss(0.03, 0.05), rng.gauss(0, 1), rng.uniform(1, 9), o * 3) for o in range(3) for k in range(1, 71)]
    rows += [(7, 1, "alone", 500, 0.1, 0.0, 3.0, 0), (8, 1, "wild", 500, 0.9, 3.0, 1.2, 0)]
    got = {(r.owner, r.seq): r for r in apply(spark, "deflated_sharpe", {"trial_rows": spark.createDataFrame(rows, "owner long, seq long, statement string, t long, sr double, skew double, kurt double, extra long")}).collect()}
    z = NormalDist()
    assert len(got) == len(rows)
    for o, k, _, t, sr, skew, kurt, extra in rows:
        ledger = [round(r[4], 4) for r in rows if r[0] == o and k - 50 < r[1] <= k]
        n = len(ledger) + extra
        v = np.var(ledger, ddof=1) if len(ledger) > 1 else (1 + sr * sr / 2) / max(t, 2)
        star = math.sqrt(max(v, 1e-12)) * ((1 - drift.EULER) * z.inv_cdf(1 - 1 / n) + drift.EULER * z.inv_cdf(1 - 1 / (n * math.e))) if n > 1 else 0.0
        left = 1 - skew * sr + (kurt - 1) / 4 * sr * sr
        r = got[o, k]
        assert (r.trials, r.sharpe) == (n, pytest.approx(sr, abs=1e-4))
        assert r.luckiest is None if t < 30 else r.luckiest == pytest.approx(star, abs=6e-4)
        assert r.probability is None if t < 30 or left <= 0 else r.probability == pytest.approx(z.cdf((sr - star) * math.sqrt(t - 1) / math.sqrt(left)), abs=6e-4)
    assert got[8, 1].probability is None and got[7, 1].luckiest == 0
    none = apply(spark, "deflated_sharpe", {"trial_rows": spark.createDataFrame([], "owner long, seq long, statement string, t long, sr double, skew double, kurt double, extra long")})
    assert none.count() == 0


def test_only_fresh_trades_have_a_price(spark):
    now = datetime(2024, 5, 3, 20)
    at = lambda s: now - timedelta(seconds=s)
    rows = [(1, "A", at(599), 5.0), (2, "A", at(700), 4.0), (3, "B", at(600), 7.0), (4, "C", at(600.5), 8.0), (5, "D", at(0), 9.0), (6, "D", at(0), 10.0), (7, "D", at(30), 99.0), (8, "E", at(3), None), (9, "E", at(5000), 2.0), (99, "F", at(90_000), 1.0)]
    e = spark.createDataFrame(rows, "event_id long, event_type string, ts timestamp_ntz, value double")
    got = {r.symbol: (r.ts, r.price) for r in apply(spark, "latest_prices", {"events": e}).collect()}
    assert got == {"A": (at(599), 5.0), "B": (at(600), 7.0), "D": (at(0), 10.0)}


#: Weekdays on which the exchange did not open, and, by a rule of this engine, the day after Thanksgiving.
CLOSED = {
    1996: "01-01 02-19 04-05 05-27 07-04 09-02 11-28 11-29 12-25",
    1997: "01-01 02-17 03-28 05-26 07-04 09-01 11-27 11-28 12-25",
    1998: "01-01 01-19 02-16 04-10 05-25 07-03 09-07 11-26 11-27 12-25",
    2000: "01-17 02-21 04-21 05-29 07-04 09-04 11-23 11-24 12-25",
    2021: "01-01 01-18 02-15 04-02 05-31 07-05 09-06 11-25 11-26 12-24",
    2022: "01-17 02-21 04-15 05-30 06-20 07-04 09-05 11-24 11-25 12-26",
    2023: "01-02 01-16 02-20 04-07 05-29 06-19 07-04 09-04 11-23 11-24 12-25",
    2024: "01-01 01-15 02-19 03-29 05-27 06-19 07-04 09-02 11-28 11-29 12-25",
    2026: "01-01 01-19 02-16 04-03 05-25 06-19 07-03 09-07 11-26 11-27 12-25",
}


def test_market_calendar_by_a_dated_list(spark):
    days = [date(y, 1, 1) + timedelta(days=k) for y in CLOSED for k in range(366) if (date(y, 1, 1) + timedelta(days=k)).year == y]
    got = {r.day: r.status for r in apply(spark, "open_days", {"bench_close": spark.createDataFrame([(x, 1.0) for x in days], "day date, close double")}).collect()}
    closed = {date.fromisoformat(f"{y}-{md}") for y, of in CLOSED.items() for md in of.split()}
    for x in days:
        assert got[x] == ("weekend" if x.weekday() >= 5 else "holiday" if x in closed else "open"), x
    assert got[date(1996, 4, 5)] == "holiday" and got[date(1996, 6, 19)] == "open" and len(got) == len(days)


def test_easter(spark):
    from tidewell.operators.calendar import easter

    days = {1818: "03-22", 1943: "04-25", 1954: "04-18", 1961: "04-02", 1981: "04-19", 1999: "04-04", 2000: "04-23", 2008: "03-23", 2019: "04-21", 2038: "04-25", 2049: "04-18", 2285: "03-22"}
    years = " UNION ALL ".join(f"SELECT CAST({y} AS BIGINT) AS year" for y in days)
    want = {y: date.fromisoformat(f"{y}-{md}") for y, md in days.items()}
    assert {r.year: r.easter for r in spark.sql(easter(Spark(), years)).collect()} == want
    assert dict(duckdb.sql(easter(Duck(), years)).fetchall()) == want
