"""Calibrated scores, the states of market and economy, figures of companies, feeds: against plain Python."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta, timezone

import duckdb
import pytest
from pyspark.sql import functions as F

from tests.test_keyed import replayed, streamed
from tidewell.operators import backtest
from tidewell.plans.compose import DUCK, SPARK, apply
from tidewell.sources import parsers
from tidewell.streaming import judgements


def test_calibrated_score(spark):
    rng = random.Random(5)
    parts, base = ["trend", "macd", "momentum", "rsi", "bollinger"], [0.35, 0.25, 0.20, 0.10, 0.10]
    rows = [(f"s{k}", date(2024, 5, 3), *[round(rng.uniform(-1, 1) if k % 4 else 0.09, 3) for _ in parts], rng.choice([None, 0.4, 1.6, 9.0])) for k in range(60)]
    multiplier = {(r[0], p): rng.choice([0.5, 0.8, 1.3, 1.5]) for r in rows for p in parts if rng.random() < 0.6}
    weeks = [(r[0], date(2024, 4, 28) + timedelta(days=7 * w), rng.choice([-2, -1, 0, 1, 2, None])) for r in rows if rng.random() < 0.9 for w in range(2)]
    got = {
        r.symbol: r
        for r in apply(
            spark, "calibrated_score",
            {
                "score_parts": spark.createDataFrame(rows, "symbol string, day date, " + ", ".join(f"{p} double" for p in parts) + ", vol_ratio double"),
                "calibration": spark.createDataFrame([(*k, m) for k, m in multiplier.items()], "symbol string, part string, multiplier double"),
                "weekly_bias": spark.createDataFrame(weeks, "symbol string, week date, bias int"),
            },
        ).collect()
    }
    seen = set()
    for s, day, *values, loud in rows:
        w = [b * multiplier.get((s, p), 1.0) for p, b in zip(parts, base)]
        score = sum(a * v for a, v in zip(w, values)) / sum(w)
        if loud and loud > 1.5:
            score *= 1 + min(0.15, (loud - 1.5) * 0.1)
        score = max(-1.0, min(1.0, score))
        week = max(((d, b) for x, d, b in weeks if x == s), key=lambda t: t[0], default=(None, 0))[1] or 0
        factor = 1.0
        if abs(score) > 0.1 and week:
            factor = 1.1 if (score > 0) == (week > 0) else 0.8
        seen.add(factor)
        score = max(-1.0, min(1.0, score * factor))
        rating = "strong_buy" if score >= 0.5 else "buy" if score >= 0.2 else "neutral" if score > -0.2 else "sell" if score > -0.5 else "strong_sell"
        assert (got[s].score, got[s].weekly, got[s].rating) == (pytest.approx(score, abs=6e-4), week, rating)
    assert seen == {0.8, 1.0, 1.1}


def test_every_rule_of_three_layers_is_trend():
    assert backtest.PARTS["triple_confirmation"] == "trend" and set(backtest.PARTS.values()) == {"trend", "macd", "rsi", "bollinger"}


def test_market_regime_and_hard_rules(spark):
    up = [100 * 1.01**k for k in range(80)]
    for closes, want in ((up, "risk_on"), (up[::-1], "risk_off"), (up[:61] + [(sum(up[12:61]) / 49 + up[40]) / 2], "neutral"), (up[:49], None)):
        bench = spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=k), x) for k, x in enumerate(closes)], "day date, close double")
        got = apply(spark, "market_regime", {"bench_close": bench})
        assert [r.regime for r in got.collect()] == [want]
    facts = spark.createDataFrame([("A", "risk_off", 0.9, 0.1, 0.3, 5, 0.3), ("B", "neutral", None, None, None, None, None), ("C", None, 0.8, 0.15, 0.3, 4, 0.25)], "symbol string, regime string, ann_vol double, score double, hit_rate double, decisions long, position double")
    assert {r.symbol: r.rules for r in apply(spark, "hard_rules", {"risk_facts": facts}).collect()} == {"A": "regime,volatility,hit_rate,neutral_score,position", "B": "", "C": ""}


def test_macro_signals(spark):
    d = lambda y, m: date(y, m, 1)
    rows = [("curve", d(2024, 1), 0.5), ("curve", date(2024, 2, 9), 0.1), ("curve", date(2024, 2, 20), -0.01), ("curve", d(2024, 4), 0.19), ("curve", d(2024, 5), None)]
    rows += [("jobless", d(2024, 1), 4.0), ("jobless", d(2024, 3), 4.3), ("jobless", d(2024, 4), 4.4), ("jobless", d(2024, 6), 4.1)]
    rows += [("prices", d(2023 + k // 12, k % 12 + 1), 100 * (1 + 0.002 * k)) for k in range(14)] + [("prices", d(2024, 3), 104.0), ("prices", d(2024, 6), 120.0)]
    got = {r.month: r for r in apply(spark, "macro_regime", {"macro_series": spark.createDataFrame(rows, "series string, day date, value double")}).collect()}
    assert {m: (r.signals, r.risk) for m, r in got.items() if m >= d(2024, 1)} == {
        d(2024, 1): ("", "ok"), d(2024, 2): ("inverted", "caution"), d(2024, 3): ("inverted,joblessness,inflation", "caution") if got[d(2024, 3)].inflation > 3 else ("inverted,joblessness", "caution"),
        d(2024, 4): ("nearly inverted,joblessness" + (",inflation" if got[d(2024, 4)].inflation > 3 else ""), "caution") if 4.4 - 4.3 > 0.1 else ("nearly inverted", "neutral"), d(2024, 6): ("nearly inverted,inflation", "neutral"),
    }
    assert got[d(2024, 6)].inflation == pytest.approx((120.0 / 100.6 - 1) * 100, abs=1e-3) and got[d(2023, 5)].risk == "ok" and got[d(2023, 5)].inflation is None


def test_company_facts(spark):
    none = dict.fromkeys("kind price cap pe roe debt fcf revenue dividend yield_ income equity".split())
    rows = [
        ("info", 1, none | {"price": 0.0, "cap": 5.0, "roe": 0.1, "debt": 120.0, "fcf": 3.0, "revenue": 12.0, "dividend": 2.0, "kind": "EQUITY"}), ("fast", 1, none | {"price": 50.0, "cap": 9.0}), ("backup", 1, none | {"price": 51.0, "pe": 7.0, "roe": 0.3}),
        ("info", 2, none | {"yield_": 0.03, "revenue": 0.0, "fcf": 1.0}), ("statements", 2, none | {"income": 5.0, "equity": 20.0}), ("backup", 2, none | {"price": 8.0, "roe": 0.9}),
        ("info", 3, none | {"kind": "ETF", "price": 4.0, "pe": 9.0}), ("backup", 3, none | {"cap": 77.0, "pe": 8.0}),
        ("info", 4, none | {"yield_": 2.5}), ("statements", 4, none | {"income": 5.0, "equity": 0.0}), ("backup", 5, none | {"roe": 0.2, "yield_": 1.5}),
    ]
    table = spark.createDataFrame([(s, i, *v.values()) for s, i, v in rows], "source string, symbol long, kind string, " + ", ".join(f"{c} double" for c in none if c != "kind"))
    got = {r.symbol: r for r in apply(spark, "company_facts", {"company_sources": table}).collect()}
    f = lambda i: tuple(got[i][c] for c in ("price", "cap", "pe", "roe", "roe_from", "debt_to_equity", "fcf_margin", "dividend_yield", "ok"))
    assert f(1) == (50.0, 5.0, 7.0, 0.1, "info", 1.2, 0.25, 4.0, True)
    assert f(2) == (8.0, None, None, 0.25, "statements", None, None, 3.0, True)
    assert f(3) == (4.0, None, None, None, None, None, None, None, False)
    assert f(4) == (None, None, None, None, None, None, None, 2.5, True) and f(5)[3:5] == (0.2, "backup") and f(5)[7] == 1.5


def test_figures_are_rounded_as_duckdb_rounds_them(spark):
    """Halves by the number times a power of ten, not by the digits it is written with."""
    x = [k / 1000 + 0.0005 for k in range(-2000, 2000)] + [1.005, 2.675, 0.285, -1.005]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in x], "x double").selectExpr(SPARK.r("x", 3)).collect()]
    assert got == [r[0] for r in duckdb.execute("SELECT " + DUCK.r("x", 3) + " FROM (SELECT unnest(?::DOUBLE[]) AS x) q", [x]).fetchall()]


def test_other_layouts_of_fear_and_greed(spark):
    graph = ['{"fear_and_greed": {"score": 41.26, "rating": "fear", "previous_close": 40, "previous_1_week": "38.5"}}', '{"fear_and_greed": {"rating": "x"}}', "{}", "broken"]
    got = parsers.fear_greed_graph(spark.createDataFrame([(g,) for g in graph], "value string")).collect()
    assert [tuple(r) for r in got] == [(41.3, "fear", 40.0, 38.5, None, None)]
    lines = ["date,score,rating", "2024-05-01, 10.04 ,fear", "bad", "2024-05-02,20,fear\r", "2024-05-03,x,fear", "2024-05-04,30", "2024-05-05,40,a", "2024-05-06,50,b", "2024-05-07,60.06,greed"]
    rows = [("a", k, v) for k, v in enumerate(lines)] + [("b", 0, "2024-01-01,5,low"), ("c", 0, "date,score")]
    got = {r.source: tuple(r)[1:] for r in parsers.fear_greed_lines(spark.createDataFrame(rows[::-1], "source string, n int, value string")).collect()}
    assert got == {"a": (60.1, "greed", 50.0, 10.0), "b": (5.0, "low", None, None)}


def test_regime_of_a_score(spark):
    scores = [50, 57, 60, 57, 55, 54.9, 57, 43, 40, 43, 45, 45.1, 43, None, 10, 44, 99]
    want, before = [], None
    for s in scores:
        if s is not None:
            before = "risk_on" if s >= (55 if before == "risk_on" else 60) else "risk_off" if s <= (45 if before == "risk_off" else 40) else "neutral"
            want.append((s, before))
    schema, t0 = "market string, ts timestamp, score double", datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(m, t0 + timedelta(days=k), None if s is None else float(s)) for m in "xy" for k, s in enumerate(scores)]
    batch = replayed(spark, rows, schema, ["market"], judgements.Regime())
    assert [(r[2], r[3]) for r in sorted(batch) if r[0] == "x"] == want
    assert sorted(streamed(spark, rows, schema, ["market"], judgements.Regime(), 4)) == sorted(batch)
    assert spark.createDataFrame(rows, schema).where(F.col("score").isNull()).count() == 2
