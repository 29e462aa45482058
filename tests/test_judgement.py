"""Scores, regimes and rules against plain Python, written from their definitions."""

from __future__ import annotations

import math
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest

from tests.test_semantics import panel
from tidewell import registry
from tidewell.plans import stateful  # noqa: F401
from tidewell.plans.compose import apply

COMPANY = "symbol long, roe double, net_margin double, revenue_growth double, earnings_growth double, debt_to_equity double, current_ratio double, fcf double, fcf_margin double, pe double, peg double, pb double, ev_ebitda double"
COMPANIES = [
    (1, 0.25, 0.22, 0.25, 0.3, 0.3, 2.5, 5e9, 0.2, 9.0, 0.8, 1.0, 8.0),
    (2, 0.16, 0.12, None, 0.06, None, 1.2, None, 0.05, 22.0, None, 3.0, None),
    (3, -0.1, -0.2, -0.1, -0.3, 3.0, 0.3, -1.0, -0.1, 80.0, 5.0, 9.0, 30.0),
    (4, *[None] * 12),
    (5, 0.15, 0.05, 0.0, 0.1, 1.0, 2.0, 0.0, 0.0001, 15.0, 1.5, 4.0, 18.0),
]


def points(v, limits, reverse=False):
    if v is None:
        return None
    return next((p for t, p in limits if (v <= t if reverse else v >= t)), 0.0)


def health(c):
    _, roe, nm, rg, eg, de, cr, fcf, fm, pe, peg, *_ = c
    grow = [(0.20, 10), (0.10, 7.5), (0.05, 5), (0.0001, 2.5)]
    parts = [
        [(points(roe, [(0.20, 12), (0.15, 9.6), (0.10, 7.2), (0.05, 4.8), (0.0001, 2.4)]), 12), (points(nm, [(0.20, 8), (0.10, 6), (0.05, 4), (0.0001, 2)]), 8)],
        [(points(rg, grow), 10), (points(eg, grow), 10)],
        [(points(de, [(0.5, 10), (1.0, 7.5), (1.5, 5), (2.5, 2.5)], True), 10), (points(cr, [(2.0, 10), (1.5, 8), (1.0, 5), (0.5, 2)]), 10)],
        [(None if fcf is None else 12.0 if fcf > 0 else 0.0, 12), (points(fm, [(0.15, 8), (0.08, 6), (0.03, 4), (0.0001, 2)]), 8)],
        [(points(pe, [(10, 10), (15, 8), (25, 6), (40, 3)], True), 10), (points(peg, [(1.0, 10), (1.5, 7), (2.0, 4), (3.0, 2)], True), 10)],
    ]
    known = [x for p in parts for x in p if x[0] is not None]
    full = sum(m for _, m in known)
    return round(100 * sum(g for g, _ in known) / full, 1) if full else None, sum(any(g is not None for g, _ in p) for p in parts)


def test_health_score(spark):
    table = spark.createDataFrame(COMPANIES, COMPANY)
    got = {r.symbol: r for r in apply(spark, "health_score", {"fundamentals": table}).collect()}
    for c in COMPANIES:
        score, covered = health(c)
        r = got[c[0]]
        assert (r.score, r.covered) == (pytest.approx(score, abs=0.051) if score is not None else None, covered)
        assert r.rating == ("none" if score is None else "excellent" if score >= 75 else "good" if score >= 55 else "fair" if score >= 40 else "weak")
    flags = {r.symbol: (r.pe, r.pb, r.peg, r.ev_ebitda) for r in apply(spark, "valuation_flags", {"fundamentals": table}).collect()}
    assert flags[1] == ("cheap", "cheap", "cheap", "cheap") and flags[3] == ("dear",) * 4 and flags[4] == ("na",) * 4 and flags[5] == ("fair", "fair", "fair", "fair")


def test_weather_needs_three_parts_and_counts_missing_ones_neutral(spark):
    rows = [(date(2024, 1, 1), 80.0, 100.0, None, 20.0, None), (date(2024, 1, 2), 80.0, None, None, 20.0, None), (date(2024, 1, 3), 10.0, 20.0, 30.0, 40.0, 50.0)]
    table = spark.createDataFrame(rows, "day date, breadth double, credit double, vix_ts double, yield_curve double, copper_gold double")
    got = {r.day.day: r.score for r in apply(spark, "weather", {"weather_parts": table}).collect()}
    assert got == {1: round(0.3 * 80 + 0.25 * 100 + 0.2 * 50 + 0.15 * 20 + 0.1 * 50, 1), 2: None, 3: round(3 + 5 + 6 + 6 + 5, 1)}


def test_weather_parts(spark):
    n = 60
    rng = np.random.default_rng(3)
    a = pd.DataFrame({"day": [date(2024, 1, 1) + timedelta(days=k) for k in range(n)], **{c: rng.uniform(lo, hi, n) for c, lo, hi in (("hyg", 75, 80), ("lqd", 105, 110), ("vix", 12, 30), ("vix3m", 14, 30), ("tnx", 3, 5), ("irx", 3, 5), ("copper", 3, 5), ("gold", 1900, 2100))}})
    breadth = a[["day"]].assign(share=rng.uniform(0, 1, n))
    a.loc[55, ["hyg", "gold"]] = None
    frames = {"cross_assets": spark.createDataFrame([tuple(None if x != x else x for x in r) for r in a.itertuples(index=False)], "day date, " + ", ".join(f"{c} double" for c in a.columns[1:])), "breadth": spark.createDataFrame(breadth)}
    got = {r.day: r for r in apply(spark, "weather_parts", frames).collect()}
    linear = lambda x, low, high: min(1, max(0, (x - low) / (high - low))) * 100
    for k in range(n):
        r, upto = got[a.day[k]], a.iloc[: k + 1]
        ratio, metals = (upto.hyg / upto.lqd).dropna(), (upto.copper / upto.gold).dropna()
        want = [breadth.share[k] * 100, linear(ratio.iloc[-1] / ratio.iloc[-50:].mean() - 1, -0.02, 0.02) if len(ratio) >= 50 else None, linear(a.vix3m[k] / a.vix[k], 0.95, 1.15), linear(a.tnx[k] - a.irx[k], -0.5, 1.5), linear(metals.iloc[-1] / metals.iloc[-21] - 1, -0.08, 0.08) if len(metals) >= 21 else None]
        assert [r.breadth, r.credit, r.vix_ts, r.yield_curve, r.copper_gold] == [None if w is None else pytest.approx(w, abs=0.051) for w in want]


def test_regime_leaves_only_beyond_five(spark, tmp_path):
    scores = [66, 60.3, 58, 48, 42, 41.5, 47, 49.5, 64.5, 31, 42, 47.2, 66, 61]
    mean = sum(scores) / len(scores)
    from datetime import datetime

    rows = [(k, datetime(2024, 1, 1) + timedelta(days=k), 1, "click", 50 + (s - mean) / 4, "{}") for k, s in enumerate(scores)]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
    state, want = None, []
    for s in (50 + x - mean for x in scores):  # the query centres its scores
        on, off = 60 - 5 * (state == "risk_on"), 40 + 5 * (state == "risk_off")
        state = "risk_on" if s >= on else "risk_off" if s <= off else "neutral"
        want.append(state)
    got = [r.regime for r in registry.queries()["regime_hysteresis"](spark, str(tmp_path)).orderBy("day").collect()]
    assert got == want and set(got) == {"risk_on", "risk_off", "neutral"}


def test_options(spark):
    rows = [("A", 1.0, 0.3, 0.24), ("B", 0.5, 0.2, 0.2), ("C", None, 0.2, 0.3), ("D", None, None, 0.3), ("E", 2.0, None, None)]
    table = spark.createDataFrame([(s, p, p, c, q) for s, p, q, c in rows], "symbol string, pcr_volume double, pcr_oi double, call_iv double, put_iv double")
    got = {r.symbol: r for r in apply(spark, "options_summary", {"option_totals": table}).collect()}
    clamp = lambda x: max(-1.0, min(1.0, x))
    for s, pcr, put, call in rows:
        parts = ([(0.6, clamp((1 - pcr) / 0.5))] if pcr is not None else []) + ([(0.4, clamp(-(put - call) / 0.05))] if put is not None and call is not None else [])
        want = sum(w * x for w, x in parts) / sum(w for w, _ in parts) if parts else None
        assert got[s].sentiment == (None if want is None else pytest.approx(want, abs=0.0051))
        assert got[s].label == ("none" if want is None else "bullish" if want >= 0.3 else "bearish" if want <= -0.3 else "neutral")
    assert got["A"].atm_iv == pytest.approx(0.27) and got["D"].atm_iv == pytest.approx(0.3) and got["E"].atm_iv is None


def test_insiders(spark):
    day = date(2024, 5, 1)
    rows = [(1, day, 1, "P", "A", 10.0, 5.0), (1, day, 2, "P", "A", 1.0, 5.0), (1, day, 3, "S", "D", 5.0, 5.0), (2, day, 1, "S", "D", 5.0, 5.0), (3, day, 1, "P", "A", 5.0, None), (4, day, 1, "M", "A", 5.0, 1.0), (5, day, 1, "P", "A", 1.0, 1.0), (5, day, 2, "S", "D", 4.0, 1.0), (5, day - timedelta(days=500), 3, "P", "A", 900.0, 1.0)]
    table = spark.createDataFrame(rows, "symbol long, day date, owner long, code string, ad string, shares double, price double")
    got = {r.symbol: (r.buys, r.sells, r.buyers, r.score, r.label) for r in apply(spark, "insider_summary", {"insider": table}).collect()}
    assert got == {1: (2, 1, 2, round(30 / 80, 2), "cluster_buy"), 2: (0, 1, 0, -0.3, "weak_sell"), 3: (1, 0, 1, 1.0, "buy"), 4: (0, 0, 0, None, "none"), 5: (2, 1, 2, round(897 / 905, 2), "cluster_buy")}
    recent = {r.symbol: (r.score, r.label) for r in apply(spark, "insider_window", {"insider": table}).collect()}
    assert recent[5] == (-0.6, "sell") and recent[2] == (-0.3, "weak_sell")


def test_overlays_and_rules(spark):
    rows = [("A", 0.4, 1.0, True, 0.5, 0.2, 2), ("B", 0.4, None, None, None, None, None), ("C", -0.2, -0.3, False, -1.0, 0.3, 9), ("D", 0.1, 0.5, True, 1.0, 0.0, -1)]
    table = spark.createDataFrame(rows, "symbol string, score double, insider_score double, cluster boolean, opt_score double, short_pct double, to_earnings int")
    got = {r.symbol: (r.delta, r.no_entry, r.adjusted) for r in apply(spark, "overlays", {"overlay_inputs": table}).collect()}
    assert got == {"A": (0.15, True, 0.55), "B": (0.0, False, 0.4), "C": (-0.15, False, -0.35), "D": (0.15, False, 0.25)}
    fg = spark.createDataFrame([(date(2024, 1, k), a, b) for k, a, b in ((1, 80.0, 76.0), (2, 20.0, 24.0), (3, 80.0, 75.0), (4, None, 90.0))], "day date, stocks double, crypto double")
    got = {r.day.day: (r.both_fear, r.both_greed, r.size) for r in apply(spark, "account_overlay", {"fear_greed": fg}).collect()}
    assert got == {1: (False, True, 0.5), 2: (True, False, 1.0), 3: (False, False, 1.0), 4: (False, False, 1.0)}
    facts = spark.createDataFrame([("A", "risk_off", 0.9, 0.1, 0.3, 6, 0.3), ("B", "neutral", 0.8, 0.15, 0.3, 4, 0.25), ("C", None, None, None, None, None, None)], "symbol string, regime string, ann_vol double, score double, hit_rate double, decisions long, position double")
    got = {r.symbol: r.rules for r in apply(spark, "hard_rules", {"risk_facts": facts}).collect()}
    assert got == {"A": "regime,volatility,hit_rate,neutral_score,position", "B": "", "C": ""}


def test_dcf(spark):
    rows = [(1, 1000.0, 0.1, 0.2, 500.0, 100.0, 0.09), (2, 1000.0, 0.0, 0.05, 5000.0, 100.0, 0.08), (3, 1000.0, 0.05, 0.3, 0.0, 0.0, 0.02)]
    table = spark.createDataFrame(rows, "symbol long, revenue double, growth double, margin double, net_debt double, shares double, wacc double")
    got = {r.symbol: r for r in apply(spark, "dcf_value", {"dcf_inputs": table}).collect()}
    grid = {(r.symbol, r.dr, r.tg): r.value for r in apply(spark, "dcf_grid", {"dcf_inputs": table}).collect()}

    def value(c, dr, tg):
        _, revenue, g, m, debt, shares, _ = c
        before, flows = revenue, []
        for _ in range(5):
            now = before * (1 + g)
            flows.append(now * m * 0.79 + now * 0.04 - now * 0.05 - (now - before) * 0.01)
            before = now
        pv = sum(f / (1 + dr) ** (t + 0.5) for t, f in enumerate(flows))
        after = flows[-1] * (1 + tg) / (dr - tg) / (1 + dr) ** 4.5
        return pv + after, pv + after - debt, after / (pv + after), (pv + after - debt) / shares if shares else None

    for c in rows[:2]:
        ev, equity, late, per = value(c, c[6], 0.025)
        assert (got[c[0]].ev, got[c[0]].equity, got[c[0]].tv_share, got[c[0]].per_share) == pytest.approx((ev, equity, late, per), abs=6e-3)
        assert got[c[0]].warnings == ",".join(x for x in ("late" if late > 0.75 else "early" if late < 0.4 else "", "debt" if equity <= 0 else "") if x)
    assert 3 not in got  # growth isn't below the cost
    for (s, dr, tg), v in grid.items():
        c = rows[s - 1]
        assert v == (pytest.approx(value(c, dr, tg)[3], abs=1e-3) if tg < dr and c[5] else None)


def test_momentum_confound_equals_least_squares(spark):
    rng = np.random.default_rng(11)
    n = 400
    x, z = rng.normal(0.0003, 0.01, n), rng.normal(0.0004, 0.012, n)
    y = 0.0002 + 0.8 * x + 0.5 * z + rng.normal(0, 0.004, n)
    days = [date(2022, 1, 1) + timedelta(days=k) for k in range(n)]
    level = lambda r: 100 * np.exp(np.cumsum(r))
    aligned = spark.createDataFrame(pd.DataFrame({"day": days, "i": range(n), "n": n, "b": level(y), "m": level(x)}))
    factor = spark.createDataFrame(pd.DataFrame({"day": days, "close": level(z)}))
    got = apply(spark, "momentum_confound", {"aligned": aligned, "momentum_close": factor}).first()

    def alpha(*columns):
        a = np.column_stack([np.ones(n - 1), *[c[1:] for c in columns]])
        beta = np.linalg.lstsq(a, y[1:], rcond=None)[0]
        s2 = ((y[1:] - a @ beta) ** 2).sum() / (n - 1 - a.shape[1])
        return beta[0], beta[0] / math.sqrt((s2 * np.linalg.inv(a.T @ a))[0, 0])

    (a1, t1), (a2, t2) = alpha(x), alpha(x, z)
    assert (got.n, got.alpha_one, got.t_one, got.alpha, got.t) == pytest.approx((n - 1, a1 * 252, t1, a2 * 252, t2), abs=1e-4)
    assert got.survived == (a2 > 0 and t2 > 1)


def test_kupiec_and_brackets(spark):
    p = spark.createDataFrame([(date(2024, 1, 1) + timedelta(days=k), -0.05 if k % 12 == 0 else 0.01) for k in range(240)], "day date, r double")
    v = p.selectExpr("day", "-0.02D as var_")
    got = apply(spark, "kupiec", {"portfolio": p, "rolling_var": v}).first()
    lr = -2 * (220 * math.log(0.95) + 20 * math.log(0.05) - 220 * math.log(220 / 240) - 20 * math.log(20 / 240))
    assert (got.n, got.x, got.lr, got.p_value) == pytest.approx((240, 20, lr, math.erfc(math.sqrt(lr / 2))), abs=1e-4)
    j = spark.createDataFrame([(k, "A", date(2024, 1, 1), "buy", q, None, x) for k, q, x in ((1, 5, 10.25), (2, 5, 0.0501), (3, 0, 10.0), (4, 5, 0.1), (5, 5, None), (6, 1, 12.75))], "event long, symbol string, day date, side string, qty long, mechanism string, price double")
    got = {r.event: (r.limit_, r.stop, r.target, r.reject) for r in apply(spark, "brackets", {"journal": j}).collect()}
    assert got[1] == (10.25, 10.04, 10.66, None) and got[6] == (12.75, 12.5, 13.26, None) and got[3][3] == "qty" and got[5][3] == "price" and got[2][3] == "stop" and got[4][:3] == (0.1, 0.098, 0.104)


def test_theses(spark):
    frame = panel(60, ("A", "B"), 3)
    low, high = frame.groupby("symbol").close.min(), frame.groupby("symbol").close.max()
    rows = [("A", "long", "active", date(2020, 1, 5), float(low["A"]), float(high["A"]), date(2020, 1, 1)), ("B", "short", "active", date(2019, 10, 1), float(high["B"]), float(low["B"]), date(2020, 1, 1)), ("C", "long", "closed", date(2019, 1, 1), 1.0, 2.0, date(2020, 1, 1))]
    t = spark.createDataFrame(rows, "symbol string, direction string, status string, updated date, stop double, target double, set_on date")
    got = {r.symbol: (r.stopped, r.reached) for r in apply(spark, "thesis_triggers", {"theses": t, "bars": spark.createDataFrame(frame)}).collect()}
    at = lambda s, f: frame[frame.symbol == s].set_index("day").close.agg(f)
    assert got == {"A": (at("A", "idxmin"), at("A", "idxmax")), "B": (at("B", "idxmax"), at("B", "idxmin"))}
    stale = apply(spark, "stale_theses", {"theses": t, "bench_close": spark.createDataFrame([(date(2020, 1, 1), 1.0)], "day date, close double")}).collect()
    assert [(r.symbol, r.age) for r in stale] == [("B", 92)]
