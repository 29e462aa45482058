"""The day plan against a loop over sessions, written from the rules."""

from __future__ import annotations

import itertools
from collections import defaultdict

import numpy as np
import pandas as pd
import pytest

from tests.test_semantics import panel
from tidewell.plans.compose import apply

KEYS = list(itertools.product((15, 30, 45), (1.0, 1.5, 2.0), (1.5, 2.0, 2.5)))


@pytest.fixture(scope="module")
def market(spark):
    """Daily and intraday bars of three symbols; one has a short session, one a day without bars."""
    daily = panel(200, ("A", "B", "C"), 5)
    rng, rows = np.random.default_rng(6), []
    for r in daily.itertuples():
        n = 7 if r.symbol == "B" and r.day.day == 9 else 13
        if r.symbol == "C" and r.day.day == 20:
            continue
        px = r.close * np.exp(np.cumsum(rng.normal(0.001, 0.009, n + 1)))
        for k in range(n):
            wide = abs(rng.normal(0, 0.002, 2))
            rows.append((r.symbol, r.day, k + 1, px[k], max(px[k : k + 2]) * (1 + wide[0]), min(px[k : k + 2]) * (1 - wide[1]), px[k + 1], float(rng.integers(0, 120))))
    intra = pd.DataFrame(rows, columns=["symbol", "session", "k", "open", "high", "low", "close", "volume"])
    intra["k"] = intra["k"].astype("int64")
    intra["minute"], intra["step"] = (intra["k"] - 1) * 30.0, 30.0
    return daily, intra, {"bars": spark.createDataFrame(daily), "bars_intra": spark.createDataFrame(intra)}


def gate(c):
    d, line = c.diff(), c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    gain, loss = (x.clip(lower=0).ewm(alpha=1 / 14, min_periods=14).mean().iloc[-1] for x in (d, -d))
    rsi = 100 - 100 / (1 + gain / loss)
    ma20, ma50 = c.iloc[-20:].mean(), c.iloc[-50:].mean()
    score = sum(1 if yes else -1 for yes in (ma20 > ma50, c.iloc[-1] > ma20, (line - line.ewm(span=9, adjust=False).mean()).iloc[-1] > 0)) - (rsi >= 75) + (rsi <= 30)
    return "bullish" if score >= 2 else "neutral" if score >= 0 else "bearish", score


def session(bars, before, bias, orb, stop_m, rr):
    """One session bar by bar: the first ticket, its fill and its exit."""
    if len(bars) < 8 or len(before) < 60:
        return None
    tr = pd.concat([before.high - before.low, (before.high - before.close.shift()).abs(), (before.low - before.close.shift()).abs()], axis=1).max(axis=1)
    atr, vol20, prev = tr.iloc[-14:].mean(), before.volume.iloc[-20:].mean(), before.close.iloc[-1]
    o, h, low, c, v = (bars[x].to_numpy() for x in ("open", "high", "low", "close", "volume"))
    for i in range(3, len(bars) - 1, 3):
        last, n = c[i], max(1, round(orb / 30))
        total = v[: i + 1].sum()
        vwap = ((h + low + c)[: i + 1] / 3 * v[: i + 1]).sum() / total if total > 0 else last
        top, floor_ = h[: min(n, i + 1)].max(), low[: min(n, i + 1)].min()
        gap = (o[0] / prev - 1) * 100
        rvol = total / (vol20 * min(1, (i + 1) * 30 / 390)) if vol20 > 0 else 0
        if bias == "bearish" or last < vwap:
            continue
        conf = (2 if bias == "bullish" else 1) + (rvol >= 1.5) + (1 if gap >= 1 else -1 if gap <= -1.5 else 0) + (last > top)
        if last > top:
            setup, lo, hi, stop = "orb", last, round(last + 0.25 * atr, 2), round(max(floor_, last - stop_m * atr), 2)
        else:
            setup, lo, hi, stop = "vwap", round(vwap, 2), round(min(last, vwap + 0.3 * atr), 2), round(vwap - stop_m * atr, 2)
            hi = round(lo + 0.1 * atr, 2) if hi < lo else hi
        risk = (lo + hi) / 2 - stop
        if conf < 2 or risk <= 0:
            continue
        target, lo, hi = round((lo + hi) / 2 + rr * risk, 2), round(lo, 2), round(hi, 2)
        for j in range(i + 1, len(bars)):
            fill = o[j] if lo <= o[j] <= hi else hi if o[j] > hi and low[j] <= hi else lo if o[j] < lo and h[j] >= lo else None
            if fill is not None:
                break
        else:
            return setup, conf, False, None, None
        if fill <= stop:
            return setup, conf, True, None, None
        out, kind = c[-1], "eod"
        for m in range(j, len(bars)):
            if low[m] <= stop or h[m] >= target:
                out, kind = (stop, "stop") if low[m] <= stop else (target, "target")
                break
        return setup, conf, True, kind, (out - fill) / (fill - stop) - 0.001 * fill / (fill - stop)
    return None


def loop(market, keys):
    daily, intra, _ = market
    days = {s: g.sort_values("day") for s, g in daily.groupby("symbol")}
    out = {}
    for (s, day), bars in intra.groupby(["symbol", "session"]):
        before = days[s][days[s].day < day]
        if len(before) >= 60:
            bias = gate(before.close)[0]
            for key in keys:
                got = session(bars.sort_values("k"), before, bias, *key)
                if got:
                    out[s, day, key] = got
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for k, w in want.items():
        g = got[k]
        assert g[:4] == w[:4] and (g[4] is None) == (w[4] is None) and (w[4] is None or g[4] == pytest.approx(w[4], abs=2e-3)), (k, g, w)


def test_replay_equals_a_loop(spark, market):
    want = loop(market, [(30, 1.5, 2.0)])
    rows = apply(spark, "plan_trades", market[2]).collect()
    same({(r.symbol, r.session, (30, 1.5, 2.0)): (r.setup, r.conf, r.filled, r.kind, r.r) for r in rows}, want)
    assert len(want) > 50 and {w[0] for w in want.values()} == {"orb", "vwap"} and {w[3] for w in want.values()} >= {"stop", "target", "eod"}


def test_gate_equals_pandas(spark, market):
    got = {(r.symbol, r.day): (r.bias, r.score) for r in apply(spark, "daily_gate", market[2]).collect()}
    for s, g in market[0].groupby("symbol"):
        for n in (50, 77, 120, 150):
            assert got[s, g.day.iloc[n - 1]] == gate(g.close.iloc[:n])


def stats(rs):
    done = [r for r in rs if r is not None]
    return len(rs), len(done), sum(r > 0 for r in done) / len(done) if done else None, sum(done) / len(done) if done else None


def test_stats_calibration_and_search_equal_a_loop(spark, market):
    every = loop(market, KEYS)
    usual = {k: w for k, w in every.items() if k[2] == (30, 1.5, 2.0)}
    groups = defaultdict(list)
    for w in usual.values():
        for key in (("all", "all"), ("setup", w[0]), ("confidence", "4+" if w[1] >= 4 else str(w[1]))):
            groups[key].append(w[4])
    got = {(r.of_, r.key_): (r.signals, r.n, r.win_rate, r.avg_r) for r in apply(spark, "plan_stats", market[2]).collect()}
    assert got.keys() == groups.keys()
    for k, rs in groups.items():
        assert got[k] == pytest.approx(stats(rs), abs=1e-5)
    days = sorted({k[1] for k in usual})
    split = days[max(1, int(len(days) * 0.6)) - 1]
    for r in apply(spark, "plan_calibration", market[2]).collect():
        a, b = (stats([w[4] for k, w in usual.items() if w[0] == r.setup and (k[1] <= split) == first]) for first in (True, False))
        enough = a[1] >= 5 and b[1] >= 2
        assert (r.n_train, r.n_valid) == (a[1], b[1])
        assert r.enabled == (not (enough and a[3] < 0 and b[3] < 0)) and r.conf_delta == (-1 if enough and a[3] > 0 and b[3] < 0 else 0)
    parts = {}
    for key in KEYS:
        mine = {k: w for k, w in every.items() if k[2] == key}
        days = sorted({k[1] for k in mine})
        i1 = max(1, int(len(days) * 0.5)) - 1
        i2 = max(i1 + 1, int(len(days) * 0.75) - 1)
        parts[key] = [stats([w[4] for k, w in mine.items() if low < k[1] <= high]) for low, high in ((days[0].replace(year=1900), days[i1]), (days[i1], days[i2]), (days[i2], days[-1]))]
    order = sorted((k for k in KEYS if parts[k][0][1] >= 5), key=lambda k: -parts[k][0][3])
    best = next((k for k in order if parts[k][1][1] >= 10 and parts[k][1][3] > 0), None)
    rows = apply(spark, "plan_optimize", market[2]).collect()
    assert len(rows) == 27
    for r in rows:
        p = parts[r.orb_minutes, r.stop_atr, r.target_rr]
        assert (r.n_train, r.n_valid, r.n_hold) == tuple(x[1] for x in p)
        assert (r.r_train, r.r_valid, r.r_hold) == pytest.approx(tuple(x[3] for x in p), abs=2e-3)
        assert r.best == ((r.orb_minutes, r.stop_atr, r.target_rr) == best)
        if r.recommended:
            assert r.best and p[2][1] >= 5 and p[2][3] >= parts[30, 1.5, 2.0][2][3] + 0.05


def test_bars_of_any_length_give_one_opening_range(spark, market):
    """The same market in bars of 5 and of 30 minutes, over the days on which clocks change, from moments of UTC."""
    from datetime import datetime, timedelta
    from zoneinfo import ZoneInfo

    zone, utc, rng = ZoneInfo("America/New_York"), ZoneInfo("UTC"), np.random.default_rng(12)
    days = [datetime(2024, m, d) for m, d in ((3, 8), (3, 11), (7, 1), (11, 1), (11, 4))]
    fine, coarse = [], []
    for day in days:
        px = 100 * np.exp(np.cumsum(rng.normal(0, 0.004, 391)))
        for step, out in ((5, fine), (30, coarse)):
            for k in range(0, 390, step):
                ts = (day + timedelta(minutes=570 + k)).replace(tzinfo=zone).astimezone(utc).replace(tzinfo=None)
                part = px[k : k + step + 1]
                out.append(("A", ts, float(part[0]), float(part.max()), float(part.min()), float(part[-1]), float(step)))
    assert [min(r[1].hour for r in fine if r[1].date() == d.date()) for d in days] == [14, 13, 13, 13, 14]  # the opening in UTC
    schema = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume double"
    known = spark.createDataFrame([("A", d.date(), 78, 100.0, 2.0, 390.0, "bullish") for d in days], "symbol string, session date, n int, prev_close double, atr double, vol20 double, bias string")
    seen = {}
    for name, rows in (("fine", fine), ("coarse", coarse)):
        intra = apply(spark, "bars_intra", {"bars_ts": spark.createDataFrame(rows[::-1], schema)})
        step = 5 if name == "fine" else 30
        got = intra.collect()
        assert {r.session for r in got} == {d.date() for d in days} and {r.step for r in got} == {float(step)}
        assert all(r.minute == (r.k - 1) * step for r in got)
        points = apply(spark, "plan_points", {"bars_intra": intra, "sessions_known": known}).collect()
        seen[name] = {(r.session, round(m)): r for r in points for m in [r.k * step]}
    for day in days:
        a, b = seen["fine"][day.date(), 390], seen["coarse"][day.date(), 390]
        for m in (30,):
            assert (a[f"orb_high_{m}"], a[f"orb_low_{m}"]) == (b[f"orb_high_{m}"], b[f"orb_low_{m}"])
        assert a.orb_high_15 <= a.orb_high_30 <= a.orb_high_45 and a.rvol == pytest.approx(b.rvol) == pytest.approx(1.0)
        assert seen["fine"][day.date(), 60].rvol == pytest.approx(1.0) and seen["coarse"][day.date(), 60].rvol == pytest.approx(1.0)
    taipei = apply(spark, "bars_intra", {"bars_ts": spark.createDataFrame([("T", datetime(2024, 5, 2, 1), 1.0, 1.0, 1.0, 1.0, 1.0), ("T", datetime(2024, 5, 1, 23), 1.0, 1.0, 1.0, 1.0, 1.0)], schema)}, zone="Asia/Taipei").collect()
    assert {r.session.isoformat() for r in taipei} == {"2024-05-02"} and [r.step for r in taipei] == [120.0, 120.0]


def test_answers_of_tickets(spark):
    """Each answer by hand: earnings, trend, data, price, calibration, confidence, stop."""
    from datetime import date

    day = date(2024, 5, 6)
    row = lambda s, **x: {"symbol": s, "session": day, "k": 4, "n": 13, "last_": 101.0, "vwap": 100.0, "orb_high_30": 105.0, "orb_low_30": 99.0, "atr": 2.0, "bias": "bullish", "gap": 0.0, "rvol": 1.0} | x
    rows = [
        row("buy"), row("trial", bias="neutral", rvol=2.0), row("earn0"), row("earn1", bias="bearish"), row("earn2"), row("bear", bias="bearish"), row("nodata", atr=0.0), row("noatr", atr=None), row("below", last_=99.0),
        row("break", orb_high_30=100.5), row("weak", bias="neutral"), row("less", bias="neutral", orb_high_30=100.5), row("stop", orb_high_30=100.5, orb_low_30=102.0, rvol=2.0), row("old", session=date(2024, 5, 3)), row("off", k=5),
    ]
    columns = "symbol string, session date, k int, n int, last_ double, vwap double, orb_high_30 double, orb_low_30 double, atr double, bias string, gap double, rvol double"
    points = spark.createDataFrame([tuple(r[c.split()[0]] for c in columns.split(", ")) for r in [*rows, row("old")]], columns)
    earnings = spark.createDataFrame([("earn0", day), ("earn1", date(2024, 5, 7)), ("earn2", date(2024, 5, 8)), ("buy", date(2024, 5, 5))], "symbol string, day date")

    def answers(setups):
        calibrated = spark.createDataFrame(setups, "setup string, enabled boolean, conf_delta long")
        return {r.symbol: r for r in apply(spark, "ticket_answers", {"plan_points": points, "earnings_days": earnings, "applied_calibration": calibrated}).collect()}

    got = answers([("vwap", True, 0)])
    why = {s: (r.action, r.why, r.confidence) for s, r in got.items()}
    assert why == {
        "buy": ("buy", "ok", 2), "trial": ("trial", "ok", 2), "earn0": ("avoid", "earnings", 0), "earn1": ("avoid", "earnings", 0), "earn2": ("buy", "ok", 2), "bear": ("avoid", "bearish", 0), "nodata": ("watch", "no data", 0), "noatr": ("watch", "no data", 0),
        "below": ("watch", "below vwap", 0), "break": ("buy", "ok", 3), "weak": ("watch", "confidence", 1), "less": ("trial", "ok", 2), "stop": ("watch", "stop", 0), "old": ("buy", "ok", 2),
    }
    b = got["buy"]
    assert (b.setup, b.entry_lo, b.entry_hi, b.stop, b.target) == ("vwap", 100.0, 100.6, 97.0, 106.9) and b.shares == int(min(1000 / 3.0, 1000 / 3.3, 30_000 / 100.3))
    assert got["weak"].shares is None and got["weak"].stop is None and got["break"].setup == "orb"
    got = answers([("vwap", False, 0), ("orb", True, -1)])
    assert {s: (got[s].action, got[s].why, got[s].confidence) for s in ("buy", "break", "less")} == {"buy": ("watch", "setup off", 2), "break": ("buy", "ok", 2), "less": ("watch", "confidence", 1)}
