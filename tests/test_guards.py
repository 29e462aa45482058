"""Typed ledgers, entries close to what is held, reports ahead, due messages: against plain Python."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta
from zoneinfo import ZoneInfo

import duckdb
import numpy as np
import pytest

from tidewell.plans.compose import DUCK, apply, compose
from tidewell.sources import parsers, sinks

RAW = "line long, day string, symbol string, side string, qty string, price string, fee string"


def test_each_row_of_a_ledger_is_told(spark, tmp_path):
    rows = [
        (1, "2024-05-02", " aapl ", "BUY ", "10", "100.5", None), (2, "2024-05-02", "AAPL", "sell", "5", "0", "1"), (3, "2024-05-01", "AAPL", "Sell", "5", "101", ""), (4, "someday", "A", "buy", "1", "1", None), (5, None, "A", "buy", "1", "1", None),
        (6, "2024-05-02", "A", "hold", "1", "1", None), (7, "2024-05-02", "A", None, "1", "1", None), (8, "2024-05-02", "A", "buy", "0", "1", None), (9, "2024-05-02", "A", "buy", "x", "1", None), (10, "2024-05-02", "A", "buy", "1", "-0.1", None),
        (11, "2024-05-02", "A", "buy", "1", None, None), (12, "2024-05-02", " ", "buy", "1", "1", None), (13, "2024-05-02", None, "buy", "1", "1", None), (14, "2024-05-02", "A", "buy", "1", "1", "free"), (15, "2024-05-02", "AAPL", "buy", "1e2", "1", "2"),
    ]
    got = {r.line: r for r in apply(spark, "checked_trades", {"raw_trades": spark.createDataFrame(rows, RAW)}).collect()}
    assert {n: r.reject for n, r in got.items() if r.reject} == {4: "date", 5: "date", 6: "side", 7: "side", 8: "qty", 9: "qty", 10: "price", 11: "price", 12: "symbol", 13: "symbol", 14: "fee"}
    assert [(got[n].symbol, got[n].side, got[n].qty, got[n].price, got[n].fee, got[n].place) for n in (3, 1, 15, 2)] == [("AAPL", "sell", 5.0, 101.0, 0.0, 1), ("AAPL", "buy", 10.0, 100.5, 0.0, 2), ("AAPL", "buy", 100.0, 1.0, 2.0, 3), ("AAPL", "sell", 5.0, 0.0, 1.0, 4)]
    (tmp_path / "a.csv").write_text("Ticker,date,side,qty,price\nB,2024-01-02,buy,3,4\nB,2024-01-02,buy,,4\n,2024-01-02,sell,1,1\n")
    up = parsers.ledger_upload(spark, f"file://{tmp_path}/a.csv").orderBy("line").collect()
    assert [(r.symbol, r.qty, r.fee, r.reject) for r in up] == [("B", 3.0, 0.0, None), ("B", None, 0.0, "qty"), (None, 1.0, 0.0, "symbol")]


def test_cents_of_raw_trades_as_duckdb_rounds_them(spark):
    orders = [(1000 * 41 * k, k, "F", 100 * (k % 400) + 0.5 + k, datetime(2024, 1, 1)) for k in range(400)]
    df = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz")
    orders = df.toPandas()  # noqa: F841  DuckDB reads it
    want = dict(duckdb.sql(f"SELECT line, CAST(price AS DOUBLE) FROM ({compose('checked_trades', DUCK)}) x").fetchall())
    assert {r.line: r.price for r in apply(spark, "checked_trades", {"orders": df}).collect()} == want


def test_entries_close_to_what_is_held(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=80)
    series = {"H1": base, "H2": rng.normal(size=80), "twin": base + 0.1 * rng.normal(size=80), "near": base + 0.7 * rng.normal(size=80), "far": rng.normal(size=80), "short": base[:29], "flat": np.zeros(80)}
    rows = [(s, date(2024, 1, 1) + timedelta(days=k), float(x)) for s, v in series.items() for k, x in enumerate(v) if not (s == "near" and k % 5 == 0)]
    held = spark.createDataFrame([("H1", 60.0, 1.0), ("H2", 37.0, 1.0), ("far", 3.0, 1.0), ("flat", -50.0, 1.0)], "symbol string, qty double, price double")
    got = {r.candidate: r for r in apply(spark, "entry_guard", {"returns": spark.createDataFrame(rows, "symbol string, day date, r double"), "held_now": held}).collect()}
    assert set(got) == set(series)
    for c, v in series.items():
        on = [k for k in range(len(v)) if not (c == "near" and k % 5 == 0)]
        cors = [float(np.corrcoef(v[on], series[h][on])[0, 1]) for h in ("H1", "H2") if h != c and len(on) >= 30 and v[on].std() > 0]
        if not cors:
            assert (got[c].mean, got[c].highest, got[c].scale) == (None, None, 1.0)
            continue
        eff = max(sum(cors) / len(cors), max(cors) - 0.05)
        assert (got[c].mean, got[c].highest) == (pytest.approx(sum(cors) / len(cors), abs=6e-4), pytest.approx(max(cors), abs=6e-4))
        assert got[c].scale == (0.0 if eff >= 0.85 else 0.5 if eff >= 0.75 else 1.0)
    assert {got["twin"].scale, got["near"].scale, got["far"].scale} == {0.0, 0.5, 1.0} or got["near"].scale in (0.5, 1.0)


def test_reports_ahead(spark):
    today = date(2024, 6, 3)
    bars = spark.createDataFrame([(s, today) for s in "ABCDE"], "symbol string, day date")
    e = [("A", today + timedelta(days=9)), ("A", today + timedelta(days=99)), ("B", today - timedelta(days=14)), ("B", today + timedelta(days=22)), ("C", today - timedelta(days=15)), ("D", today), ("D", today - timedelta(days=3))]
    iv = spark.createDataFrame([("A", 0.4, 0.3), ("B", None, 0.5), ("C", 0.6, 0.6), ("D", 0.2, None), ("E", 0.9, 0.9)], "symbol string, put_iv double, call_iv double")
    got = {r.symbol: (r.ahead, r.since, r["mode"], r.implied, r.up, r.base, r.down) for r in apply(spark, "earnings_outlook", {"bars": bars, "earnings_days": spark.createDataFrame(e, "symbol string, day date"), "option_totals": iv}).collect()}
    move = lambda x, n: round(x * (max(n, 1) / 365) ** 0.5 * 100, 1)
    assert got["A"] == (9, None, "preview", move(0.4, 9), move(0.4, 9), pytest.approx(move(0.4, 9) * 0.4), -move(0.4, 9))
    assert got["B"][:4] == (22, 14, "review", move(0.5, 22)) and got["C"] == (None, 15, "both", None, 5.0, 2.0, -5.0)
    assert got["D"][:4] == (0, 3, "preview", move(0.2, 0)) and got["D"][5] == 1.0 and got["E"][:4] == (None, None, "both", None)


def test_due_messages_equal_a_loop(spark):
    zone, utc, rng = ZoneInfo("America/New_York"), ZoneInfo("UTC"), random.Random(4)
    closed = {date(2024, 3, 29), date(2024, 5, 27)}
    rows = []
    for owner in (1, 2):
        t = datetime(2024, 3, 1)
        while t < datetime(2024, 6, 3):
            rows.append((owner, t, datetime(2024, 4, 10, 15) if owner == 2 else None))
            t += timedelta(minutes=rng.randint(20, 400))
    got = {(r.owner, r.kind, r.day): r.ts for r in apply(spark, "due_messages", {"moments": spark.createDataFrame(rows[::-1], "owner int, ts timestamp_ntz, muted_until timestamp_ntz")}).collect()}
    want, sent = {}, {}
    for owner, t, mute in rows:
        here = t.replace(tzinfo=utc).astimezone(zone)
        if mute and t < mute:
            continue
        if here.weekday() < 5 and here.date() not in closed and here.hour + here.minute / 60 >= 8.5 and sent.get((owner, "briefing")) != here.date():
            sent[owner, "briefing"] = here.date()
            want[owner, "briefing", here.date()] = t
        week = here.isocalendar()[:2]
        if here.weekday() == 6 and here.hour >= 18 and sent.get((owner, "weekly")) != week:
            sent[owner, "weekly"] = week
            want[owner, "weekly", here.date()] = t
    assert got == want and sum(k == "weekly" for _, k, _ in want) > 10


def test_tables_are_written_for_readers(spark, tmp_path):
    """SNK-02: what a reader of the file gets back."""
    import inspect

    write = next(f for n, f in inspect.getmembers(sinks, inspect.isfunction) if "csv" in n)
    df = spark.createDataFrame([("a,b", 1.5, None), ('quote "x"', None, "z")], "name string, x double, y string")
    write(df, f"file://{tmp_path}/out")
    back = spark.read.csv(f"file://{tmp_path}/out", header=True, escape='"').collect()
    assert sorted((r.name, r.x, r.y) for r in back) == [("a,b", "1.5", None), ('quote "x"', None, "z")]
