"""Theses and paper books by hand-written cases."""

from __future__ import annotations

from datetime import date, timedelta

import pytest

from tidewell.streaming import books

DAY = date(2024, 3, 1)


def test_theses_take_or_refuse(spark):
    ops = [
        (1, 1, "pillar", "no thesis yet", None, "aapl"), (1, 2, "long", "it grows", None, "aapl"), (1, 3, "pillar", "margins", None, "AAPL"), (1, 4, "stop", None, 90.0, "AAPL"), (1, 5, "stop", None, -1.0, "AAPL"),
        (1, 6, "conviction", "high", None, "AAPL"), (1, 7, "conviction", "sky", None, "AAPL"), (1, 8, "short", "", None, "AAPL"), (1, 9, "short", "it shrinks", None, "AAPL"), (1, 10, "note", "x" * 300, None, "AAPL"), (1, 11, "dance", "x", None, "AAPL"),
        (2, 1, "long", "a", None, "B"), (2, 2, "close", "wrong", None, "B"), (2, 3, "long", None, None, "C"),
    ]
    ops += [(3, k, "long", "why", None, f"S{k}") for k in range(40)] + [(4, 0, "long", "why", None, "Z")] + [(4, 1 + k, "risk", f"r{k}", None, "Z") for k in range(12)] + [(4, 50 + k, "note", f"n{k}", None, "Z") for k in range(30)]
    rows = [(o, seq, DAY + timedelta(days=seq), symbol, op, word, value) for o, seq, op, word, value, symbol in ops]
    table = spark.createDataFrame(rows[::-1], "owner long, seq long, day date, symbol string, op string, word string, value double")
    got = {(r.owner, r.symbol): r for r in books.theses(table).collect()}
    a = got[1, "AAPL"]
    assert (a.direction, a.status, a.conviction, a.target, a.stop, a.pillars) == ("short", "active", "high", None, 90.0, 1)
    assert a.notes == ["set", "conviction high", "rewritten", "x" * 200] and (a.created, a.updated) == (DAY + timedelta(days=2), DAY + timedelta(days=10))
    assert got[2, "B"].status == "closed" and got[2, "B"].notes[-1] == "closed wrong" and (2, "C") not in got
    assert sum(o == 3 for o, _ in got) == books.MOST_THESES
    assert got[4, "Z"].risks == books.MOST_ITEMS and got[4, "Z"].notes == [f"n{k}" for k in range(10, 30)]


def test_books_by_round(spark):
    d = lambda n: DAY + timedelta(days=n)
    rounds = [
        (1, 0, d(0), "A", 100.0, "buy", 5.0, 1.0), (1, 0, d(0), "B", 50.0, "buy", 100.0, 2.0),  # the second is cut to what cash buys
        (1, 1, d(1), "A", 120.0, "buy", 5.0, 1.0), (1, 1, d(1), "B", 60.0, "sell", 4.0, 9.0),
        (1, 2, d(2), "A", 110.0, None, None, None), (1, 7, d(7), "A", 110.0, "sell", 99.0, 1.0), (1, 8, d(8), "A", None, "buy", 1.0, 1.0),
    ]
    table = spark.createDataFrame(rounds[::-1], "book long, round long, day date, symbol string, price double, side string, qty double, place double")
    got = {r.round: (r.cash, r.equity, r.positions, r.filled, r.forced) for r in books.books(table, 1000.0).collect()}
    assert got[0] == (0.0, 1000.0, 2, 2, 0)  # 5 A and 10 B
    assert got[1] == (0.0, 7 * 120 + 6 * 60, 2, 2, 0)  # 4 B sold, 2 A bought for that
    assert got[2] == (0.0, 7 * 110 + 6 * 60, 2, 0, 0)
    assert got[7] == (7 * 110 + 6 * 60, 7 * 110 + 6 * 60, 0, 1, 1)  # B unquoted since day 2: closed at 60
    assert got[8] == (pytest.approx(1130.0), pytest.approx(1130.0), 0, 0, 0)
