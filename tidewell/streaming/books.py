"""Folds over a person's operations on theses and over the orders of a paper book, in order, by owner or book."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date

import pandas as pd
from pyspark.sql import DataFrame

from tidewell.streaming.keyed import Fold

# Fixed values of the rules.
MOST_THESES, MOST_ITEMS, MOST_NOTES, STALE_DAYS = 30, 8, 20, 5
ITEMS = {"pillar": "pillars", "risk": "risks", "catalyst": "catalysts"}
THESES = "owner long, symbol string, direction string, status string, conviction string, target double, stop double, pillars int, risks int, catalysts int, notes array<string>, created date, updated date"
BOOK = "book long, round long, day date, cash double, equity double, positions int, filled int, forced int"


class Theses:
    """One owner's theses: each operation either takes effect or is refused."""

    def __init__(self):
        self.of: dict[str, dict] = {}

    def take(self, day: date, symbol: str, op: str, word: str | None = None, value: float | None = None) -> bool:
        symbol, word = (symbol or "").upper().strip(), (word or "").strip()
        one = self.of.get(symbol)
        if op in ("long", "short"):
            if not symbol or not word or one is None and len(self.of) >= MOST_THESES:
                return False
            kept = one or {"pillars": [], "risks": [], "catalysts": [], "target": None, "stop": None, "conviction": "medium", "created": day, "notes": []}
            self.of[symbol] = one = kept | {"direction": op, "status": "active"}
            note = "set" if kept["notes"] == [] else "rewritten"
        elif one is None:
            return False
        elif op in ITEMS:
            if not word or len(one[ITEMS[op]]) >= MOST_ITEMS:
                return False
            one[ITEMS[op]].append(word[:150])
            note = None
        elif op in ("target", "stop"):
            if value is None or value <= 0:
                return False
            one[op], note = float(value), None
        elif op == "conviction":
            if word not in ("high", "medium", "low"):
                return False
            one[op], note = word, f"conviction {word}"
        elif op == "note":
            if not word:
                return False
            note = word[:200]
        elif op == "close":
            one["status"], note = "closed", f"closed {word[:150]}".strip()
        else:
            return False
        one["updated"] = day
        if note:
            one["notes"] = (one["notes"] + [note])[-MOST_NOTES:]
        return True


def theses(ops: DataFrame) -> DataFrame:
    """What each owner's theses are after all operations. ops: owner, seq, day, symbol, op, word, value; refused ones change nothing."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        store = Theses()
        for r in pdf.sort_values("seq").itertuples():
            store.take(r.day, r.symbol, r.op, r.word, None if r.value != r.value else r.value)
        rows = [(key[0], s, t["direction"], t["status"], t["conviction"], t["target"], t["stop"], len(t["pillars"]), len(t["risks"]), len(t["catalysts"]), t["notes"], t["created"], t["updated"]) for s, t in sorted(store.of.items())]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in THESES.split(", ")])

    return ops.groupBy("owner").applyInPandas(fold, THESES)


class AverageCost(Fold):
    """A position at average cost. Rows: side, qty, price; a sale of more than is held is rejected and changes nothing."""

    out = "held double, cost double, gain double, rejected long"
    order = ("side", "qty", "price")

    def start(self) -> dict:
        return {"held": 0.0, "cost": 0.0, "gain": 0.0, "rejected": 0}

    def step(self, state: dict, at: int, rows: list[dict]) -> Iterator[tuple]:
        for r in rows:
            held, qty, price = state["held"], r["qty"], r["price"]
            if r["side"] == "buy":
                state["held"], state["cost"] = held + qty, state["cost"] + qty * price
            elif qty > held:
                state["rejected"] += 1
            else:
                mean = state["cost"] / held
                state["gain"] += qty * (price - mean)
                state["held"] = held - qty
                state["cost"] = state["cost"] - qty * mean if qty < held else 0.0
        return iter(())

    def finish(self, state: dict) -> Iterator[tuple]:
        yield state["held"], state["cost"], state["gain"], state["rejected"]


class Book:
    """Cash and positions at average price; what hasn't been quoted for STALE_DAYS is closed at its last price."""

    def __init__(self, cash: float):
        self.cash, self.held, self.last = cash, {}, {}

    def close_stale(self, day: date, prices: dict[str, float]) -> int:
        forced = 0
        for s in list(self.held):
            if s in prices:
                self.held[s].pop("since", None)
            elif (day - self.held[s].setdefault("since", day)).days >= STALE_DAYS:
                one = self.held.pop(s)
                self.cash += one["qty"] * (self.last.pop(s, None) or one["entry"])
                forced += 1
        return forced

    def order(self, symbol: str, side: str, qty: float, price: float | None) -> bool:
        if not price or price <= 0 or qty < 1:
            return False
        one = self.held.get(symbol)
        if side == "buy":
            if qty * price > self.cash + 1e-6:
                qty = int(self.cash / price)
            if qty < 1:
                return False
            self.cash -= qty * price
            before = one or {"qty": 0.0, "entry": 0.0}
            total = before["qty"] + qty
            self.held[symbol] = before | {"qty": total, "entry": (before["entry"] * before["qty"] + price * qty) / total}
            return True
        if one is None:
            return False
        sold = min(qty, one["qty"])
        self.cash += sold * price
        one["qty"] -= sold
        if one["qty"] < 1:
            del self.held[symbol]
        return True

    def equity(self, prices: dict[str, float]) -> float:
        return self.cash + sum(p["qty"] * (prices.get(s) or self.last.get(s) or p["entry"]) for s, p in self.held.items())

    def end(self, prices: dict[str, float]) -> None:
        self.last = {s: prices.get(s) or self.last.get(s) or p["entry"] for s, p in self.held.items()}


def books(rounds: DataFrame, cash: float = 100_000.0) -> DataFrame:
    """One row a round of each book: cash, equity, positions, orders filled, positions closed for want of a price.

    rounds: book, round, day, symbol, price, side, qty, place: a quote, with an order where side is not null;
    sells of a round come before its buys, each in the order of place.
    """

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        book, rows = Book(cash), []
        for n, of in pdf.sort_values(["round", "side", "place"], ascending=[True, False, True]).groupby("round"):
            prices = {r.symbol: r.price for r in of.itertuples() if r.price == r.price and r.price > 0}
            day = of["day"].iloc[0]
            forced = book.close_stale(day, prices)
            filled = sum(book.order(r.symbol, r.side, r.qty, prices.get(r.symbol)) for r in of.itertuples() if r.side in ("buy", "sell"))
            book.end(prices)
            rows.append((key[0], n, day, round(book.cash, 4), round(book.equity(prices), 4), len(book.held), filled, forced))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in BOOK.split(", ")])

    return rounds.groupBy("book").applyInPandas(fold, BOOK)
