"""Paper books run by a rule: a shadow book by the plain rule of scores, a mirror book by the layered engine.

One fold for both: what hasn't been quoted for days is closed, the rule names orders, they fill at the
round's prices, what is held is marked. Only the rule and what a book starts with differ.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

from tidewell.streaming import engine
from tidewell.streaming.books import STALE_DAYS, Book
from tidewell.streaming.keyed import DAY, Fold, day_of


@dataclass(frozen=True)
class Limits:
    """Fixed values of the plain rule: thresholds of scores, positions at most, sizes as shares of equity, risk of a share if unknown."""

    buy: float = 0.5
    leave: float = -0.2
    slots: int = 10
    position: float = 0.15
    risk: float = 0.01
    unit: float = 0.05


def share_of(scale: float | None) -> float:
    """A scale of an entry: all of it if there is none or it is no number, else between 0 and 1."""
    return 1.0 if scale is None or math.isnan(scale) else min(1.0, max(0.0, scale))


def plain(quotes: dict[str, dict], held: dict[str, float], equity: float, cash: float, limits: Limits = Limits()) -> list[dict]:
    """Orders by score alone: what is held and scores low goes; the best of the rest come while slots and cash last.

    Each entry takes what a stop may lose, what a position may weigh and what the cash left buys, whichever is
    least, times its scale. Sales of the round bring no cash to it. Equal scores go by symbol.
    """
    score = lambda q: q.get("score") or 0.0
    out = [{"symbol": s, "side": "sell", "qty": abs(qty), "mechanism": "low_score"} for s, qty in held.items() if qty and s in quotes and score(quotes[s]) <= limits.leave]
    stay = set(held) - {o["symbol"] for o in out}
    able = [q for s, q in quotes.items() if s not in stay and not q.get("barred") and (q.get("price") or 0) > 0 and score(q) >= limits.buy]
    room = limits.slots - len(stay) if equity > 0 else 0
    for q in sorted(able, key=lambda q: (-q["score"], q["symbol"])):
        if room <= 0:
            break
        unit = q["unit"] if (q.get("unit") or 0) > 0 else q["price"] * limits.unit
        qty = int(min(equity * limits.risk / unit, equity * limits.position / q["price"], cash / q["price"]) * share_of(q.get("scale")))
        if qty >= 1:
            out.append({"symbol": q["symbol"], "side": "buy", "qty": float(qty), "mechanism": "high_score"})
            cash -= qty * q["price"]
            room -= 1
    return out


def by_plain(book: Book, memory: str | None, at: int, quotes: dict[str, dict], equity: float, regime: str | None) -> tuple[list[dict], str | None]:
    return plain(quotes, {s: p["qty"] for s, p in book.held.items()}, equity, book.cash), None


def by_engine(book: Book, memory: str | None, at: int, quotes: dict[str, dict], equity: float, regime: str | None) -> tuple[list[dict], str | None]:
    """The layered engine with an account of its own. What the book holds and the account doesn't is adopted at its cost, with a stop of a twentieth."""
    account, today = engine.Account.load(memory), day_of(at).isoformat()
    account.cash = book.cash
    known = account.positions
    account.positions = {}
    for s, p in book.held.items():
        price = (quotes.get(s) or {}).get("price") or book.last.get(s) or p["entry"]
        account.positions[s] = known.get(s) or engine.Position(p["entry"], max(p["entry"] * 0.05, 0.01), max(p["entry"], price), today, p["qty"], p["qty"])
        account.positions[s].qty = p["qty"]
    barred = lambda q: q.get("barred") and q["symbol"] not in book.held
    seen = [{k: q.get(k) for k in ("symbol", "score", "price", "unit")} for q in quotes.values() if not barred(q)]
    orders = engine.play(account, today, seen, regime, equity=equity)
    return orders, account.dump()


RULES: dict[str, Callable] = {"plain": by_plain, "engine": by_engine}


class PaperBook(Fold):
    """One book by one rule. Rows: kind, symbol, price, score, unit, barred, scale, qty, regime.

    kind quote is a quote of the moment's round. Before the first round, cash (its price) and holding (qty at
    the cost price) are what the book starts with; else it starts with cash alone. A holding below one share
    or without a cost is refused. A position that a round doesn't quote is closed at its last price once
    five days have passed, at the next round, or by itself if the book has no round on the fifth day.
    """

    out = "rule string, day date, cash double, equity double, positions int, forced int, orders array<struct<symbol:string,side:string,qty:double,price:double,mechanism:string>>"
    order = ("kind", "symbol", "price", "qty")

    def __init__(self, rule: str, cash: float = 100_000.0):
        if rule not in RULES:
            raise ValueError(f"no rule {rule}: there are {', '.join(sorted(RULES))}")
        self.rule, self.cash = rule, cash

    def start(self) -> dict:
        return {"cash": self.cash, "held": {}, "last": {}, "memory": None, "rounds": 0}

    def _open(self, state: dict) -> Book:
        book = Book(state["cash"])
        book.held, book.last = state["held"], state["last"]
        return book

    def _begin(self, state: dict, rows: list[dict]) -> None:
        for r in rows:
            if r["kind"] == "cash" and r["price"] is not None:
                state["cash"] = float(r["price"])
            elif r["kind"] == "holding" and r["symbol"] and (r["qty"] or 0) >= 1 and (r["price"] or 0) > 0:
                one = state["held"].get(r["symbol"], {"qty": 0.0, "entry": 0.0})
                qty = one["qty"] + r["qty"]
                state["held"][r["symbol"]] = {"qty": qty, "entry": (one["entry"] * one["qty"] + r["price"] * r["qty"]) / qty}

    def _stale(self, book: Book, at: int, prices: dict[str, float]) -> list[dict]:
        """What hasn't been quoted for STALE_DAYS, sold at its last price."""
        day, out = at // DAY, []
        for s, p in list(book.held.items()):
            if s in prices:
                p.pop("since", None)
            elif day - p.setdefault("since", day) >= STALE_DAYS:
                price = book.last.pop(s, None) or p["entry"]
                book.cash += p["qty"] * price
                out.append({"symbol": s, "side": "sell", "qty": p["qty"], "price": price, "mechanism": "stale"})
                del book.held[s]
        return out

    def _row(self, state: dict, book: Book, at: int, prices: dict[str, float], forced: list[dict], done: list[dict]) -> tuple:
        book.end(prices)
        state["cash"], state["held"], state["last"] = book.cash, book.held, book.last
        return (self.rule, day_of(at), round(book.cash, 6), round(book.equity(prices), 6), len(book.held), len(forced), forced + done)

    def step(self, state: dict, at: int, rows: list[dict]) -> Iterator[tuple]:
        if not state["rounds"]:
            self._begin(state, rows)
        quotes = {r["symbol"]: r for r in rows if r["kind"] == "quote" and r["symbol"]}
        if not quotes:
            return
        state["rounds"] += 1
        prices = {s: float(q["price"]) for s, q in quotes.items() if (q["price"] or 0) > 0}
        book = self._open(state)
        forced = self._stale(book, at, prices)
        orders, state["memory"] = RULES[self.rule](book, state["memory"], at, quotes, book.equity(prices), rows[0].get("regime"))
        done = []
        for o in orders:
            before = book.held.get(o["symbol"], {"qty": 0.0})["qty"]
            if book.order(o["symbol"], o["side"], o["qty"], prices.get(o["symbol"])):
                after = book.held.get(o["symbol"], {"qty": 0.0})["qty"]
                done.append(o | {"qty": abs(after - before), "price": prices[o["symbol"]]})
        yield self._row(state, book, at, prices, forced, done)

    def due(self, state: dict) -> int | None:
        since = [p["since"] for p in state["held"].values() if "since" in p]
        return (min(since) + STALE_DAYS + 1) * DAY if since else None

    def end(self, state: dict, at: int) -> Iterator[tuple]:
        """The fifth day has ended without a round."""
        book, last = self._open(state), at - 1
        forced = self._stale(book, last, {s: p["entry"] for s, p in book.held.items() if "since" not in p})
        yield self._row(state, book, last, {}, forced, [])
