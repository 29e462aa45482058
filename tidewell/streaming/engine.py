"""A trading account as a state machine: exits by price, guards, sized entries, additions to winners.

One fold serves a batch replay (applyInPandas by account) and a stream (applyInPandasWithState): it is
sequential by nature, as each round's cash and positions depend on the one before.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field
from datetime import date, timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.streaming.keyed import Fold, day_of, moment
from tidewell.streaming.keyed import replay as replay_keys


@dataclass(frozen=True)
class Rules:
    """Fixed values of the engine: thresholds of scores, sizes as shares of equity, distances in units of risk."""

    buy: float = 0.5
    leave: float = -0.2
    slots: int = 10
    position: float = 0.15
    risk: float = 0.01
    add_r: float = 1.0
    adds: int = 2
    add_share: float = 0.5
    add_score: float = 0.0
    headroom: float = 1.3
    stop_r: float = 1.0
    trail_from: float = 1.0
    trail: float = 0.08
    trail_tight: float = 0.05
    tight_from: float = 2.0
    half_at: float = 1.5
    idle_days: int = 30
    idle_gain: float = 0.02
    guard_stops: int = 3
    guard_days: int = 7
    halt_days: int = 3
    rest_days: int = 5
    max_drawdown: float = 0.10


@dataclass
class Position:
    entry: float
    unit: float  # risk of a share
    peak: float
    opened: str
    first_qty: float
    qty: float
    adds: int = 0
    halved: bool = False


@dataclass
class Account:
    cash: float = 100_000.0
    top: float = 0.0
    halted: str | None = None
    positions: dict[str, Position] = field(default_factory=dict)
    stops: list[tuple[str, str]] = field(default_factory=list)
    resting: dict[str, str] = field(default_factory=dict)

    @staticmethod
    def load(text: str | None) -> Account:
        if not text:
            return Account()
        raw = json.loads(text)
        raw["positions"] = {s: Position(**p) for s, p in raw["positions"].items()}
        raw["stops"] = [tuple(x) for x in raw["stops"]]
        return Account(**raw)

    def dump(self) -> str:
        return json.dumps(asdict(self))  # positions stay in the order in which they were opened


def _on(day: str, n: int) -> str:
    return (date.fromisoformat(day) + timedelta(days=n)).isoformat()


def _age(day: str, today: str) -> int:
    return (date.fromisoformat(today) - date.fromisoformat(day)).days


def way_out(p: Position, px: float, score: float, today: str, tight: bool, rules: Rules) -> tuple[str, float]:
    """The first rule that applies to a position, and the quantity it sells (0: it stays and the round is over for it)."""
    gain, best = (px - p.entry) / p.unit, (p.peak - p.entry) / p.unit
    if best < rules.trail_from and gain <= -rules.stop_r:
        return "stop_loss", p.qty
    if best >= rules.trail_from:
        share = rules.trail_tight if tight or best >= rules.tight_from else rules.trail
        if px <= max(p.entry, p.peak * (1 - share)):
            return "trailing_stop", p.qty
    if not p.halved and gain >= rules.half_at and p.qty >= 2:
        return "scale_out", p.qty // 2
    if score <= rules.leave:
        return ("signal_exit", p.qty) if px > p.entry else ("hold", 0)
    if _age(p.opened, today) >= rules.idle_days and px / p.entry - 1 < rules.idle_gain and score < rules.buy:
        return "dead_money", p.qty
    return "", 0


def play(a: Account, today: str, quotes: list[dict], regime: str | None, rules: Rules = Rules(), equity: float | None = None) -> list[dict]:
    """One round: quotes (symbol, score, price, unit) to orders; a is changed in place, orders fill at the price. equity: as the caller marks it."""
    by = {q["symbol"]: q for q in quotes}
    price = lambda s: by[s]["price"] if s in by and by[s]["price"] else None
    if equity is None:
        equity = a.cash + sum(p.qty * (price(s) or p.entry) for s, p in a.positions.items())
    a.top = max(a.top, equity)
    if a.halted and today < a.halted:
        mode = "halted"
    elif a.top > 0 and 1 - equity / a.top >= rules.max_drawdown or regime == "risk_off":
        mode = "reducing"
    else:
        mode = "active"
    orders, left, held_before = [], set(), set(a.positions)

    def fill(symbol: str, side: str, qty: float, mechanism: str) -> None:
        orders.append({"symbol": symbol, "side": side, "qty": float(qty), "mechanism": mechanism})
        a.cash += qty * price(symbol) * (1 if side == "sell" else -1)

    for s, p in list(a.positions.items()):
        px = price(s)
        if px is None or p.qty < 1:
            continue
        p.peak = max(p.peak, px)
        mechanism, qty = way_out(p, px, by[s].get("score") or 0.0, today, mode != "active", rules)
        if qty:
            fill(s, "sell", qty, mechanism)
            p.qty -= qty
            p.halved |= mechanism == "scale_out"
        if qty and mechanism != "scale_out":
            left.add(s)
        if mechanism == "stop_loss" or mechanism == "trailing_stop" and px < p.entry:
            if (today, s) not in a.stops:
                a.stops.append((today, s))
            a.resting[s] = _on(today, rules.rest_days)

    a.stops = [x for x in a.stops if 0 <= _age(x[0], today) <= 2 * rules.guard_days]
    recent = [x for x in a.stops if _age(x[0], today) <= rules.guard_days]
    if len({s for _, s in recent}) >= rules.guard_stops and mode != "halted":
        a.halted, mode = _on(today, rules.halt_days), "halted"
        a.stops = [x for x in a.stops if x not in recent]
    if a.halted and today >= a.halted:
        a.halted = None
    a.resting = {s: d for s, d in a.resting.items() if d > today}
    for s in left:
        del a.positions[s]

    if mode == "active" and equity > 0:
        budget = a.cash
        wanted = [q for q in quotes if q["symbol"] not in a.positions and q["symbol"] not in left and q["symbol"] not in a.resting and (q.get("score") or 0) >= rules.buy and (q["price"] or 0) > 0]
        for q in sorted(wanted, key=lambda q: (-q["score"], q["symbol"])):
            if len(a.positions) >= rules.slots:
                break
            px, unit = q["price"], q.get("unit") or q["price"] * 0.05
            qty = int(min(equity * rules.risk / unit, equity * rules.position / px, budget / px))
            if qty >= 1:
                fill(q["symbol"], "buy", qty, "entry")
                a.positions[q["symbol"]] = Position(px, max(unit, 0.01), px, today, qty, qty)
                budget = a.cash
        for s in sorted(set(a.positions) & held_before):
            p, px = a.positions[s], price(s)
            if px is None or p.halved or p.adds >= rules.adds:
                continue
            if (px - p.entry) / p.unit >= (p.adds + 1) * rules.add_r and (by[s].get("score") or 0) >= rules.add_score:
                room = equity * rules.position * rules.headroom - p.qty * px
                qty = min(int(max(1, p.first_qty * rules.add_share)), int(max(room, 0) / px), int(a.cash / px))
                if qty >= 1:
                    fill(s, "buy", qty, "pyramid")
                    p.qty, p.adds = p.qty + qty, p.adds + 1
    return orders


def rounds(a: Account, rows: pd.DataFrame) -> Iterator[dict]:
    """The orders of rows (day, symbol, score, price, unit, regime), day by day, with cash after each day."""
    for day, of in rows.sort_values(["day", "symbol"]).groupby("day", sort=True):
        quotes = of[["symbol", "score", "price", "unit"]].to_dict("records")
        for k, o in enumerate(play(a, str(day)[:10], quotes, of["regime"].iloc[0])):
            yield {"day": day, "place": k, **o, "cash": round(a.cash, 6)}


ORDERS = "account string, day date, place int, symbol string, side string, qty double, mechanism string, cash double"


class Trading(Fold):
    """The engine as a fold: the state is the account, a moment a day's quotes (symbol, score, price, unit, regime)."""

    out = ORDERS.removeprefix("account string, ")
    order = ("symbol",)

    def start(self) -> dict:
        return {"account": None}

    def step(self, state: dict, at: int, rows: list[dict]) -> Iterator[tuple]:
        a, day = Account.load(state["account"]), day_of(at)
        orders = play(a, day.isoformat(), rows, rows[0]["regime"])
        state["account"] = a.dump()
        for k, o in enumerate(orders):
            yield day, k, o["symbol"], o["side"], o["qty"], o["mechanism"], round(a.cash, 6)


def replay(scored: DataFrame) -> DataFrame:
    """Orders of each account over scored: account, day, symbol, score, price, unit, regime. An account's days are one task's work, met one by one."""
    return replay_keys(scored.withColumn("ts", moment("day")).drop("day"), ["account"], Trading())


def replay_stream(scored: DataFrame) -> DataFrame:
    """The same over a stream: the account is state between batches; each batch brings whole days in order."""

    def fold(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        a = Account.load(state.get[0] if state.exists else None)
        pdf = pd.concat(list(batches))
        out = list(rounds(a, pdf))
        state.update((a.dump(),))
        if out:
            yield pd.DataFrame([{"account": key[0], **o} for o in out], columns=["account", "day", "place", "symbol", "side", "qty", "mechanism", "cash"])

    return scored.groupBy("account").applyInPandasWithState(fold, ORDERS, "state string", "append", "NoTimeout")


def scored_rounds(bars: DataFrame) -> DataFrame:
    """account, day, symbol, score, price, unit, regime from bars: one account for each five symbols' mix, scored by momentum."""
    from pyspark.sql import Window as W

    w = W.partitionBy("symbol").orderBy("day")
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("close") / F.lag("close", 20).over(w) - 1) * 12))
    rows = bars.withColumn("before", F.lag("close", 20).over(w)).withColumn("score", F.round(score, 6)).where("before is not null")
    account = F.concat(F.lit("A"), (F.abs(F.hash("symbol")) % 5).cast("string"))
    return rows.select(account.alias("account"), "day", "symbol", "score", F.col("close").alias("price"), F.round(F.col("close") * 0.03, 6).alias("unit"), F.lit("risk_on").alias("regime"))
