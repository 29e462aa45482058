"""What was said about a symbol, held against its prices: levels of a thesis that fire, picks that are settled."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import UTC, datetime, timedelta

from tidewell.streaming.keyed import DAY, EPOCH, Fold

# Fixed values of the rules.
HORIZON, MOST_PENDING, MOST_HISTORY = 5, 30, 60
START = datetime(1970, 1, 1, tzinfo=UTC)


class Triggers(Fold):
    """Stop and target of a thesis, by owner and symbol. Rows: op, seq, word, value.

    long and short (with a word) begin or rewrite the thesis: active, both levels armed, levels kept. stop and
    target set a level above 0, and arm it again. close ends it. price is held against both levels after the
    moment's edits: a long thesis stops at or below its stop and arrives at or above its target, a short one
    the other way round. A level fires once until it is set again. A stop damages the thesis, which stays
    watched; only rewriting makes it active again. Edits before a thesis, of no value or word, and prices
    that are null or not above 0, change nothing.
    """

    out = "ts timestamp, kind string, level double, price double, status string, fired int"
    order = ("seq", "op", "value")

    def start(self) -> dict:
        return {"side": 0, "status": None, "levels": {}, "armed": {}, "fired": 0}

    def _edit(self, state: dict, op: str, word: str | None, value: float | None) -> None:
        if op in ("long", "short"):
            if (word or "").strip():
                state |= {"side": 1 if op == "long" else -1, "status": "active", "armed": {"stop": True, "target": True}}
        elif state["status"] is None:
            return
        elif op in ("stop", "target") and (value or 0) > 0:
            state["levels"][op] = float(value)
            state["armed"][op] = True
        elif op == "close":
            state["status"] = "closed"

    def step(self, state: dict, at: int, rows: list[dict]) -> Iterator[tuple]:
        prices = []
        for r in rows:
            if r["op"] == "price":
                prices.append(r["value"])
            else:
                self._edit(state, r["op"], r["word"], r["value"])
        for price in prices:
            if state["status"] not in ("active", "damaged") or (price or 0) <= 0:
                continue
            for kind, past in (("stop", -1), ("target", 1)):
                level = state["levels"].get(kind)
                if level and state["armed"].get(kind) and (price - level) * state["side"] * past >= 0:
                    state["armed"][kind] = False
                    state["fired"] += 1
                    if kind == "stop":
                        state["status"] = "damaged"
                    yield START + timedelta(microseconds=at), kind, level, float(price), state["status"], state["fired"]


class Regime(Fold):
    """The regime of a score from 0 to 100, by key. Rows: score; null ones change nothing and have no row.

    Risk is on from 60 and off up to 40; a regime is left only five beyond the limit it was entered by.
    """

    out = "day date, score double, regime string"
    order = ("score",)

    def step(self, state: dict, at: int, rows: list[dict]) -> Iterator[tuple]:
        score = rows[-1]["score"]
        if score is not None:
            before = state.get("regime")
            on, off = 60 - 5 * (before == "risk_on"), 40 + 5 * (before == "risk_off")
            state["regime"] = "risk_on" if score >= on else "risk_off" if score <= off else "neutral"
            yield EPOCH + timedelta(days=at // DAY), float(score), state["regime"]


class Picks(Fold):
    """Picks of an owner and how they came out. Rows: op (pick or price), symbol, score, price, source, horizon.

    A moment's prices settle first: a pick as old as its horizon (in days, HORIZON by default) takes the price
    of its symbol. One without a price stays until its age is above six horizons and above ten days, then it
    is dropped, at the next moment, or by itself at the end of the day if there is none. Then the moment's
    picks are noted, one for a symbol, day and source: the last MOST_PENDING stay, older ones are crowded out.
    hits and settled are of the last MOST_HISTORY settled picks. Picks without a symbol or a price above 0
    are refused; a pick of score 0 is neither a hit nor a miss.
    """

    out = "symbol string, source string, picked date, score double, entry double, horizon int, outcome string, ended date, forward double, hit boolean, hits int, settled int"
    order = ("op", "symbol", "source", "price", "score")

    def start(self) -> dict:
        return {"pending": [], "history": []}

    @staticmethod
    def _last_day(pick: dict) -> int:
        """The last day, counted from 1970, on which a pick may still be pending."""
        return pick["day"] + max(6 * pick["horizon"], 10)

    def _row(self, state: dict, pick: dict, outcome: str, ended: int, forward: float | None = None) -> tuple:
        hit = (pick["score"] > 0) == (forward > 0) if forward is not None and pick["score"] else None
        if forward is not None:
            state["history"] = [*state["history"], hit][-MOST_HISTORY:]
        judged = [h for h in state["history"] if h is not None]
        picked, last = EPOCH + timedelta(days=pick["day"]), EPOCH + timedelta(days=ended)
        return pick["symbol"], pick["source"], picked, pick["score"], pick["price"], pick["horizon"], outcome, last, forward, hit, sum(judged), len(judged)

    def step(self, state: dict, at: int, rows: list[dict]) -> Iterator[tuple]:
        today = at // DAY
        prices = {r["symbol"].upper(): r["price"] for r in rows if r["op"] == "price" and r["symbol"] and r["price"]}
        stay = []
        for pick in state["pending"]:
            if today - pick["day"] >= pick["horizon"] and pick["symbol"] in prices:
                yield self._row(state, pick, "settled", today, round(prices[pick["symbol"]] / pick["price"] - 1, 4))
            elif today > self._last_day(pick):
                yield self._row(state, pick, "dropped", today)
            else:
                stay.append(pick)
        known = {(p["symbol"], p["day"], p["source"]) for p in stay}
        for r in rows:
            if r["op"] != "pick" or not r["symbol"] or (r["price"] or 0) <= 0:
                continue
            pick = {"symbol": r["symbol"].upper(), "day": today, "source": r["source"] or "quant", "score": round(r["score"] or 0.0, 2), "price": r["price"], "horizon": HORIZON if r["horizon"] is None else max(1, r["horizon"])}
            name = (pick["symbol"], today, pick["source"])
            if name not in known:
                known.add(name)
                stay.append(pick)
        for pick in stay[:-MOST_PENDING]:
            yield self._row(state, pick, "crowded", today)
        state["pending"] = stay[-MOST_PENDING:]

    def due(self, state: dict) -> int | None:
        return min((self._last_day(p) + 2) * DAY for p in state["pending"]) if state["pending"] else None

    def end(self, state: dict, at: int) -> Iterator[tuple]:
        """The day after a pick's last one has ended without a moment."""
        today = at // DAY - 1
        for pick in state["pending"]:
            if self._last_day(pick) < today:
                yield self._row(state, pick, "dropped", today)
        state["pending"] = [p for p in state["pending"] if self._last_day(p) >= today]
