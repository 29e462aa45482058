"""What is checked before anything is done: trades of a ledger, entries too close to what is held, events ahead, messages that are due."""

from __future__ import annotations

from tidewell.operators.calendar import holiday_rows
from tidewell.operators.dayplan import ZONE
from tidewell.plans.compose import relation, source

# Fixed values of the rules.
HIGH, MIDDLE, LEAST_DAYS, ONE_PAIR = 0.85, 0.75, 30, 0.05
PREVIEW, REVIEW, USUAL_MOVE = 21, 14, 5.0
BRIEFING_HOUR, WEEKLY_HOUR = 8.5, 18


@relation("orders")
def raw_trades(d):
    """line, day, symbol, side, qty, price, fee as a person types them, in text: orders, with some of what goes wrong."""
    text = lambda x: f"CAST({x} AS {'STRING' if d.name == 'spark' else 'VARCHAR'})"
    m = lambda k, bad, good: f"CASE WHEN o_orderkey % 41 = {k} THEN {bad} ELSE {good} END"
    return f"""SELECT o_orderkey AS line, {m(1, "'soon'", text('CAST(o_orderdate AS DATE)'))} AS day, {m(2, "' '", f"concat(' s', {text('o_custkey % 25')})")} AS symbol, {m(3, "'hold'", "CASE WHEN o_orderstatus = 'F' THEN ' SELL' ELSE 'Buy ' END")} AS side,
  {m(4, "'0'", m(5, "'ten'", text('1 + o_orderkey % 20')))} AS qty, {m(6, "'-1'", m(7, 'NULL', text(d.r('o_totalprice / 100', 2))))} AS price, {m(8, "'free'", m(9, 'NULL', "'1.5'"))} AS fee FROM orders"""


@relation("raw_trades", covers="FIL-07, D5, SRC-45")
def checked_trades(d):
    """Each row of a typed ledger with its values, or with the first thing that is wrong: date, side, qty, price, fee or symbol.

    Sides and symbols count without blanks and case. A quantity must be above 0, a price 0 or more; no fee is
    0. place is the order in which good rows count: by day, buys first.
    """
    clean = f"SELECT line, {d.date('trim(day)')} AS day, nullif(upper(trim(symbol)), '') AS symbol, lower(trim(side)) AS side, {d.number('trim(qty)')} AS qty, {d.number('trim(price)')} AS price, fee IS NOT NULL AND trim(fee) <> '' AS has_fee, {d.number('trim(fee)')} AS fee FROM raw_trades"
    wrong = "CASE WHEN day IS NULL THEN 'date' WHEN NOT coalesce(side IN ('buy', 'sell'), false) THEN 'side' WHEN NOT coalesce(qty > 0, false) THEN 'qty' WHEN NOT coalesce(price >= 0, false) THEN 'price' WHEN has_fee AND fee IS NULL THEN 'fee' WHEN symbol IS NULL THEN 'symbol' END"
    return f"SELECT line, day, symbol, side, qty, price, coalesce(fee, 0e0) AS fee, reject, CASE WHEN reject IS NULL THEN CAST(row_number() OVER (PARTITION BY symbol, reject IS NULL ORDER BY day, side, line) AS BIGINT) END AS place FROM (SELECT *, {wrong} AS reject FROM ({clean}) x) y"


def _guard_by_hand() -> str:
    """Correlations from the sums of each pair."""
    return f"""{source("returns", "held_now")}, h AS (SELECT symbol FROM (SELECT symbol, qty * price / sum(qty * price) OVER () AS w FROM held_now WHERE qty > 0 AND price > 0) x WHERE w >= 0.05),
s AS (SELECT c.symbol AS cand, o.symbol AS held, count(*) AS n, sum(c.r) AS x, sum(o.r) AS y, sum(c.r * c.r) AS xx, sum(o.r * o.r) AS yy, sum(c.r * o.r) AS xy FROM returns c JOIN returns o ON o.day = c.day AND o.symbol <> c.symbol JOIN h ON h.symbol = o.symbol GROUP BY c.symbol, o.symbol HAVING count(*) >= 30),
p AS (SELECT cand, (n * xy - x * y) / sqrt((n * xx - x * x) * (n * yy - y * y)) AS c FROM s), g AS (SELECT cand, avg(c) AS a, max(c) AS m FROM p GROUP BY cand)
SELECT DISTINCT r.symbol AS candidate, round(a, 3) AS mean, round(m, 3) AS highest, CASE WHEN greatest(a, m - 0.05) >= 0.85 THEN 0.0 WHEN greatest(a, m - 0.05) >= 0.75 THEN 0.5 ELSE 1.0 END AS scale FROM returns r LEFT JOIN g ON g.cand = r.symbol"""


@relation("held_now")
def book_symbols(d, least=0.05):
    """symbol of what makes up at least a share of the book."""
    return f"SELECT symbol FROM (SELECT symbol, qty * price / sum(qty * price) OVER () AS share FROM held_now WHERE qty > 0 AND price > 0) x WHERE share >= {least}"


@relation("returns", "book_symbols", covers="JOI-15", oracle=_guard_by_hand)
def entry_guard(d, high=HIGH, middle=MIDDLE, least=LEAST_DAYS):
    """For each candidate how close its returns are to those of what is held, on the days of both, and what share of an entry that leaves.

    The mean correlation counts, or the highest less 0.05, whichever is more: none at high, half at middle,
    else all. A pair needs least days in common, and both must vary; without any pair nothing is held back.
    """
    pair = f"SELECT c.symbol AS candidate, h.symbol AS held, {d.corr('c.r', 'h.r')} AS c FROM returns c JOIN (SELECT r.* FROM returns r JOIN book_symbols b ON b.symbol = r.symbol) h ON h.day = c.day AND h.symbol <> c.symbol GROUP BY c.symbol, h.symbol HAVING count(*) >= {least}"
    close = f"SELECT candidate, avg(c) AS mean, max(c) AS highest FROM ({pair}) p WHERE c IS NOT NULL GROUP BY candidate"
    eff = f"greatest(mean, highest - {ONE_PAIR})"
    return f"SELECT s.symbol AS candidate, {d.r('mean', 3)} AS mean, {d.r('highest', 3)} AS highest, CASE WHEN {eff} >= {high} THEN 0e0 WHEN {eff} >= {middle} THEN 0.5e0 ELSE 1e0 END AS scale FROM (SELECT DISTINCT symbol FROM returns) s LEFT JOIN ({close}) g ON g.candidate = s.symbol"


@relation("option_totals", "earnings_days", "bars", covers="MOD-26 (mode)")
def earnings_outlook(d):
    """For each symbol the days to its next report and since its last one, whether to look ahead (within 21 days), back (within 14) or both, and the move that options imply by then.

    Today is the symbol's newest bar. Without an implied move or a report ahead the usual 5 % stands; the base
    case is four tenths of the move, 1 % at least.
    """
    today = "SELECT symbol, max(day) AS today FROM bars GROUP BY symbol"
    near = f"SELECT t.symbol, min(CASE WHEN e.day >= today THEN {d.days('e.day', 'today')} END) AS ahead, min(CASE WHEN e.day < today THEN {d.days('today', 'e.day')} END) AS since FROM ({today}) t LEFT JOIN earnings_days e ON e.symbol = t.symbol GROUP BY t.symbol"
    iv = "coalesce(put_iv, call_iv)"
    move = d.r(f"{iv} * sqrt(greatest(ahead, 1) / 365e0) * 100", 1)
    rows = f"SELECT n.symbol, ahead, since, CASE WHEN {iv} > 0 AND ahead IS NOT NULL THEN {move} END AS implied FROM ({near}) n LEFT JOIN option_totals o ON o.symbol = n.symbol"
    mode = f"CASE WHEN ahead <= {PREVIEW} THEN 'preview' WHEN since <= {REVIEW} THEN 'review' ELSE 'both' END"
    m = f"coalesce(implied, {USUAL_MOVE}e0)"
    return f"SELECT symbol, ahead, since, {mode} AS mode, implied, {m} AS up, {d.r(f'greatest({m} * 0.4, 1e0)', 4)} AS base, -{m} AS down FROM ({rows}) r"


@relation("events")
def moments(d):
    """owner, ts (UTC), muted_until: the moments at which a scheduler looks, here those of events; some owners are muted for a while."""
    return f"SELECT user_id % 5 AS owner, ts, CASE WHEN user_id % 5 = 3 THEN {d.after('(SELECT min(ts) FROM events)', '14400')} END AS muted_until FROM events"


@relation("moments", covers="STR-16")
def due_messages(d, hour=BRIEFING_HOUR, weekly=WEEKLY_HOUR, zone=ZONE):
    """The moment at which each message goes out: a briefing on each trading day at the first look from the hour on, a weekly one on each Sunday from the evening on, by the market's clocks; none while muted.

    One is sent for a day or an ISO week and owner, so a group and its least moment decide, not what was sent before.
    """
    at = d.local("ts", zone)
    looks = f"SELECT owner, ts, {at} AS at_, CAST({at} AS DATE) AS day FROM moments WHERE ts IS NOT NULL AND NOT coalesce(ts < muted_until, false)"
    clock = "extract(hour FROM at_) + extract(minute FROM at_) / 60e0"
    left = d.days(d.sunday("l.day"), "l.day")
    off = f"SELECT DISTINCT day FROM ({holiday_rows(d, f'SELECT CAST({at} AS DATE) AS day FROM moments')}) h"
    week = f"CAST({d.part('isoyear', 'l.day')} * 100 + {d.part('week', 'l.day')} AS BIGINT)"
    daily = f"SELECT l.owner, 'briefing' AS kind, l.day, CAST(NULL AS BIGINT) AS week, min(ts) AS ts FROM ({looks}) l LEFT JOIN ({off}) o ON o.day = l.day WHERE o.day IS NULL AND {left} >= 2 AND {clock} >= {hour}e0 GROUP BY l.owner, l.day"
    sunday = f"SELECT l.owner, 'weekly' AS kind, l.day, {week} AS week, min(ts) AS ts FROM ({looks}) l WHERE {left} = 0 AND {clock} >= {weekly} GROUP BY l.owner, l.day, {week}"
    return f"{daily} UNION ALL {sunday}"
