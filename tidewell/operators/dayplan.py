"""Day plans: intraday metrics as of a bar, tickets, their replay over the session, calibration and choice of parameters.

A session is evaluated every third bar from what is known by then: its own bars so far and the daily rows
strictly before it. Look-ahead (fills and exits) is a join with the later bars of the same session.
"""

from __future__ import annotations

from tidewell.operators.indicators import W
from tidewell.plans.compose import relation

# Fixed values of the rules.
STEP, LEAST_BARS, LEAST_DAYS = 3, 8, 60
RVOL_STRONG, STOP_ATR, TARGET_RR, MAX_NOTIONAL, COST = 1.5, 1.5, 2.0, 0.30, 0.001
ORB_MINUTES, SESSION_MINUTES, OPENS, ZONE = 30, 390, 9 * 60 + 30, "America/New_York"
GRID_ORB, GRID_STOP, GRID_TARGET = (15, 30, 45), (1.0, 1.5, 2.0), (1.5, 2.0, 2.5)
MIN_TRADES, VALID_TRADES, HOLDOUT_TRADES = 5, 10, 5

S = "PARTITION BY symbol, session ORDER BY k"


@relation("bars")
def bars_ts(d, zone=ZONE):
    """symbol, ts (UTC, without a zone), open, high, low, close, volume: thirteen bars a day on a path from its open to its close, from the market's opening on."""
    n = d.days("day", "DATE '1990-01-01'")
    at = lambda k: f"(open + (close - open) * ({k}) / 13e0 + close * 0.004e0 * (({n} * 7 + ({k}) * 5) % 11 - 5) * ({k}) * (13 - ({k})) / 42e0)"
    ts = d.utc(d.after("day", f"{OPENS} + {SESSION_MINUTES // 13} * (k - 1)"), zone)
    return f"""SELECT symbol, {ts} AS ts, o AS open, greatest(o, c) * (1 + 0.0005e0 * (({n} + k) % 4)) AS high, least(o, c) * (1 - 0.0005e0 * (({n} + 2 * k) % 5)) AS low, c AS close, volume / 13 * (1 + ({n} + 3 * k) % 7) / 2 AS volume
FROM (SELECT b.symbol, b.day, s.k, b.volume, {at('s.k - 1')} AS o, {at('s.k')} AS c FROM bars b CROSS JOIN {d.series(1, 13, 'k')} s) x"""


@relation("bars_ts")
def bars_intra(d, zone=ZONE):
    """symbol, session, k (from 1), minute, step, open, high, low, close, volume: bars by trading day of the market's own clocks.

    minute is what has passed since the session's first bar, step the minutes from it to the second one (5 if
    there is none): bars of any length, in any zone, over changes of the clocks. Bars without a close are none.
    """
    rows = f"SELECT symbol, CAST({d.local('ts', zone)} AS DATE) AS session, ts, open, high, low, close, volume FROM bars_ts WHERE close IS NOT NULL"
    w = "PARTITION BY symbol, session ORDER BY ts"
    since = f"SELECT *, CAST(row_number() OVER ({w}) AS BIGINT) AS k, {d.seconds('ts', f'min(ts) OVER (PARTITION BY symbol, session)')} / 60e0 AS minute FROM ({rows}) x"
    return f"SELECT symbol, session, k, minute, coalesce(nullif(max(CASE WHEN k = 2 THEN minute END) OVER (PARTITION BY symbol, session), 0e0), 5e0) AS step, open, high, low, close, volume FROM ({since}) y"


@relation("averages", "macd_lines", "rsi_parts")
def daily_facts(d):
    """By symbol and day: means, RSI, MACD histogram, true range, volume, the score of the trend and its bias."""
    rsi = "coalesce(100 - 100 / (1 + r.gain / nullif(r.loss, 0)), 50)"
    score = "(CASE WHEN ma20 > ma50 THEN 1 ELSE -1 END + CASE WHEN close > ma20 THEN 1 ELSE -1 END + CASE WHEN hist > 0 THEN 1 ELSE -1 END - CASE WHEN rsi >= 75 THEN 1 ELSE 0 END + CASE WHEN rsi <= 30 THEN 1 ELSE 0 END)"
    inner = f"""SELECT a.symbol, a.day, a.i, a.close, a.ma20, a.ma50, m.line - m.sig AS hist, {rsi} AS rsi, avg(a.tr) OVER (PARTITION BY a.symbol ORDER BY a.day ROWS BETWEEN 13 PRECEDING AND CURRENT ROW) AS atr,
    avg(a.volume) OVER (PARTITION BY a.symbol ORDER BY a.day ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS vol20 FROM averages a JOIN macd_lines m ON m.symbol = a.symbol AND m.day = a.day LEFT JOIN rsi_parts r ON r.symbol = a.symbol AND r.day = a.day"""
    return f"""SELECT symbol, day, i, close, ma20, ma50, hist, rsi, atr, vol20, score, CASE WHEN score >= 2 THEN 'bullish' WHEN score >= 0 THEN 'neutral' ELSE 'bearish' END AS bias FROM (SELECT *, {score} AS score FROM ({inner}) x WHERE ma50 IS NOT NULL) y"""


@relation("daily_facts", covers="WIN-32")
def daily_gate(d):
    """The trend of the daily rows: a point each for the means, the close and the histogram, one off for an RSI of 75 and on for 30."""
    return f"SELECT symbol, day, bias, CAST(score AS BIGINT) AS score, {d.r('rsi', 4)} AS rsi FROM daily_facts"


@relation("bars_intra", "daily_facts")
def sessions_known(d):
    """symbol, session, n (bars), and the daily row strictly before the session, if there are sixty of them."""
    both = "SELECT symbol, session AS day, 0 AS is_day, n, CAST(NULL AS BIGINT) AS i FROM (SELECT symbol, session, count(*) AS n FROM bars_intra GROUP BY symbol, session) s UNION ALL SELECT symbol, day, 1 AS is_day, 0 AS n, i FROM daily_facts"
    last = d.last("i", "PARTITION BY symbol ORDER BY day, is_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    return f"""SELECT x.symbol, x.day AS session, x.n, f.close AS prev_close, f.atr, f.vol20, f.bias FROM (SELECT symbol, day, is_day, n, {last} AS i FROM ({both}) b) x JOIN daily_facts f ON f.symbol = x.symbol AND f.i = x.i WHERE x.is_day = 0 AND f.i >= {LEAST_DAYS - 1}"""


@relation("bars_intra", "sessions_known")
def plan_points(d):
    """What is known at each bar: last price, volume-weighted price, opening ranges, gap and relative volume."""
    opening = ", ".join(f"max(CASE WHEN k = 1 OR minute < {m} THEN high END) OVER ({S}) AS orb_high_{m}, min(CASE WHEN k = 1 OR minute < {m} THEN low END) OVER ({S}) AS orb_low_{m}" for m in GRID_ORB)
    flow = f"SELECT symbol, session, k, minute + step AS passed, close AS last_, {opening}, sum(volume) OVER ({S}) AS cum, sum((high + low + close) / 3 * volume) OVER ({S}) AS paid, first_value(open) OVER ({S}) AS open_ FROM bars_intra"
    orbs = ", ".join(f"orb_high_{m}, orb_low_{m}" for m in GRID_ORB)
    return f"""SELECT b.symbol, b.session, k, n, last_, CASE WHEN cum > 0 THEN paid / cum ELSE last_ END AS vwap, {orbs}, atr, bias, CASE WHEN prev_close > 0 THEN (open_ / prev_close - 1) * 100 ELSE 0e0 END AS gap,
  CASE WHEN vol20 > 0 THEN cum / (vol20 * least(1e0, passed / greatest({SESSION_MINUTES}e0, passed / k))) ELSE 0e0 END AS rvol FROM ({flow}) b JOIN sessions_known s ON s.symbol = b.symbol AND s.session = b.session"""


@relation("plan_points", covers="WIN-31, STR-13")
def intraday_metrics(d):
    """At the end of each session: volume-weighted price, opening range, gap, volume against the share of the day that has passed, true range."""
    m = ORB_MINUTES
    return f"SELECT symbol, session, {d.r('last_')} AS last_price, {d.r('vwap')} AS vwap, {d.r(f'orb_high_{m}')} AS orb_high, {d.r(f'orb_low_{m}')} AS orb_low, {d.r('gap')} AS gap_pct, {d.r('rvol')} AS rvol, {d.r('atr')} AS atr, last_ >= vwap AS above_vwap FROM plan_points WHERE k = n"


def judged(rows: str, account: float = 100_000.0, risk: float = 0.01) -> str:
    """SELECT of rows (with orb_high, orb_low, stop_m, rr) and what a ticket would be: setup, conf, entry_lo, entry_hi, stop, target, per_share, shares.

    setup is null below the volume-weighted price, and what follows from it too.
    """
    cents = lambda x: f"(floor(({x}) * 100 + 0.5000001e0) / 100e0)"  # noqa: E731  half a cent up, whatever an engine's last digit
    setup = "CASE WHEN last_ < vwap THEN NULL WHEN last_ > orb_high THEN 'orb' ELSE 'vwap' END"
    conf = f"(CASE bias WHEN 'bullish' THEN 2 ELSE 1 END + CASE WHEN rvol >= {RVOL_STRONG} THEN 1 ELSE 0 END + CASE WHEN gap >= 1 THEN 1 WHEN gap <= -1.5 THEN -1 ELSE 0 END + CASE setup WHEN 'orb' THEN 1 ELSE 0 END)"
    low = f"CASE setup WHEN 'orb' THEN last_ WHEN 'vwap' THEN {cents('vwap')} END"
    near = cents("least(last_, vwap + 0.3e0 * atr)")
    high = f"CASE WHEN setup = 'orb' THEN {cents('last_ + 0.25e0 * atr')} WHEN {near} < lo THEN {cents('lo + 0.1e0 * atr')} ELSE {near} END"
    stop = f"CASE setup WHEN 'orb' THEN {cents('greatest(orb_low, last_ - stop_m * atr)')} WHEN 'vwap' THEN {cents('vwap - stop_m * atr')} END"
    shares = f"greatest(0, floor(least(round({account * risk}e0 / nullif(atr * stop_m, 0e0), 2), {account * risk}e0 / nullif(per_share, 0e0), floor({account * MAX_NOTIONAL}e0 / nullif(mid, 0e0)))))"
    a = f"SELECT *, {setup} AS setup FROM ({rows}) t0"
    b = f"SELECT *, {conf} AS conf, {low} AS lo, {stop} AS stop FROM ({a}) t1"
    c = f"SELECT *, {high} AS hi FROM ({b}) t2"
    e = f"SELECT *, (lo + hi) / 2 AS mid, (lo + hi) / 2 - stop AS per_share FROM ({c}) t3"
    return f"SELECT *, {cents('mid + rr * per_share')} AS target, CAST({shares} AS BIGINT) AS shares, {cents('lo')} AS entry_lo, {cents('hi')} AS entry_hi FROM ({e}) t4"


def tickets(rows: str) -> str:
    """SELECT of the rows that make a ticket, with action and what judged() tells."""
    return f"SELECT *, CASE bias WHEN 'bullish' THEN 'buy' ELSE 'trial' END AS action FROM ({judged(rows)}) t5 WHERE bias <> 'bearish' AND atr > 0 AND last_ > 0 AND setup IS NOT NULL AND conf >= 2 AND per_share > 0"


@relation("plan_points", covers="MOD-23")
def order_tickets(d):
    """The ticket at each evaluation of each session: every third bar from the fourth on, but the last."""
    m = ORB_MINUTES
    rows = f"SELECT *, orb_high_{m} AS orb_high, orb_low_{m} AS orb_low, {STOP_ATR}e0 AS stop_m, {TARGET_RR}e0 AS rr FROM plan_points WHERE k > {STEP} AND (k - 1) % {STEP} = 0 AND k < n AND n >= {LEAST_BARS}"
    return f"SELECT symbol, session, CAST(k AS BIGINT) AS k, action, setup, CAST(conf AS BIGINT) AS confidence, {d.r('entry_lo', 2)} AS entry_lo, {d.r('entry_hi', 2)} AS entry_hi, {d.r('stop', 2)} AS stop, {d.r('target', 2)} AS target, shares FROM ({tickets(rows)}) t"


def replay(d, combos: list[tuple[int, float, float]]) -> str:
    """symbol, session, combo, setup, conf, filled, fill, exit, kind, r: the first ticket of each session and what comes of it."""
    values = ", ".join(f"({n}, {m}, {s}e0, {t}e0)" for n, (m, s, t) in enumerate(combos))
    orb = lambda side: "CASE orb_m " + " ".join(f"WHEN {m} THEN orb_{side}_{m}" for m in GRID_ORB) + " END"
    rows = f"SELECT p.symbol, p.session, p.k, p.last_, p.vwap, p.gap, p.rvol, p.atr, p.bias, g.combo, g.stop_m, g.rr, {orb('high')} AS orb_high, {orb('low')} AS orb_low FROM plan_points p CROSS JOIN (VALUES {values}) AS g(combo, orb_m, stop_m, rr) WHERE p.k > {STEP} AND (p.k - 1) % {STEP} = 0 AND p.k < p.n AND p.n >= {LEAST_BARS}"
    key = "symbol, session, combo"
    first = f"SELECT {key}, min(k) AS k, " + ", ".join(f"min_by({c}, k) AS {c}" for c in "setup conf entry_lo entry_hi stop target".split()) + f" FROM ({tickets(rows)}) t GROUP BY {key}"
    same = "j.symbol = s.symbol AND j.session = s.session"
    touch = "CASE WHEN j.open BETWEEN entry_lo AND entry_hi THEN j.open WHEN j.open > entry_hi AND j.low <= entry_hi THEN entry_hi WHEN j.open < entry_lo AND j.high >= entry_lo THEN entry_lo END"
    keep = lambda *more: ", ".join(f"min({c}) AS {c}" for c in ("setup conf stop target".split() + list(more)))
    fills = f"SELECT s.symbol, s.session, s.combo, {keep()}, min(CASE WHEN {touch} IS NOT NULL THEN j.k END) AS fill_k, min_by({touch}, CASE WHEN {touch} IS NOT NULL THEN j.k END) AS fill FROM ({first}) s JOIN bars_intra j ON {same} AND j.k > s.k GROUP BY s.symbol, s.session, s.combo"
    exits = f"SELECT s.symbol, s.session, s.combo, {keep('fill', 'fill_k')}, min(CASE WHEN j.k >= fill_k THEN CASE WHEN j.low <= stop THEN 2 * j.k WHEN j.high >= target THEN 2 * j.k + 1 END END) AS hit, max_by(j.close, j.k) AS last_close FROM ({fills}) s JOIN bars_intra j ON {same} GROUP BY s.symbol, s.session, s.combo"
    out = f"SELECT *, CASE WHEN fill > stop THEN CASE WHEN hit IS NULL THEN last_close WHEN hit % 2 = 0 THEN stop ELSE target END END AS exit_ FROM ({exits}) x"
    return f"SELECT symbol, session, combo, setup, conf, fill IS NOT NULL AS filled, fill, exit_, CASE WHEN exit_ IS NULL THEN NULL WHEN hit IS NULL THEN 'eod' WHEN hit % 2 = 0 THEN 'stop' ELSE 'target' END AS kind, (exit_ - fill) / (fill - stop) - {COST}e0 * fill / (fill - stop) AS r FROM ({out}) y"


@relation("plan_points", "bars_intra")
def plan_trades(d):
    """The replay with the usual parameters: one row for each session with a ticket; r (in units of risk, after costs) is null without a fill."""
    return replay(d, [(ORB_MINUTES, STOP_ATR, TARGET_RR)])


@relation("plan_trades", covers="STR-14")
def session_replay(d):
    at = lambda x, unit: f"floor({x} * {unit} + 0.5000001e0) / {unit}e0"
    return f"SELECT symbol, session, setup, CAST(conf AS BIGINT) AS conf, filled, {at('fill', 10000)} AS fill, {at('exit_', 10000)} AS exit, kind, {at('r', 1000)} AS r, r > 0 AS win FROM plan_trades"


def totals(d) -> str:
    return f"CAST(count(*) AS BIGINT) AS signals, CAST(count(r) AS BIGINT) AS n, {d.r('avg(CASE WHEN r > 0 THEN 1e0 WHEN r IS NOT NULL THEN 0e0 END)')} AS win_rate, {d.r('avg(r)')} AS avg_r, {d.r('sum(r)', 4)} AS total_r"


@relation("plan_trades", covers="AGG-02, AGG-03")
def plan_stats(d):
    """Signals, fills, share that win, mean and total of the risk units: over all, by setup, by confidence of 2, 3, and 4 and more."""
    bucket = "CASE WHEN conf >= 4 THEN '4+' WHEN conf >= 3 THEN '3' ELSE '2' END"
    return " UNION ALL ".join(f"SELECT {of} AS of_, {key} AS key_, {totals(d)} FROM plan_trades{group}" for of, key, group in (("'all'", "'all'", ""), ("'setup'", "setup", " GROUP BY setup"), ("'confidence'", bucket, f" GROUP BY {bucket}")))


def calibration(d, trades: str) -> str:
    """SELECT of setup and how it did in the first 60% of the sessions of trades and in the rest, whether it stays enabled, and what its confidence loses."""
    by_day = f"SELECT setup, session, count(r) AS c, sum(r) AS s, dense_rank() OVER (ORDER BY session) AS p FROM {trades} GROUP BY setup, session"
    parts = f"SELECT setup, c, s, p <= greatest(1, floor(m * 0.6e0)) AS train FROM (SELECT *, max(p) OVER () AS m FROM ({by_day}) x) y WHERE m >= 10"
    part = lambda name, c: f"sum(CASE WHEN {c} THEN c ELSE 0 END) AS n_{name}, sum(CASE WHEN {c} THEN s END) / nullif(sum(CASE WHEN {c} THEN c END), 0) AS r_{name}"
    enough = f"n_train >= {MIN_TRADES} AND n_valid >= {max(2, MIN_TRADES // 2)}"
    return f"""SELECT setup, CAST(n_train AS BIGINT) AS n_train, {d.r('r_train', 3)} AS r_train, CAST(n_valid AS BIGINT) AS n_valid, {d.r('r_valid', 3)} AS r_valid, NOT coalesce({enough} AND r_train < 0 AND r_valid < 0, false) AS enabled,
  CAST(CASE WHEN {enough} AND r_train > 0 AND r_valid < 0 THEN -1 ELSE 0 END AS BIGINT) AS conf_delta FROM (SELECT setup, {part('train', 'train')}, {part('valid', 'NOT train')} FROM ({parts}) z GROUP BY setup) q"""


@relation("plan_trades", covers="MOD-24")
def plan_calibration(d):
    """By setup, from ten sessions on: off if it loses in the first 60% of sessions and in the rest, a confidence less if it only loses in the rest."""
    return calibration(d, "plan_trades")


@relation("plan_trades", "plan_points")
def applied_calibration(d):
    """setup, enabled, conf_delta from the sessions before each symbol's newest one: what a ticket of today may know."""
    before = "(SELECT t.* FROM plan_trades t JOIN (SELECT symbol, max(session) AS newest FROM plan_points GROUP BY symbol) n ON n.symbol = t.symbol AND t.session < n.newest)"
    return calibration(d, f"{before} tb")


@relation("orders", "bars")
def earnings_days(d):
    """symbol, day on which a company reports, here a third of a year after some orders."""
    return f"SELECT DISTINCT s.symbol, {d.plus('CAST(o_orderdate AS DATE)', 120)} AS day FROM orders o JOIN (SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) - 1 AS BIGINT) AS k FROM (SELECT DISTINCT symbol FROM bars) q) s ON s.k = o.o_custkey % 25 WHERE o_orderkey % 10 = 0"


@relation("plan_points", "applied_calibration", "earnings_days", covers="MOD-23, MOD-24 (answers)")
def ticket_answers(d):
    """What each evaluation of a symbol's newest session answers: buy, trial, watch or avoid, and why.

    Earnings today or tomorrow are avoided whatever else holds, then a bearish day. Watched are prices that
    make no sense or lie below the volume-weighted price, setups that the calibration has switched off,
    confidence under 2 after what the calibration takes from it, and stops at or above the entry. Only buys
    and trials have levels and shares; a confidence of 0 stands where it was not reached.
    """
    m = ORB_MINUTES
    newest = "SELECT symbol, max(session) AS session FROM plan_points GROUP BY symbol"
    points = f"SELECT p.*, orb_high_{m} AS orb_high, orb_low_{m} AS orb_low, {STOP_ATR}e0 AS stop_m, {TARGET_RR}e0 AS rr FROM plan_points p JOIN ({newest}) n ON n.symbol = p.symbol AND n.session = p.session WHERE k > {STEP} AND (k - 1) % {STEP} = 0"
    near = f"SELECT p.symbol, p.session, min({d.days('e.day', 'p.session')}) AS ahead FROM ({newest}) p JOIN earnings_days e ON e.symbol = p.symbol AND e.day >= p.session GROUP BY p.symbol, p.session"
    vetoed = f"SELECT j.*, c.enabled, coalesce(c.conf_delta, 0) AS delta, g.ahead FROM ({judged(points)}) j LEFT JOIN ({near}) g ON g.symbol = j.symbol AND g.session = j.session LEFT JOIN applied_calibration c ON c.setup = j.setup"
    why = "CASE WHEN ahead <= 1 THEN 'earnings' WHEN bias = 'bearish' THEN 'bearish' WHEN NOT coalesce(atr > 0 AND last_ > 0, false) THEN 'no data' WHEN setup IS NULL THEN 'below vwap' WHEN NOT coalesce(enabled, true) THEN 'setup off' WHEN conf + delta < 2 THEN 'confidence' WHEN NOT coalesce(per_share > 0, false) THEN 'stop' ELSE 'ok' END"
    known = "why IN ('setup off', 'confidence', 'ok')"
    level = lambda x: f"CASE WHEN why = 'ok' THEN {d.r(x, 2)} END"
    return f"""SELECT symbol, session, CAST(k AS BIGINT) AS k, CASE WHEN why IN ('earnings', 'bearish') THEN 'avoid' WHEN why <> 'ok' THEN 'watch' WHEN bias = 'bullish' THEN 'buy' ELSE 'trial' END AS action, why,
  CASE WHEN {known} OR why = 'stop' THEN setup END AS setup, CAST(CASE WHEN why = 'setup off' THEN conf WHEN {known} THEN conf + delta ELSE 0 END AS BIGINT) AS confidence, {level('entry_lo')} AS entry_lo, {level('entry_hi')} AS entry_hi,
  {level('stop')} AS stop, {level('target')} AS target, CASE WHEN why = 'ok' THEN shares END AS shares FROM (SELECT *, {why} AS why FROM ({vetoed}) v) w"""


COMBOS = [(m, s, t) for m in GRID_ORB for s in GRID_STOP for t in GRID_TARGET]


@relation("plan_points", "bars_intra")
def plan_replays(d):
    """The replay with each of the 27 parameters."""
    return replay(d, COMBOS)


@relation("plan_replays", covers="WIN-41, MOD-24 (search)")
def plan_optimize(d):
    """Each of 27 parameters by sessions: half to train, a quarter to validate, a quarter to hold out; best of training that holds in validation, recommended if it holds out."""
    base = COMBOS.index((ORB_MINUTES, STOP_ATR, TARGET_RR))
    by_day = "SELECT combo, session, count(r) AS c, sum(r) AS s, row_number() OVER (PARTITION BY combo ORDER BY session) AS p, count(*) OVER (PARTITION BY combo) AS m FROM plan_replays GROUP BY combo, session"
    i1, i2 = "greatest(1, floor(m * 0.5e0))", "greatest(greatest(1, floor(m * 0.5e0)) + 1, floor(m * 0.75e0))"
    split = f"SELECT combo, c, s, CASE WHEN p <= {i1} THEN 1 WHEN p <= {i2} THEN 2 ELSE 3 END AS part FROM ({by_day}) x WHERE m >= 20"
    stats = "SELECT combo, " + ", ".join(f"sum(CASE WHEN part = {k} THEN c ELSE 0 END) AS n{k}, sum(CASE WHEN part = {k} THEN s END) / nullif(sum(CASE WHEN part = {k} THEN c END), 0) AS r{k}" for k in (1, 2, 3)) + f" FROM ({split}) y GROUP BY combo"
    fit = f"n1 >= {MIN_TRADES} AND n2 >= {VALID_TRADES} AND r2 > 0"
    ranked = f"SELECT *, {fit} AS fit, row_number() OVER (ORDER BY CASE WHEN {fit} THEN 0 ELSE 1 END, r1 DESC, combo) AS place, max(CASE WHEN combo = {base} THEN n3 END) OVER () AS base_n, max(CASE WHEN combo = {base} THEN r3 END) OVER () AS base_r FROM ({stats}) z"
    named = [("BIGINT", 0, "orb_minutes"), ("DOUBLE", 1, "stop_atr"), ("DOUBLE", 2, "target_rr")]
    names = ", ".join(f"CAST(CASE combo {' '.join(f'WHEN {n} THEN {c[k]}' for n, c in enumerate(COMBOS))} END AS {kind}) AS {name}" for kind, k, name in named)
    best = "coalesce(fit AND place = 1, false)"
    holds = f"n3 >= {HOLDOUT_TRADES} AND CASE WHEN coalesce(base_n, 0) < {HOLDOUT_TRADES} OR base_r IS NULL THEN r3 > 0 ELSE r3 >= base_r + 0.05 END"
    return f"""SELECT {names}, CAST(n1 AS BIGINT) AS n_train, {d.r('r1', 5)} AS r_train, CAST(n2 AS BIGINT) AS n_valid, {d.r('r2', 5)} AS r_valid, CAST(n3 AS BIGINT) AS n_hold, {d.r('r3', 5)} AS r_hold,
  {best} AS best, coalesce({best} AND combo <> {base} AND {holds}, false) AS recommended FROM ({ranked}) q"""


@relation("daily_gate", covers="JOI-16")
def gate_before(d):
    """The gate of the row before each day: nothing of the day itself."""
    return f"SELECT symbol, day, lag(bias) OVER ({W}) AS bias FROM daily_gate"
