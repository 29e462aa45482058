"""Target weights by method, the orders that lead to them, and the value of a book in several currencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewell import registry
from tidewell.operators import portfolio
from tidewell.plans.compose import apply, relation, run, source

# Fixed values of the rules.
LEAST_TRADE, LEAST_ROWS, PLACES = 0.01, 40, 4


def targets(returns: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """method, symbol, weight: long-only weights that add up to 1 by each method, none with fewer than two symbols or least days."""
    names, mean, cov = portfolio.covariance_matrix(returns)
    days = returns.select("day").distinct().count()
    rows = []
    if len(names) >= 2 and days >= least:
        spread = cov.diagonal() ** -0.5
        by = {
            "equal": spread * 0 + 1, "inverse_vol": spread, "min_vol": portfolio.least_variance(cov), "max_sharpe": portfolio.best_sharpe(mean, cov),
            "equal_risk": portfolio.equal_risk(cov), "hrp": portfolio.hierarchical(cov),
        }
        for method, w in by.items():
            w = w.clip(0)
            rows += [(method, s, float(x)) for s, x in zip(names, w / w.sum())]
    return returns.sparkSession.createDataFrame(rows, "method string, symbol string, weight double")


@relation("bars", "journal")
def held_now(d):
    """symbol, qty, price: what the trades leave of each symbol, at the last close."""
    return "SELECT coalesce(p.symbol, l.symbol) AS symbol, coalesce(p.qty, 0e0) AS qty, l.price FROM (SELECT symbol, max_by(close, day) AS price FROM bars GROUP BY symbol) l FULL OUTER JOIN (SELECT symbol, CAST(sum(qty * CASE WHEN side = 'buy' THEN 1 ELSE -1 END) AS DOUBLE) AS qty FROM journal GROUP BY symbol) p ON p.symbol = l.symbol"


@relation("bars", "returns")
def target_weights(d):
    """method, symbol, weight: two methods that need no solver. The query of all puts the solvers' in its place."""
    return """SELECT 'equal' AS method, symbol, 1e0 / count(*) OVER () AS weight FROM (SELECT DISTINCT symbol FROM returns) a
UNION ALL SELECT 'inverse_vol', symbol, (1 / sd) / sum(1 / sd) OVER () FROM (SELECT symbol, stddev_samp(r) AS sd FROM returns GROUP BY symbol) b WHERE sd > 0"""


@relation("target_weights", "held_now")
def weight_gaps(d, least=LEAST_TRADE):
    """method, symbol, price, qty, current and target weight, total, status, shares of every symbol that is held or wanted.

    What is held short or has no price is left out of the total. A symbol that no method weighs has no
    history: it isn't sold for that. A gap under least of the total is small. Buys are whole shares, sells
    rounded and at most what is held.
    """
    book = "SELECT symbol, qty, price, CASE WHEN qty > 0 AND price > 0 THEN qty * price END AS worth FROM held_now"
    valued = f"SELECT *, sum(worth) OVER () AS total FROM ({book}) b"
    methods = f"SELECT m.method, v.symbol, v.qty, v.price, v.worth, v.total FROM ({valued}) v CROSS JOIN (SELECT DISTINCT method FROM target_weights) m"
    known = "SELECT DISTINCT symbol FROM target_weights"
    both = f"""SELECT coalesce(h.method, w.method) AS method, coalesce(h.symbol, w.symbol) AS symbol, coalesce(h.qty, 0e0) AS qty, h.price, coalesce(h.worth, 0e0) / h.total AS current_, coalesce(w.weight, 0e0) AS target, h.total, k.symbol IS NOT NULL AS known
FROM ({methods}) h FULL OUTER JOIN target_weights w ON w.method = h.method AND w.symbol = h.symbol LEFT JOIN ({known}) k ON k.symbol = coalesce(h.symbol, w.symbol)"""
    gap = f"SELECT *, (target - current_) * total AS gap FROM ({both}) x"
    status = f"""CASE WHEN NOT known THEN CASE WHEN qty <> 0 THEN 'no history' END WHEN NOT coalesce(price > 0, false) THEN CASE WHEN target > 0 OR qty <> 0 THEN 'no price' END
      WHEN qty < 0 THEN 'short' WHEN total IS NULL THEN NULL WHEN abs(gap) < {least} * total THEN CASE WHEN abs(target - current_) > 1e-9 THEN 'small' END WHEN gap > 0 THEN 'buy' ELSE 'sell' END"""
    shares = "CASE status WHEN 'buy' THEN floor(gap / price) WHEN 'sell' THEN least(floor(-gap / price + 0.5e0), floor(qty)) END"
    done = f"SELECT method, symbol, price, qty, current_, target, total, status, CAST({shares} AS BIGINT) AS shares FROM (SELECT *, {status} AS status FROM ({gap}) y) z WHERE status IS NOT NULL"
    return f"SELECT method, symbol, price, qty, current_, target, total, CASE WHEN shares <= 0 THEN 'small' ELSE status END AS status, CASE WHEN shares > 0 THEN shares END AS shares FROM ({done}) q"


@relation("weight_gaps", covers="MOD-08, JOI-10, SRT-06 (by method)")
def rebalance_orders(d):
    """Orders to the weights of each method, sells first and then by value, the turnover of one side, and what is left with why."""
    worth = "CASE WHEN shares IS NOT NULL THEN shares * price END"
    turn = f"coalesce(sum({worth}) OVER (PARTITION BY method), 0e0) / (2 * total)"
    place = f"CASE WHEN shares IS NOT NULL THEN row_number() OVER (PARTITION BY method ORDER BY CASE WHEN shares IS NULL THEN 2 WHEN status = 'sell' THEN 0 ELSE 1 END, {worth} DESC, symbol) END"
    return f"SELECT method, symbol, status, shares, {d.r(worth, 2)} AS value, {d.r('current_', PLACES)} AS current_weight, {d.r('target', PLACES)} AS target_weight, CAST({place} AS BIGINT) AS place, {d.r(turn, PLACES)} AS turnover FROM weight_gaps"


@registry.query("rebalance_solved")
def rebalance_solved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-08: the same orders to the weights that the solvers give: least variance, greatest Sharpe ratio, equal risk, hierarchical."""
    weights = targets(run(spark, sf_dir, "returns"))
    return apply(spark, "rebalance_orders", {"target_weights": weights, "held_now": run(spark, sf_dir, "held_now")})


@relation("bars")
def symbol_currency(d):
    """symbol, currency: in what a symbol is quoted, here by the length of its name."""
    return "SELECT DISTINCT symbol, CASE WHEN length(symbol) % 2 = 0 THEN 'USD' ELSE 'TWD' END AS currency FROM bars"


@relation("bench_close")
def rates(d):
    """currency, day, per_base: units of a currency for one of the base, on some of the days; the base itself is always 1."""
    return f"SELECT 'TWD' AS currency, day, 28 + close / 50 AS per_base FROM bench_close WHERE {d.days('day', 'DATE ' + repr('1990-01-01'))} % 3 = 0"


@relation("orders")
def cash_events(d):
    """currency, day, amount: money paid in and out, here of some orders."""
    return "SELECT CASE WHEN o_orderkey % 3 = 0 THEN 'TWD' ELSE 'USD' END AS currency, CAST(o_orderdate AS DATE) AS day, round(o_totalprice / 100 * CASE WHEN o_orderstatus = 'F' THEN -1 ELSE 1 END, 2) AS amount FROM orders WHERE o_orderkey % 50 < 10"


def _book_by_hand() -> str:
    """Every day with the last of each symbol, rate and sum of cash, each looked up by itself."""
    return f"""{source("equity_days", "symbol_currency", "rates", "cash_events")}, days AS (SELECT DISTINCT day FROM equity_days UNION SELECT DISTINCT day FROM rates UNION SELECT DISTINCT day FROM cash_events),
cur AS (SELECT DISTINCT currency FROM symbol_currency UNION SELECT DISTINCT currency FROM cash_events),
h AS (SELECT e.symbol, c.currency, e.day, CAST(round(e.held * e.close, 4) AS DECIMAL(24,4)) AS v FROM equity_days e JOIN symbol_currency c ON c.symbol = e.symbol),
s AS (SELECT currency, day, sum(v) AS v FROM (SELECT k.currency, d.day, h.v FROM days d CROSS JOIN (SELECT DISTINCT symbol, currency FROM h) k ASOF JOIN h ON h.symbol = k.symbol AND h.day <= d.day) x GROUP BY currency, day),
m AS (SELECT d.day, u.currency, (SELECT coalesce(sum(CAST(round(amount, 4) AS DECIMAL(24,4))), 0) FROM cash_events e WHERE e.currency = u.currency AND e.day <= d.day) AS cash, (SELECT arg_max(per_base, r.day) FROM rates r WHERE r.currency = u.currency AND r.day <= d.day) AS fx FROM days d CROSS JOIN cur u),
b AS (SELECT m.day, CAST(coalesce(s.v, 0) AS DOUBLE) AS held, CAST(m.cash AS DOUBLE) AS cash, CASE WHEN m.currency = 'USD' THEN 1e0 ELSE fx END AS fx FROM m LEFT JOIN s ON s.day = m.day AND s.currency = m.currency)
SELECT day, CASE WHEN count(*) FILTER (fx IS NULL AND held <> 0) = 0 THEN round(coalesce(sum(CASE WHEN held <> 0 THEN held / fx END), 0), 2) END AS held, CASE WHEN count(*) FILTER (fx IS NULL AND cash <> 0) = 0 THEN round(coalesce(sum(CASE WHEN cash <> 0 THEN cash / fx END), 0), 2) END AS cash,
  CASE WHEN count(*) FILTER (fx IS NULL AND held + cash <> 0) = 0 THEN round(coalesce(sum(CASE WHEN held + cash <> 0 THEN (held + cash) / fx END), 0), 2) END AS value FROM b GROUP BY day"""


@relation("equity_days", "symbol_currency", "rates", "cash_events", covers="PRJ-06", oracle=_book_by_hand)
def book_value(d, base="USD"):
    """day, held, cash, value of a book in the base currency on every day on which a price, a rate or cash changes.

    Prices, rates and cash events are one union by currency and day: what a day changes in the value held and
    in cash, and its rate. One window sums the changes and carries the rate forward. Symbols count from their
    first bar on. A leg without a rate so far makes the day's figures null unless it is 0.
    """
    exact = lambda x: f"CAST(round({x}, 4) AS DECIMAL(24,4))"
    worth = f"SELECT c.currency, e.symbol, e.day, {exact('e.held * e.close')} AS v FROM equity_days e JOIN symbol_currency c ON c.symbol = e.symbol"
    steps = f"SELECT currency, day, v - coalesce(lag(v) OVER (PARTITION BY symbol ORDER BY day), 0) AS dv FROM ({worth}) w"
    none = "CAST(0 AS DECIMAL(24,4))"
    legs = f"""SELECT currency, day, dv, {none} AS dc, CAST(NULL AS DOUBLE) AS fx FROM ({steps}) s
UNION ALL SELECT currency, day, {none}, {exact('amount')}, NULL FROM cash_events UNION ALL SELECT currency, day, {none}, {none}, per_base FROM rates"""
    by_day = f"SELECT currency, day, sum(dv) AS dv, sum(dc) AS dc, max(fx) AS fx FROM ({legs}) l GROUP BY currency, day"
    every = f"SELECT k.currency, x.day, coalesce(b.dv, 0) AS dv, coalesce(b.dc, 0) AS dc, b.fx FROM (SELECT DISTINCT day FROM ({by_day}) a) x CROSS JOIN (SELECT DISTINCT currency FROM ({by_day}) c) k LEFT JOIN ({by_day}) b ON b.currency = k.currency AND b.day = x.day"
    w = "PARTITION BY currency ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    upto = f"SELECT day, CAST(sum(dv) OVER ({w}) AS DOUBLE) AS held, CAST(sum(dc) OVER ({w}) AS DOUBLE) AS cash, CASE WHEN currency = '{base}' THEN 1e0 ELSE {d.last('fx', w)} END AS fx FROM ({every}) e"
    in_base = lambda x: f"CASE WHEN sum(CASE WHEN fx IS NULL AND {x} <> 0 THEN 1 ELSE 0 END) = 0 THEN {d.r(f'coalesce(sum(CASE WHEN {x} <> 0 THEN ({x}) / fx END), 0e0)', 2)} END"
    return f"SELECT day, {in_base('held')} AS held, {in_base('cash')} AS cash, {in_base('(held + cash)')} AS value FROM ({upto}) u GROUP BY day"
