"""Hypothesis tests, valuation, company scores and market weather."""

from __future__ import annotations

from tidewell.plans.compose import relation


@relation("bars", covers="PRJ-04")
def basket(d):
    """The mean of five symbols, each from 1 on, on days that all have."""
    return f"SELECT day, {d.r('avg(x)', 9)} AS close FROM (SELECT symbol, day, close / first_value(close) OVER (PARTITION BY symbol ORDER BY day) AS x FROM (SELECT symbol, day, close, count(*) OVER (PARTITION BY day) AS have FROM bars WHERE symbol IN (SELECT s FROM (SELECT symbol AS s, row_number() OVER (ORDER BY symbol) AS k FROM (SELECT DISTINCT symbol FROM bars) a) b WHERE k <= 5)) y WHERE have = 5) z GROUP BY day"


@relation("basket", "bench_close")
def aligned(d):
    """day, i, n, b, m: the basket and the benchmark on the days of both."""
    return "SELECT a.day, CAST(row_number() OVER (ORDER BY a.day) - 1 AS BIGINT) AS i, CAST(count(*) OVER () AS BIGINT) AS n, a.close AS b, c.close AS m FROM basket a JOIN bench_close c ON c.day = a.day"


@relation("aligned", covers="PRJ-03")
def relative_logs(d):
    return f"SELECT day, {d.r('x', 9)} AS x FROM (SELECT day, ln(b / lag(b) OVER (ORDER BY day)) - ln(m / lag(m) OVER (ORDER BY day)) AS x FROM aligned) q WHERE x IS NOT NULL"


@relation("aligned")
def excess(d, h=20):
    """day, i, exc: from each day but the first, the basket's return over the benchmark's in the next h rows."""
    return f"SELECT day, i, exc FROM (SELECT day, i, lead(b, {h}) OVER (ORDER BY day) / b - lead(m, {h}) OVER (ORDER BY day) / m AS exc FROM aligned) x WHERE i >= 1 AND exc IS NOT NULL"


@relation("excess", covers="WIN-26")
def rolling_excess(d):
    return f"SELECT day, {d.r('exc', 9)} AS exc FROM excess"


@relation("excess", covers="AGG-23")
def date_robustness(d):
    """Mean by year, the share of days that gain, and whether 40 % of years at most lose."""
    return f"SELECT year, {d.r('m')} AS mean, {d.r('w')} AS win_share, avg(CASE WHEN m < 0 THEN 1e0 ELSE 0e0 END) OVER () <= 0.4 AS survived FROM (SELECT {d.part('year', 'day')} AS year, avg(exc) AS m, avg(CASE WHEN exc > 0 THEN 1e0 ELSE 0e0 END) AS w FROM excess GROUP BY {d.part('year', 'day')}) x"


@relation("aligned", covers="WIN-27")
def late_entry(d, back=63, h=20):
    """The mean excess after the best third of trailing excesses."""
    q = f"(SELECT i, b / lag(b, {back}) OVER (ORDER BY day) - m / lag(m, {back}) OVER (ORDER BY day) AS past, lead(b, {h}) OVER (ORDER BY day) / b - lead(m, {h}) OVER (ORDER BY day) / m AS ahead FROM aligned)"
    return f"SELECT CAST(count(*) AS BIGINT) AS n, {d.r('avg(ahead)')} AS mean FROM {q} x CROSS JOIN (SELECT {d.pct('past', 0.6666666666666666)} AS cut_ FROM {q} y) c WHERE past >= cut_ AND ahead IS NOT NULL"


@relation("excess", "bench_close", covers="AGG-24, JOI-05")
def regime_split(d):
    """Mean excess by the benchmark's state, where 60 days or more have it."""
    lab = "CASE WHEN close > ma AND close > back THEN 'risk_on' WHEN close < ma AND close < back THEN 'risk_off' ELSE 'neutral' END"
    return f"SELECT regime, CAST(count(*) AS BIGINT) AS n, {d.r('avg(exc)')} AS mean FROM excess e JOIN (SELECT day, {lab} AS regime FROM (SELECT day, close, avg(close) OVER (ORDER BY day ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS ma, lag(close, 22) OVER (ORDER BY day) AS back, row_number() OVER (ORDER BY day) AS k FROM bench_close) x WHERE k >= 50) r ON r.day = e.day GROUP BY regime HAVING count(*) >= 60"


@relation("bench_close", covers="WIN-29")
def rate_cycle(d):
    """The change over six rows of a rate: up or down by 0.25, or flat."""
    return f"SELECT day, CASE WHEN close - lag(close, 6) OVER (ORDER BY day) > 0.25 THEN 'hiking' WHEN close - lag(close, 6) OVER (ORDER BY day) < -0.25 THEN 'cutting' ELSE 'flat' END AS cycle FROM bench_close"


@relation("excess", covers="MOD-13")
def cost_survival(d, cost=0.001):
    return f"SELECT {d.r('avg(exc)')} AS gross, {d.r(f'avg(exc) - {cost}')} AS net, avg(exc) > {cost} AS survived FROM excess"


@relation("orders")
def thesis_events(d):
    """day: each day of an event once; here those of urgent orders."""
    return "SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders WHERE o_orderpriority = '1-URGENT'"


@relation("aligned", "thesis_events", covers="MOD-13 (events)")
def event_car(d, h=10):
    """The excess of the h rows from the first day after each event; four events at least, with t. Days and events meet in one window over both."""
    rows = f"SELECT day, exc, 0 AS event FROM (SELECT day, lead(b, {h}) OVER (ORDER BY day) / b - lead(m, {h}) OVER (ORDER BY day) / m AS exc FROM aligned) x WHERE exc IS NOT NULL UNION ALL SELECT day, CAST(NULL AS DOUBLE) AS exc, 1 AS event FROM thesis_events"
    next_ = d.last("exc", "ORDER BY day DESC, event ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    return f"SELECT CAST(count(*) AS BIGINT) AS n, {d.r('avg(car)')} AS mean, {d.r('avg(car) / nullif(stddev_samp(car) / sqrt(CAST(count(*) AS DOUBLE)), 0)', 4)} AS t FROM (SELECT event, {next_} AS car FROM ({rows}) y) z WHERE event = 1 AND car IS NOT NULL HAVING count(*) >= 4"


@relation("bars", covers="PRJ-05")
def periods_per_year(d):
    gap = d.pct("CAST(gap AS DOUBLE)", 0.5)
    return f"SELECT symbol, CAST(CASE WHEN {gap} >= 25 THEN 12 WHEN {gap} BETWEEN 5 AND 9 THEN 52 ELSE 252 END AS BIGINT) AS periods FROM (SELECT symbol, {d.days('day', 'lag(day) OVER (PARTITION BY symbol ORDER BY day)')} AS gap FROM bars) x GROUP BY symbol"


@relation("periods_per_year", covers="PRJ-07")
def period_risk_free(d, annual=0.04):
    """The annual risk-free rate as a rate of each symbol's period."""
    return f"SELECT symbol, periods, {d.r(f'power(1 + {annual}e0, 1e0 / periods) - 1', 9)} AS rate FROM periods_per_year"


@relation("fundamentals", covers="AGG-21")
def comparables(d):
    """Quantiles of positive multiples and, from two on, the value that their medians imply."""
    one = lambda x: ", ".join(f"{d.r(d.pct(f'CASE WHEN {x} > 0 THEN {x} END', p), 5)} AS {x}_{n}" for n, p in (("min", 0.0), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("max", 1.0)))
    return f"SELECT {one('pe')}, {one('peg')}, CASE WHEN count(CASE WHEN pe > 0 THEN 1 END) >= 2 THEN {d.r(d.pct('CASE WHEN pe > 0 THEN pe END', 0.5) + ' * 1000', 2)} END AS implied FROM fundamentals"


@relation("fundamentals", covers="MOD-17 (WACC), SRC-38")
def wacc(d, rf=0.04, erp=0.05, tax=0.21):
    """Cost of capital by market weights; without net debt the cost of equity."""
    coe, cda = f"({rf} + beta * {erp})", f"({rf} + 0.015) * (1 - {tax})"
    return f"SELECT symbol, {d.r(f'CASE WHEN debt - cash <= 0 OR cap <= 0 THEN {coe} ELSE ({coe} * cap + {cda} * (debt - cash)) / (cap + debt - cash) END')} AS wacc FROM (SELECT symbol, 1 + net_margin AS beta, pe * 1000 AS cap, debt_to_equity * 5000 AS debt, coalesce(fcf, 0) / 20 AS cash FROM fundamentals) x"


@relation("bench_close", covers="WIN-33, MOD-25")
def macro_changes(d):
    """By month: last value, change, change over twelve months and that of the month before; whether inflation rises."""
    w = "ORDER BY month"
    return f"SELECT month, {d.r('v')} AS value, {d.r(f'v - lag(v) OVER ({w})')} AS change, {d.r(f'v / lag(v, 12) OVER ({w}) - 1')} AS yoy, {d.r(f'lag(v) OVER ({w}) / lag(v, 13) OVER ({w}) - 1')} AS yoy_before, coalesce(v / lag(v, 12) OVER ({w}) > lag(v) OVER ({w}) / lag(v, 13) OVER ({w}), false) AS rising FROM (SELECT {d.month_start('day')} AS month, max_by(close, day) AS v FROM bench_close GROUP BY {d.month_start('day')}) x"


@relation("aligned")
def relative_rows(d):
    """v, i, n, m: relative log returns with their number, how many there are, and their mean."""
    return "SELECT v, CAST(row_number() OVER (ORDER BY day) - 1 AS BIGINT) AS i, CAST(count(*) OVER () AS BIGINT) AS n, avg(v) OVER () AS m FROM (SELECT day, ln(b / lag(b) OVER (ORDER BY day)) - ln(m / lag(m) OVER (ORDER BY day)) AS v FROM aligned) q WHERE v IS NOT NULL"


@relation("block_bootstrap", "date_robustness", "late_entry", "cost_survival", "event_car", "regime_split", "momentum_confound", "excess", covers="MOD-16")
def thesis_tests(d, least=252):
    """All tests of one thesis as rows: observations, the figure that decides, and whether it survived (null: too few to tell; least is for the tests on daily returns)."""
    one = "SELECT '{0}' AS test, CAST(coalesce({1}, 0) AS BIGINT) AS n, {2} AS figure, {3} AS survived FROM {4}".format
    windows = "(SELECT count(*) AS k, avg(CASE WHEN exc > 0 THEN 1e0 ELSE 0e0 END) AS win FROM excess) w"
    losing = "(SELECT avg(CASE WHEN mean < 0 THEN 1e0 ELSE 0e0 END) AS lost FROM date_robustness) y"
    return " UNION ALL ".join([
        one("T1 drift", "max(n)", "max(p)", f"CASE WHEN max(n) >= {least} THEN max(p) < 0.05 END", "block_bootstrap"),
        one("T2 dates", "k", d.r("win"), "CASE WHEN k > 0 THEN win >= 0.5 AND lost <= 0.4 END", f"{windows} CROSS JOIN {losing}"),
        one("T3 late entry", "max(n)", "max(mean)", "CASE WHEN max(n) >= 20 THEN max(mean) > 0 END", "late_entry"),
        one("T4 costs", "max(k)", "max(net)", "CASE WHEN max(k) > 0 THEN max(net) > 0 END", f"cost_survival CROSS JOIN {windows}"),
        one("T5 events", "max(n)", "max(mean)", "CASE WHEN max(n) >= 4 THEN max(mean) > 0 AND max(t) > 1 END", "event_car"),
        one("T6 regimes", "sum(n)", "min(mean)", "CASE WHEN count(*) >= 2 AND sum(n) >= 120 THEN min(mean) > 0 END", "regime_split"),
        one("T7 momentum", "max(n)", "max(alpha)", f"CASE WHEN max(n) >= {least} THEN max(alpha) > 0 AND max(t) > 1 END", "momentum_confound"),
    ])


@relation("bars", "journal", covers="SET-01, SET-02, SET-05")
def watch_symbols(d):
    """Symbols with bars and those traded, each once."""
    return "SELECT symbol FROM bars UNION SELECT symbol FROM journal"


@relation("orders", covers="FIL-03, FIL-06, SRC-37")
def upcoming(d, days=7):
    """Distinct keys and days within days of a date, nearest first."""
    today = "DATE '1997-06-01'"
    return f"SELECT DISTINCT o_custkey AS id, CAST(o_orderdate AS DATE) AS day, {d.days('CAST(o_orderdate AS DATE)', today)} AS ahead FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN {today} AND {d.plus(today, days)}"


@relation("nation", "region", covers="WIN-40")
def compound_plan(d, years=10, rate=0.06, monthly=100):
    """The balance at the end of each year of monthly savings."""
    return f"SELECT n_nationkey AS k, t, {d.r(f'{monthly}e0 * (1 + n_nationkey) * (power(1 + {rate} / 12e0, 12 * t) - 1) / ({rate} / 12e0)', 2)} AS balance FROM nation JOIN region ON r_regionkey = n_regionkey CROSS JOIN {d.series(1, years, 't')} y"
