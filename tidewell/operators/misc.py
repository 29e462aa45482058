"""Calendars, failover, state tables, triggers, levels, renderers."""

from __future__ import annotations

from tidewell.operators.indicators import W, ewm, full
from tidewell.plans.compose import relation


@relation("bars", covers="SRC-03, SRC-04")
def bar_fields(d):
    """Bars in long form: symbol, day, field, value; rows without a value are left out."""
    return " UNION ALL ".join(f"SELECT symbol, day, '{f}' AS field, {d.r(f)} AS value FROM bars WHERE {f} IS NOT NULL" for f in ("open", "high", "low", "close", "volume"))


@relation("bars", "journal", covers="SRC-06, SRC-07")
def journal_closes(d, days=60):
    """The closes of the symbols that were traded, over the last days."""
    return f"SELECT symbol, day, close FROM bars WHERE symbol IN (SELECT symbol FROM journal) AND day > {d.plus('(SELECT max(day) FROM bars)', -days)}"


@relation("insider", "fundamentals", covers="SRC-16, SRC-17")
def source_failover(d):
    """One source for each company: filings where it has any, else the second feed; with its key padded to ten digits."""
    return "SELECT f.symbol, lpad(CAST(f.symbol AS VARCHAR(10)), 10, '0') AS cik, CASE WHEN i.symbol IS NULL THEN 'feed' ELSE 'filings' END AS source FROM fundamentals f LEFT JOIN (SELECT DISTINCT symbol FROM insider) i ON i.symbol = f.symbol"


@relation("supplier", covers="SRC-28")
def loose_numbers(d):
    """Numbers written with separators or a percent sign; null where there is none."""
    text = "CASE WHEN s_suppkey % 3 = 0 THEN concat(CAST(s_suppkey AS VARCHAR(20)), '%') WHEN s_suppkey % 3 = 1 THEN concat('1,', lpad(CAST(s_suppkey % 1000 AS VARCHAR(20)), 3, '0')) ELSE '--' END"
    return f"SELECT s_suppkey AS k, {d.number(d.replaced(text, '[,%]', ''))} AS value FROM supplier"


@relation("orders", covers="SRC-36")
def statement_series(d, n=4):
    """The last n quarters of revenue of a company, oldest first."""
    q = f"{d.part('year', 'o_orderdate')} * 4 + {d.part('quarter', 'o_orderdate')}"
    return f"SELECT symbol, period, {d.r('revenue', 2)} AS revenue, CAST(row_number() OVER (PARTITION BY symbol ORDER BY period) AS BIGINT) AS place FROM (SELECT o_custkey % 25 AS symbol, {q} AS period, sum(o_totalprice) AS revenue, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY {q} DESC) AS k FROM orders GROUP BY o_custkey % 25, {q}) x WHERE k <= {n}"


@relation("part", covers="SRC-42")
def operations(d):
    """Attributes found by part of their name, one column each."""
    one = lambda word: f"max(CASE WHEN lower(p_type) LIKE '%{word}%' THEN p_retailprice END)"
    return f"SELECT p_brand AS symbol, {d.r(one('promo'), 2)} AS promo, {d.r(one('eco'), 2)} AS economy FROM part GROUP BY p_brand"


@relation("events", covers="SRC-47, SRC-48, D16")
def state_table(d, days=20):
    """The last write of each key, without keys that were quiet for days."""
    return f"SELECT user_id, max_by(event_type, event_id) AS state, max(event_id) AS version FROM events GROUP BY user_id HAVING max(CAST(ts AS DATE)) >= {d.plus('(SELECT max(CAST(ts AS DATE)) FROM events)', -days)}"


@relation("composite_score", covers="SRT-07")
def tickets(d):
    """Scores as tickets: those to act on first, then by confidence."""
    action = "CASE WHEN score >= 0.5 THEN 'buy' WHEN score <= -0.5 THEN 'sell' ELSE 'wait' END"
    return f"SELECT symbol, {action} AS action, CAST(row_number() OVER (ORDER BY CASE {action} WHEN 'buy' THEN 0 WHEN 'sell' THEN 1 ELSE 2 END, abs(score) DESC, symbol) AS BIGINT) AS place FROM composite_score"


@relation("journal", covers="SRT-10")
def stalest(d, k=4):
    return f"SELECT symbol, last_ FROM (SELECT symbol, max(day) AS last_, row_number() OVER (ORDER BY max(day), symbol) AS k FROM journal GROUP BY symbol) x WHERE k <= {k}"


@relation("fold_stats", covers="STR-17")
def trial_ledger(d, cap=50):
    """The last trials with how many there were up to each and the spread of their results so far."""
    return f"SELECT symbol, rule, fold, k, {d.r('spread', 6)} AS spread FROM (SELECT symbol, rule, fold, CAST(row_number() OVER w AS BIGINT) AS k, stddev_samp(expectancy) OVER (ORDER BY symbol, rule, fold ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS spread, count(*) OVER () AS n FROM fold_stats WINDOW w AS (ORDER BY symbol, rule, fold)) x WHERE k > n - {cap}"


@relation("numbered", covers="WIN-36")
def levels(d):
    """Exponential mean of 10 rows, volume-weighted mean of 20, MACD, all with weights that sum to one from the first row on."""
    a, b, c, s = (2 / (n + 1) for n in (12, 26, 10, 9))
    return f"SELECT symbol, day, {d.r('ema10')} AS ema10, {d.r('vwma20')} AS vwma20, {d.r('line')} AS macd_line, {d.r(ewm('line', 'i', s, W, True))} AS signal FROM (SELECT symbol, day, i, {ewm('close', 'i', c, W, True)} AS ema10, {full('sum(close * volume)', 20)} / nullif({full('sum(volume)', 20)}, 0) AS vwma20, {ewm('close', 'i', a, W, True)} - {ewm('close', 'i', b, W, True)} AS line FROM numbered) x"


@relation("bars_1h", "events", covers="FIL-09")
def sessions_kept(d):
    """Sessions that are not within a day of the type's earnings (here its highest value)."""
    return f"SELECT s.symbol, s.session FROM (SELECT DISTINCT symbol, session FROM bars_1h) s LEFT JOIN (SELECT event_type AS symbol, max_by(CAST(ts AS DATE), value + event_id / 1e9) AS day FROM events GROUP BY event_type) e ON e.symbol = s.symbol AND abs({d.days('s.session', 'e.day')}) <= 1 WHERE e.symbol IS NULL"


@relation("bars_1h", covers="SRC-05")
def plan_history(d, bars=50, days=20):
    """Intraday bars of the symbols that have more than so many of them, on more than so many days (60 where a year is at hand)."""
    enough = f"SELECT symbol FROM bars_1h GROUP BY symbol HAVING count(*) > {bars} AND count(DISTINCT session) > {days}"
    return f"SELECT symbol, session, ts, {d.r('open')} AS open, {d.r('high')} AS high, {d.r('low')} AS low, {d.r('close')} AS close, volume FROM bars_1h WHERE symbol IN ({enough})"


@relation("bars", covers="JOI-02")
def filled_pair(d):
    """Two symbols on the days of either, each carried forward."""
    over = "ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    one = lambda k: f"(SELECT day, close FROM bars WHERE symbol = (SELECT {k}(symbol) FROM bars))"
    return f"SELECT day, {d.last('a', over)} AS a, {d.last('b', over)} AS b FROM (SELECT coalesce(x.day, y.day) AS day, x.close AS a, y.close AS b FROM {one('min')} x FULL OUTER JOIN {one('max')} y ON y.day = x.day) q"


@relation("located", "numbered", covers="JOI-07")
def reactions(d):
    """The last close up to an event's day and the first after it."""
    return f"SELECT e.event, {d.r('b.close', 4)} AS before, {d.r('b.next_close', 4)} AS after, {d.r('b.next_close / b.close - 1')} AS move FROM located e JOIN (SELECT symbol, i, close, lead(close) OVER ({W}) AS next_close FROM numbered) b ON b.symbol = e.symbol AND b.i = e.i"


@relation("backtest_all", covers="SNK-05")
def report_lines(d):
    """A line of text for each symbol's best rule."""
    return "SELECT symbol, concat(symbol, ': ', rule, ' ', CAST(trades AS VARCHAR(20)), ' trades') AS line FROM backtest_all WHERE place = 1"
