"""Trades, lots and decisions: as-of joins, FIFO matching, attribution, behaviour."""

from __future__ import annotations

from tidewell.operators.indicators import W, rows
from tidewell.plans.compose import relation

E_ = "PARTITION BY symbol ORDER BY event"


@relation("journal", covers="FIL-07, D5")
def trade_validation(d):
    """Each trade with what is wrong with it; null where nothing is. Buys of a day come before its sells."""
    return f"SELECT event, symbol, day, side, qty, price, CASE WHEN price IS NULL THEN 'price' WHEN qty <= 0 THEN 'qty' END AS reject, CAST(row_number() OVER (PARTITION BY symbol ORDER BY day, side, event) AS BIGINT) AS place FROM journal"


@relation("journal", covers="SNK-01")
def brackets(d, stop=98, target=104):
    """Bracket orders for the buys, in ticks of a cent (below 1 of a hundredth of one), with what makes one invalid: stop, limit and target must be a cent apart at least.

    stop and target are hundredths of the price. Prices are whole ten-thousandths and all products whole
    numbers; ticks are the nearest, half to even.
    """
    part = "CAST(round(price * 10000) AS BIGINT)"

    def tick(hundredths: int) -> str:
        x, unit = f"({part} * {hundredths})", f"CASE WHEN {part} >= 10000 THEN 10000 ELSE 100 END"
        q, rest = d.whole(x, unit), f"({x} % {unit})"
        scale = f"CASE WHEN {part} >= 10000 THEN 100e0 ELSE 10000e0 END"
        return f"({q} + CASE WHEN 2 * {rest} > {unit} OR 2 * {rest} = {unit} AND {q} % 2 = 1 THEN 1 ELSE 0 END) / {scale}"

    cents = lambda x: f"CAST(round({x} * 100) AS BIGINT)"
    wrong = f"CASE WHEN price IS NULL THEN 'price' WHEN qty <= 0 THEN 'qty' WHEN {cents('stop')} > {cents('price')} - 1 THEN 'stop' WHEN {cents('target')} < {cents('price')} + 1 THEN 'target' END"
    return f"SELECT event, symbol, qty, price AS limit_, stop, target, {wrong} AS reject FROM (SELECT event, symbol, qty, {tick(100)} AS price, {tick(stop)} AS stop, {tick(target)} AS target FROM journal WHERE side = 'buy') x"


@relation("journal", "bars")
def priced(d):
    """journal with the last close on or before its day, the first on or after it, and the close ten rows after the former."""
    return f"""SELECT event, symbol, day, side, qty, mechanism, price, close AS asof_close, day_ AS asof_day, ahead AS close_10 FROM (
  SELECT event, symbol, day, side, qty, mechanism, price, {d.last('close', f'{"PARTITION BY symbol ORDER BY day, event ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"}')} AS close, {d.last('bar_day', 'PARTITION BY symbol ORDER BY day, event ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS day_, {d.last('ahead_known', 'PARTITION BY symbol ORDER BY day, event ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS ahead_, event >= 0 AS trade_,
    CASE WHEN {d.last('ahead_known', 'PARTITION BY symbol ORDER BY day, event ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} < 0 THEN NULL ELSE {d.last('ahead_known', 'PARTITION BY symbol ORDER BY day, event ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} END AS ahead
  FROM (SELECT event, symbol, day, side, qty, mechanism, price, CAST(NULL AS DOUBLE) AS close, CAST(NULL AS DATE) AS bar_day, CAST(NULL AS DOUBLE) AS ahead_known FROM journal
        UNION ALL SELECT -1, symbol, day, NULL, NULL, NULL, NULL, close, day, coalesce(lead(close, 10) OVER ({W}), -1e0) FROM bars) u) x WHERE trade_"""


@relation("priced", covers="JOI-03, JOI-06")
def asof_prices(d):
    return f"SELECT event, symbol, day, asof_day, {d.r('asof_close', 4)} AS asof_close, {d.r('close_10', 4)} AS close_10 FROM priced"


@relation("journal", "bars", covers="JOI-04")
def next_prices(d):
    """The first close on or after each trade's day: the union of both, read backwards."""
    over = "PARTITION BY symbol ORDER BY day DESC, event ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""SELECT event, symbol, day, next_day_, {d.r('next_close', 4)} AS next_close FROM (SELECT event, symbol, day, {d.last('bar_day', over)} AS next_day_, {d.last('close', over)} AS next_close
  FROM (SELECT event, symbol, day, CAST(NULL AS DOUBLE) AS close, CAST(NULL AS DATE) AS bar_day FROM journal UNION ALL SELECT -1, symbol, day, close, day FROM bars) u) x WHERE event >= 0"""


@relation("journal", "bars")
def located(d):
    """Each trade with the number i of the last bar up to its day (null before the first): the union of both, read once."""
    over = "PARTITION BY symbol ORDER BY day, event ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    both = f"SELECT event, symbol, day, side, qty, mechanism, price, CAST(NULL AS BIGINT) AS i FROM journal UNION ALL SELECT -1, symbol, day, NULL, NULL, NULL, NULL, CAST(row_number() OVER ({W}) - 1 AS BIGINT) FROM bars"
    return f"SELECT * FROM (SELECT event, symbol, day, side, qty, mechanism, price, {d.last('i', over)} AS i FROM ({both}) u) x WHERE event >= 0"


@relation("priced")
def matched(d):
    """Pairs of buys and sells by first in, first out. Sells beyond what is held are lost, not borrowed from later buys.

    Both sides cut the axis of cumulative quantity; between two cuts stand the next buy and the next sell from
    there on. One window forward and one backward over the cuts, no join of all pairs of a symbol.
    """
    upto = f"({E_} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    bought = f"SELECT symbol, event, sum(qty) OVER {upto} AS hi FROM priced WHERE side = 'buy'"
    running = f"SELECT symbol, event, side, sum(CASE WHEN side = 'sell' THEN qty ELSE 0 END) OVER {upto} AS sold, sum(CASE WHEN side = 'sell' THEN -qty ELSE qty END) OVER {upto} AS net FROM priced"
    covered = f"SELECT symbol, event, side, sold - greatest(0, -min(net) OVER {upto}) AS hi FROM ({running}) r"
    sold = f"SELECT symbol, event, hi FROM (SELECT symbol, event, hi, lag(hi, 1, 0) OVER ({E_}) AS lo FROM ({covered}) c WHERE side = 'sell') s WHERE hi > lo"
    cuts = f"SELECT symbol, hi, max(b) AS b, max(s) AS s FROM (SELECT symbol, hi, event AS b, CAST(NULL AS BIGINT) AS s FROM ({bought}) x UNION ALL SELECT symbol, hi, NULL, event FROM ({sold}) y) u GROUP BY symbol, hi"
    back = "PARTITION BY symbol ORDER BY hi DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    spans = f"SELECT symbol, hi - lag(hi, 1, 0) OVER (PARTITION BY symbol ORDER BY hi) AS qty, {d.last('b', back)} AS b, {d.last('s', back)} AS s FROM ({cuts}) c"
    return f"""SELECT m.symbol, m.b AS buy_event, m.s AS sell_event, b.day AS buy_day, s.day AS sell_day, coalesce(s.mechanism, 'unlabelled') AS mechanism, m.qty, coalesce(b.price, b.asof_close) AS buy_px, coalesce(s.price, s.asof_close) AS sell_px, b.price IS NULL OR s.price IS NULL AS approx
FROM ({spans}) m JOIN priced b ON b.symbol = m.symbol AND b.event = m.b JOIN priced s ON s.symbol = m.symbol AND s.event = m.s WHERE m.qty > 0"""


@relation("matched", covers="JOI-08, D7")
def fifo_pairs(d):
    return f"SELECT symbol, buy_event, sell_event, CAST(qty AS BIGINT) AS qty, {d.days('sell_day', 'buy_day')} AS days, {d.r('sell_px / buy_px - 1')} AS ret FROM matched"


@relation("matched", covers="AGG-05, AGG-06")
def attribution(d):
    """By mechanism of the sell: pairs, share that gain, mean return, profit, days, pairs with an approximate price."""
    return f"""SELECT mechanism, CAST(count(*) AS BIGINT) AS n, {d.r('avg(CASE WHEN sell_px > buy_px THEN 1e0 ELSE 0e0 END)')} AS win_rate, {d.r('avg(sell_px / buy_px - 1)')} AS avg_ret, {d.r('sum((sell_px - buy_px) * qty)', 2)} AS total_pnl, {d.r(f'avg(CAST({d.days("sell_day", "buy_day")} AS DOUBLE))', 4)} AS avg_days, CAST(sum(CASE WHEN approx THEN 1 ELSE 0 END) AS BIGINT) AS approx FROM matched GROUP BY mechanism"""


@relation("journal", "matched")
def open_lots(d):
    """Buys with what is left of them."""
    return f"SELECT j.symbol, j.event, j.day, j.qty - coalesce(m.sold, 0) AS left_ FROM journal j LEFT JOIN (SELECT buy_event, sum(qty) AS sold FROM matched GROUP BY buy_event) m ON m.buy_event = j.event WHERE j.side = 'buy' AND j.qty - coalesce(m.sold, 0) > 0"


@relation("open_lots", covers="AGG-07")
def reconciled_lots(d, share=2):
    """Open lots cut, oldest first, to a broker's quantity (here 1/share of the journal's)."""
    return f"""SELECT symbol, event, CAST(greatest(0, left_ - greatest(0, total - target - before)) AS BIGINT) AS qty FROM (
  SELECT symbol, event, left_, coalesce(sum(left_) OVER ({E_} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(left_) OVER (PARTITION BY symbol) AS total, floor(sum(left_) OVER (PARTITION BY symbol) / {share}) AS target FROM open_lots) x WHERE left_ - greatest(0, total - target - before) > 0"""


@relation("matched", "bench_close", covers="AGG-08")
def trade_benchmark(d):
    """Trades against the benchmark over the same days: population beta, alpha, information ratio, share that beat it; five at least."""
    beta = "covar_pop(r, b) / nullif(var_pop(b), 0)"
    return f"""SELECT symbol, CAST(count(*) AS BIGINT) AS n, {d.r(beta, 4)} AS beta, {d.r(f'avg(r) - ({beta}) * avg(b)', 5)} AS alpha, {d.r('avg(r - b) / nullif(stddev_pop(r - b), 0)', 5)} AS ir, {d.r('avg(CASE WHEN r > b THEN 1e0 ELSE 0e0 END)')} AS beat_rate
FROM (SELECT m.symbol, sell_px / buy_px - 1 AS r, y.close / x.close - 1 AS b FROM matched m JOIN bench_close x ON x.day = m.buy_day JOIN bench_close y ON y.day = m.sell_day) q GROUP BY symbol HAVING count(*) >= 5"""


@relation("located", "numbered", covers="AGG-09")
def chasing(d):
    """Where in the range of the last 21 rows the close of a buy's day is: mean, and share from 0.8 on."""
    f = rows(21)
    ranges = f"SELECT symbol, i, close, min(close) OVER {f} AS lo, max(close) OVER {f} AS hi, count(*) OVER {f} AS k FROM numbered"
    return f"""SELECT CAST(count(*) AS BIGINT) AS n, {d.r('avg(p)')} AS avg_pct, {d.r('avg(CASE WHEN p >= 0.8 THEN 1e0 ELSE 0e0 END)')} AS share_top FROM (
  SELECT (b.close - b.lo) / (b.hi - b.lo) AS p FROM located j JOIN ({ranges}) b ON b.symbol = j.symbol AND b.i = j.i WHERE j.side = 'buy' AND b.k >= 15 AND b.hi > b.lo) x HAVING count(*) >= 5"""


@relation("journal", "matched", covers="AGG-10, STR-16 (weeks)")
def frequency(d):
    """Orders by ISO week at most and on average, and the share of pairs held three days at most."""
    return f"""SELECT weeks, orders, most, {d.r('orders / CAST(weeks AS DOUBLE)', 4)} AS per_week, (SELECT {d.r(f'avg(CASE WHEN {d.days("sell_day", "buy_day")} <= 3 THEN 1e0 ELSE 0e0 END)')} FROM matched) AS churn
FROM (SELECT CAST(count(*) AS BIGINT) AS weeks, CAST(sum(n) AS BIGINT) AS orders, CAST(max(n) AS BIGINT) AS most FROM (SELECT {d.part('isoyear', 'day')} AS y, {d.part('week', 'day')} AS w, count(*) AS n FROM journal GROUP BY {d.part('isoyear', 'day')}, {d.part('week', 'day')}) x) q"""


@relation("priced", covers="AGG-11")
def exit_quality(d):
    """Mean return of the ten rows after a sell, by mechanism and over all."""
    return f"SELECT coalesce(mechanism, CASE WHEN grouping(mechanism) = 1 THEN 'all' ELSE 'unlabelled' END) AS mechanism, CAST(count(*) AS BIGINT) AS n, {d.r('avg(close_10 / asof_close - 1)')} AS forward FROM priced WHERE side = 'sell' AND close_10 IS NOT NULL GROUP BY GROUPING SETS ((), (mechanism)) HAVING count(*) >= 5"


@relation("matched", covers="AGG-12")
def holding_days(d):
    """Mean days held and the upper median: the element at n // 2 in order."""
    return f"SELECT symbol, CAST(max(n) AS BIGINT) AS n, {d.r('avg(CAST(days AS DOUBLE))', 4)} AS mean, max(CASE WHEN k = {d.whole('n', '2')} THEN days END) AS median FROM (SELECT symbol, days, row_number() OVER (PARTITION BY symbol ORDER BY days) - 1 AS k, count(*) OVER (PARTITION BY symbol) AS n FROM (SELECT symbol, {d.days('sell_day', 'buy_day')} AS days FROM matched) a) x GROUP BY symbol"


@relation("journal", "priced", covers="AGG-13, STR-05, JOI-19")
def scoreboard(d):
    """Decisions by source, the first of each symbol, day and source: settled after ten rows, hits in their direction, mean return in their direction; the rest stay pending."""
    r = "CASE WHEN side = 'buy' THEN 1 ELSE -1 END * (close_10 / asof_close - 1)"
    return f"SELECT coalesce(mechanism, 'unlabelled') AS source, CAST(count(close_10) AS BIGINT) AS n, CAST(sum(CASE WHEN {r} > 0 THEN 1 ELSE 0 END) AS BIGINT) AS hits, {d.r(f'avg({r})')} AS mean, CAST(count(*) - count(close_10) AS BIGINT) AS pending FROM (SELECT *, row_number() OVER (PARTITION BY symbol, day, coalesce(mechanism, 'unlabelled') ORDER BY event) AS k FROM priced) x WHERE k = 1 GROUP BY coalesce(mechanism, 'unlabelled')"


@relation("journal", "bars", covers="AGG-22, AGG-44")
def journal_marks(d):
    """Buys at their price against the last close: share that gain, mean, best and worst symbol."""
    return f"""SELECT CAST(count(*) AS BIGINT) AS n, {d.r('avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END)')} AS win_rate, {d.r('avg(r)')} AS mean, max_by(event, r * 1e9 + event / 1e9) AS best, min_by(event, r * 1e9 + event / 1e9) AS worst FROM (
  SELECT event, l.close / price - 1 AS r FROM journal j JOIN (SELECT symbol, max_by(close, day) AS close FROM bars GROUP BY symbol) l ON l.symbol = j.symbol WHERE side = 'buy' AND price > 0) x"""


@relation("journal", "bars")
def equity_days(d):
    """symbol, day, held, close, flow: the quantity held from the next bar on or after each trade, and the money that it moved."""
    over = "PARTITION BY symbol ORDER BY day DESC, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""SELECT b.symbol, b.day, b.close, coalesce(t.dq, 0) AS dq, sum(coalesce(t.dq, 0)) OVER (PARTITION BY b.symbol ORDER BY b.day) AS held, coalesce(t.dq, 0) * b.close AS flow
FROM bars b LEFT JOIN (SELECT symbol, to_day, CAST(sum(dq) AS DOUBLE) AS dq FROM (SELECT symbol, kind, dq, {d.last('bar_day', over)} AS to_day FROM (
  SELECT symbol, day, 1 AS kind, qty * CASE WHEN side = 'buy' THEN 1 ELSE -1 END AS dq, CAST(NULL AS DATE) AS bar_day FROM journal UNION ALL SELECT symbol, day, 0, NULL, day FROM bars) u) v WHERE kind = 1 AND to_day IS NOT NULL GROUP BY symbol, to_day) t ON t.symbol = b.symbol AND t.to_day = b.day"""


@relation("equity_days", covers="WIN-37, PRJ-06, SRC-02")
def equity_curve(d):
    """Value of all positions by day, with closes carried forward on days without a bar, and the external flow."""
    over = "PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    return f"""SELECT day, {d.r('sum(value)', 4)} AS value, {d.r('sum(flow)', 4)} AS flow FROM (SELECT symbol, day, coalesce({d.last('held * close', over)}, 0) AS value, coalesce(flow, 0) AS flow FROM (
  SELECT s.symbol, c.day, e.held, e.close, e.flow FROM (SELECT DISTINCT symbol FROM equity_days) s CROSS JOIN (SELECT DISTINCT day FROM equity_days) c LEFT JOIN equity_days e ON e.symbol = s.symbol AND e.day = c.day) x) y GROUP BY day"""


@relation("equity_curve", covers="WIN-38")
def twr_returns(d):
    """Time-weighted returns; days after a value of 0 or less are left out."""
    return f"SELECT day, {d.r('(value - flow) / v0 - 1', 5)} AS r FROM (SELECT day, value, flow, lag(value) OVER (ORDER BY day) AS v0 FROM equity_curve) x WHERE v0 > 0"


@relation("equity_days", covers="JOI-17, SRC-44")
def dividends(d):
    """Dividends of 1 % of the close at each quarter's first bar, for what was held the day before; none for nothing held."""
    return f"SELECT symbol, day AS ex_date, CAST(held - dq AS BIGINT) AS shares, {d.r('(held - dq) * close * 0.01')} AS amount FROM (SELECT *, row_number() OVER (PARTITION BY symbol, {d.part('year', 'day')}, {d.part('quarter', 'day')} ORDER BY day) AS k FROM equity_days) x WHERE k = 1 AND held - dq > 0"


@relation("journal", covers="SRC-49, SRT-05, SRT-09")
def journal_tail(d, cap=500):
    return f"SELECT event, symbol, side FROM (SELECT *, row_number() OVER (ORDER BY event DESC) AS k FROM journal) x WHERE k <= {cap}"


@relation("journal", "bars", covers="MOD-08, JOI-10, SRT-06")
def rebalance(d, total=1000000):
    """Orders to equal weights: drift under 1 % is left, buys are whole shares, sells rounded and held at most; sells first."""
    return f"""SELECT symbol, side, qty, CAST(row_number() OVER (ORDER BY CASE side WHEN 'sell' THEN 0 ELSE 1 END, qty * close DESC, symbol) AS BIGINT) AS place FROM (
  SELECT symbol, close, CASE WHEN gap > 0 THEN 'buy' ELSE 'sell' END AS side, CASE WHEN gap > 0 THEN CAST(floor(gap / close) AS BIGINT) ELSE least(CAST(floor(-gap / close + 0.5) AS BIGINT), CAST(held AS BIGINT)) END AS qty FROM (
    SELECT coalesce(p.symbol, l.symbol) AS symbol, l.close, coalesce(p.held, 0) AS held, {total} / CAST(count(*) OVER () AS DOUBLE) - coalesce(p.held, 0) * l.close AS gap FROM (SELECT symbol, max_by(close, day) AS close FROM bars GROUP BY symbol) l
    FULL OUTER JOIN (SELECT symbol, greatest(0, sum(qty * CASE WHEN side = 'buy' THEN 1 ELSE -1 END)) AS held FROM journal GROUP BY symbol) p ON p.symbol = l.symbol) x WHERE abs(gap) >= {total} * 0.01) y WHERE qty > 0"""
