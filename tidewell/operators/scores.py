"""Scores and signals that know more than one symbol's bars: calibrated weights, the weekly trend, the market's and the economy's state, a company's figures from several sources."""

from __future__ import annotations

from tidewell.plans.compose import relation, source

# Fixed values of the rules.
WEIGHTS = {"trend": 35, "macd": 25, "momentum": 20, "rsi": 10, "bollinger": 10}  # in hundredths
AGREES, DIFFERS, LEANS = 1.1, 0.8, 0.1
INVERTED, NEARLY, JOBS, PRICES = 0.0, 0.2, 0.1, 3.0


def _calibrated_by_hand() -> str:
    """Each symbol's weights as a list, and the weekly factor by a table of cases."""
    base = ", ".join(f"('{k}', {w / 100})" for k, w in WEIGHTS.items())
    values = " UNION ALL ".join(f"SELECT symbol, '{k}' AS part, {k} AS v FROM score_parts" for k in WEIGHTS)
    return f"""{source("score_parts", "calibration", "weekly_bias")}, b(part, w) AS (VALUES {base}), p AS ({values}),
a AS (SELECT p.symbol, p.part, p.v, b.w * coalesce(c.multiplier, 1) AS w FROM p JOIN b ON b.part = p.part LEFT JOIN calibration c ON c.symbol = p.symbol AND c.part = p.part),
s AS (SELECT symbol, sum(w * v) / sum(w) AS s FROM a GROUP BY symbol),
k AS (SELECT symbol, arg_max(coalesce(bias, 0), week) AS bias FROM weekly_bias GROUP BY symbol),
f AS (SELECT s.symbol, t.day, greatest(-1, least(1, s.s * CASE WHEN t.vol_ratio > 1.5 THEN 1 + least(0.15, (t.vol_ratio - 1.5) * 0.1) ELSE 1 END)) AS s, coalesce(k.bias, 0) AS bias FROM s JOIN score_parts t ON t.symbol = s.symbol LEFT JOIN k ON k.symbol = s.symbol),
g AS (SELECT symbol, day, bias, greatest(-1, least(1, s * CASE WHEN abs(s) <= 0.1 OR bias = 0 THEN 1 WHEN sign(s) = sign(bias) THEN 1.1 ELSE 0.8 END)) AS s FROM f)
SELECT symbol, day, CAST(bias AS BIGINT) AS weekly, round(s, 3) AS score, CASE WHEN s >= 0.5 THEN 'strong_buy' WHEN s >= 0.2 THEN 'buy' WHEN s > -0.2 THEN 'neutral' WHEN s > -0.5 THEN 'sell' ELSE 'strong_sell' END AS rating FROM g"""


@relation("score_parts", "calibration", "weekly_bias", covers="WIN-17, WIN-16 (applied)", oracle=_calibrated_by_hand)
def calibrated_score(d):
    """The composite score with each symbol's calibrated weights, made to add up to one, amplified by volume, then by the weekly trend.

    A score of more than a tenth grows by a tenth where the trend of the newest week goes its way, and loses a
    fifth where it goes the other way. A part without a multiplier has 1; a symbol without twelve weeks no trend.
    """
    clip = lambda x: f"greatest(-1e0, least(1e0, {x}))"
    by_part = ", ".join(f"max(CASE WHEN part = '{k}' THEN multiplier END) AS m_{k}" for k in WEIGHTS)
    wide = f"SELECT symbol, {by_part} FROM calibration GROUP BY symbol"
    week = "SELECT symbol, max_by(coalesce(bias, 0), week) AS bias FROM weekly_bias GROUP BY symbol"
    w = {k: f"{x / 100}e0 * coalesce(m.m_{k}, 1e0)" for k, x in WEIGHTS.items()}
    raw = f"({' + '.join(f'{x} * s.{k}' for k, x in w.items())}) / ({' + '.join(w.values())})"
    louder = clip(f"{raw} * (1 + CASE WHEN vol_ratio > 1.5 THEN least(0.15e0, (vol_ratio - 1.5) * 0.1) ELSE 0 END)")
    x = f"SELECT s.symbol, s.day, {louder} AS score, CAST(coalesce(k.bias, 0) AS BIGINT) AS weekly FROM score_parts s LEFT JOIN ({wide}) m ON m.symbol = s.symbol LEFT JOIN ({week}) k ON k.symbol = s.symbol"
    same = f"score > {LEANS} AND weekly >= 1 OR score < -{LEANS} AND weekly <= -1"
    other = f"score > {LEANS} AND weekly <= -1 OR score < -{LEANS} AND weekly >= 1"
    y = f"SELECT symbol, day, weekly, {clip(f'score * CASE WHEN {same} THEN {AGREES}e0 WHEN {other} THEN {DIFFERS}e0 ELSE 1e0 END')} AS score FROM ({x}) x"
    return f"""SELECT symbol, day, weekly, round(score, 3) AS score,
  CASE WHEN score >= 0.5 THEN 'strong_buy' WHEN score >= 0.2 THEN 'buy' WHEN score > -0.2 THEN 'neutral' WHEN score > -0.5 THEN 'sell' ELSE 'strong_sell' END AS rating FROM ({y}) y"""


@relation("bench_close")
def market_regime(d):
    """regime of the market on its newest day: the benchmark against its mean of 50 days, and its change over 21."""
    w = "ORDER BY day ROWS BETWEEN 49 PRECEDING AND CURRENT ROW"
    rows = f"SELECT day, close, CASE WHEN count(*) OVER ({w}) = 50 THEN avg(close) OVER ({w}) END AS ma50, lag(close, 21) OVER (ORDER BY day) AS back21, row_number() OVER (ORDER BY day DESC) AS k FROM bench_close"
    return f"SELECT CASE WHEN close > ma50 AND close > back21 THEN 'risk_on' WHEN close < ma50 AND close < back21 THEN 'risk_off' WHEN ma50 IS NOT NULL THEN 'neutral' END AS regime FROM ({rows}) x WHERE k = 1"


@relation("cross_assets", "bench_close", "orders")
def macro_series(d):
    """series, day, value: the yield curve in points, the level of prices and the share without work by month, from what the tables have."""
    month = d.month_start("CAST(o_orderdate AS DATE)")
    return f"""SELECT 'curve' AS series, day, tnx - irx AS value FROM cross_assets WHERE tnx IS NOT NULL AND irx IS NOT NULL
UNION ALL SELECT 'prices', {d.month_start('day')}, max_by(close, day) FROM bench_close GROUP BY {d.month_start('day')}
UNION ALL SELECT 'jobless', {month}, 10 * avg(CASE WHEN o_orderstatus = 'F' THEN 1e0 ELSE 0e0 END) FROM orders GROUP BY {month}"""


@relation("macro_series", covers="MOD-25, WIN-33 (signals)")
def macro_regime(d):
    """By month what was last known of curve, joblessness and inflation, which of them warn, and how risky that is.

    A curve below 0 is inverted, below 0.2 nearly; joblessness that rose by more than 0.1 since the value
    before warns; prices more than 3 % above those of twelve values before press. Inversion and joblessness
    ask for caution; other warnings are neutral; without any all is well. Values that aren't there warn of nothing.
    """
    w = "PARTITION BY series ORDER BY day"
    steps = f"SELECT series, {d.month_start('day')} AS month, day, value, value - lag(value) OVER ({w}) AS change, (value / nullif(lag(value, 12) OVER ({w}), 0) - 1) * 100 AS yoy FROM macro_series WHERE value IS NOT NULL"
    last = f"SELECT series, month, max_by(value, day) AS value, max_by(coalesce(change, 0e0), day) AS change, max_by(CASE WHEN yoy IS NULL THEN -1e9 ELSE yoy END, day) AS yoy FROM ({steps}) s GROUP BY series, month"
    wide = f"SELECT month, max(CASE WHEN series = 'curve' THEN value END) AS curve, max(CASE WHEN series = 'jobless' THEN change END) AS jobless, max(CASE WHEN series = 'prices' AND yoy > -1e9 THEN yoy END) AS inflation FROM ({last}) l GROUP BY month"
    upto = "ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    known = f"SELECT month, {', '.join(f'{d.last(c, upto)} AS {c}' for c in ('curve', 'jobless', 'inflation'))} FROM ({wide}) v"
    signals = [(f"curve < {INVERTED}", "inverted"), (f"curve >= {INVERTED} AND curve < {NEARLY}", "nearly inverted"), (f"jobless > {JOBS}", "joblessness"), (f"inflation > {PRICES}", "inflation")]
    names = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for c, n in signals) + ")"
    risk = f"CASE WHEN curve < {INVERTED} OR jobless > {JOBS} THEN 'caution' WHEN {names} = '' THEN 'ok' ELSE 'neutral' END"
    return f"SELECT month, {d.r('curve', 4)} AS curve, {d.r('jobless', 4)} AS jobless_change, {d.r('inflation', 4)} AS inflation, {names} AS signals, {risk} AS risk FROM ({known}) k"


@relation("customer", "orders", "supplier")
def company_sources(d):
    """source, symbol and figures of a company as three sources and its statements tell them: each lacks some, and some are 0."""
    one = f"SELECT c_custkey AS symbol, c_acctbal AS a, coalesce(o.total, 0e0) AS t FROM customer LEFT JOIN (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey) o ON o.o_custkey = c_custkey"
    gone = lambda x, m, r: f"CASE WHEN symbol % {m} = {r} THEN NULL ELSE {x} END"
    return f"""SELECT 'info' AS source, symbol, CASE WHEN symbol % 19 = 0 THEN 'ETF' ELSE 'EQUITY' END AS kind, CASE WHEN symbol % 4 = 0 THEN 0e0 ELSE {gone('10 + a / 100', 5, 1)} END AS price, {gone('1000 * (10 + a / 100)', 3, 2)} AS cap, {gone('5 + t / 100000', 6, 0)} AS pe, {gone('a / 50000', 4, 3)} AS roe, {gone('a / 80', 2, 1)} AS debt, {gone('a', 7, 2)} AS fcf, t AS revenue, {gone('1.2e0', 3, 0)} AS dividend, CASE WHEN symbol % 2 = 0 THEN 0.02e0 ELSE 2e0 END AS yield_, CAST(NULL AS DOUBLE) AS income, CAST(NULL AS DOUBLE) AS equity FROM ({one}) i
UNION ALL SELECT 'fast', symbol, NULL, {gone('10.5e0 + a / 100', 8, 0)}, 990 * (10 + a / 100), NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM ({one}) f WHERE symbol % 10 <> 4
UNION ALL SELECT 'statements', symbol, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, {gone('a / 3', 9, 1)}, CASE WHEN symbol % 11 = 0 THEN 0e0 ELSE 1000e0 + t / 1000 END FROM ({one}) s
UNION ALL SELECT 'backup', symbol, NULL, 11 + a / 100, 1010 * (10 + a / 100), 6 + t / 100000, a / 49000, NULL, NULL, NULL, NULL, 1.5e0, NULL, NULL FROM ({one}) b WHERE symbol % 3 <> 1"""


def _facts_by_hand() -> str:
    """A join of each source to the companies, where the operator turns rows into columns."""
    return f"""{source("company_sources")}, i AS (SELECT * FROM company_sources WHERE source = 'info'), f AS (SELECT * FROM company_sources WHERE source = 'fast'), s AS (SELECT * FROM company_sources WHERE source = 'statements'), b AS (SELECT * FROM company_sources WHERE source = 'backup'),
j AS (SELECT i.symbol, i.kind, nullif(i.price, 0) AS ip, nullif(f.price, 0) AS fp, nullif(i.cap, 0) AS ic, nullif(f.cap, 0) AS fc, i.pe, i.roe, s.income / nullif(s.equity, 0) AS er, i.debt / 100 AS de, i.fcf, i.fcf / nullif(i.revenue, 0) AS fm, i.dividend, i.yield_, b.price AS bp, b.cap AS bc, b.pe AS bpe, b.roe AS br, b.yield_ AS bby FROM i LEFT JOIN f USING (symbol) LEFT JOIN s USING (symbol) LEFT JOIN b USING (symbol))
SELECT symbol, kind, round(coalesce(ip, fp, CASE WHEN kind = 'EQUITY' THEN bp END), 4) AS price, round(coalesce(ic, fc, CASE WHEN kind = 'EQUITY' THEN bc END), 2) AS cap, CASE WHEN kind = 'EQUITY' THEN round(coalesce(pe, bpe), 4) END AS pe, CASE WHEN kind = 'EQUITY' THEN round(coalesce(roe, er, br), 6) END AS roe, CASE WHEN kind = 'EQUITY' AND roe IS NULL THEN CASE WHEN er IS NOT NULL THEN 'statements' WHEN br IS NOT NULL THEN 'backup' END WHEN kind = 'EQUITY' THEN 'info' END AS roe_from,
  CASE WHEN kind = 'EQUITY' THEN round(de, 6) END AS debt_to_equity, CASE WHEN kind = 'EQUITY' THEN round(fm, 6) END AS fcf_margin, CASE WHEN kind = 'EQUITY' THEN round(coalesce(CASE WHEN dividend IS NOT NULL AND coalesce(ip, fp) IS NOT NULL THEN dividend / coalesce(ip, fp) * 100 WHEN yield_ < 1 THEN yield_ * 100 ELSE yield_ END, bby), 4) END AS dividend_yield, kind = 'EQUITY' AS ok FROM j"""


@relation("company_sources", covers="SRC-34", oracle=_facts_by_hand)
def company_facts(d):
    """One row a company of the first source that has each figure: info, then the fast one (price and value), the statements (return on equity), the backup.

    A price or value of 0 counts as none. A fund or index has a price, but no figures of a company. Debt comes
    in percent; a dividend by its rate and price, or as a yield that is a share below 1 and a percentage above.
    """
    of = lambda s, c: f"max(CASE WHEN source = '{s}' THEN {c} END)"
    some = lambda s, c: f"nullif({of(s, c)}, 0e0)"
    wide = f"""SELECT symbol, {of('info', 'kind')} AS kind, coalesce({some('info', 'price')}, {some('fast', 'price')}) AS price, {of('backup', 'price')} AS price_b, coalesce({some('info', 'cap')}, {some('fast', 'cap')}) AS cap, {of('backup', 'cap')} AS cap_b, coalesce({of('info', 'pe')}, {of('backup', 'pe')}) AS pe,
  {of('info', 'roe')} AS roe_i, {of('statements', 'income')} / {some('statements', 'equity')} AS roe_s, {of('backup', 'roe')} AS roe_b, {of('info', 'debt')} / 100 AS de, {of('info', 'fcf')} / {some('info', 'revenue')} AS margin, {of('info', 'dividend')} AS dividend, {of('info', 'yield_')} AS yield_, {of('backup', 'yield_')} AS yield_b FROM company_sources GROUP BY symbol"""
    firm = "coalesce(kind NOT IN ('ETF', 'INDEX', 'MUTUALFUND', 'CURRENCY', 'CRYPTOCURRENCY'), true)"
    if_firm = lambda x: f"CASE WHEN {firm} THEN {x} END"
    paid = "coalesce(CASE WHEN dividend IS NOT NULL AND price IS NOT NULL THEN dividend / price * 100 WHEN yield_ < 1 THEN yield_ * 100 ELSE yield_ END, yield_b)"
    return f"""SELECT symbol, kind, {d.r(f'coalesce(price, {if_firm("price_b")})', 4)} AS price, {d.r(f'coalesce(cap, {if_firm("cap_b")})', 2)} AS cap, {if_firm(d.r('pe', 4))} AS pe, {if_firm(d.r('coalesce(roe_i, roe_s, roe_b)'))} AS roe,
  {if_firm("CASE WHEN roe_i IS NOT NULL THEN 'info' WHEN roe_s IS NOT NULL THEN 'statements' WHEN roe_b IS NOT NULL THEN 'backup' END")} AS roe_from, {if_firm(d.r('de'))} AS debt_to_equity, {if_firm(d.r('margin'))} AS fcf_margin, {if_firm(d.r(paid, 4))} AS dividend_yield, {firm} AS ok FROM ({wide}) w"""
