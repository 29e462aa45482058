"""Technical indicators over bars: windows of rows within a symbol."""

from __future__ import annotations

import math

from tidewell.plans.compose import relation

W = "PARTITION BY symbol ORDER BY day"
#: Rows of a block of an exponential mean at most.
BLOCK = 620


def rows(n: int, last: int = 0) -> str:
    """A frame of the n rows up to the current one, or up to so many rows before it."""
    return f"({W} ROWS BETWEEN {n - 1 + last} PRECEDING AND {f'{last} PRECEDING' if last else 'CURRENT ROW'})"


def full(value: str, n: int, last: int = 0, x: str = "close") -> str:
    """value over the last n rows, null before there are n."""
    return f"CASE WHEN count({x}) OVER {rows(n, last)} = {n} THEN {value} OVER {rows(n, last)} END"


def ewm(x: str, i: str, alpha: float, over: str, adjust: bool) -> str:
    """Exponential mean of x from row i = 0 of its partition on, in closed form by blocks of rows. over: PARTITION BY and ORDER BY.

    In a block powers stay in the range of a double; what the block before it leaves is added. Earlier ones
    weigh less than 1e-19 by then. All means that take ten rows or more share their blocks, and so their sorts.
    """
    part, order = over.split(" ORDER BY ")
    keep = f"({1 - alpha!r}e0)"
    size = min(BLOCK, math.ceil(60 * math.log(10) / -math.log(1 - alpha)))
    block, k = f"CAST(floor(({i}) / {size}e0) AS BIGINT)", f"(({i}) % {size})"
    here = f"power({keep}, {k}) * sum({x} * power({keep}, -{k})) OVER ({part}, {block} ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    before = f"power({keep}, {k} + 1) * coalesce(sum({x} * power({keep}, {size - 1} - {k})) OVER ({part} ORDER BY {block} RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), 0)"
    far = f"power({keep}, least(({i}) + 1, {5 * size}))"
    if adjust:
        return f"({alpha!r}e0 * ({here} + {before}) / (1 - {far}))"
    return f"({alpha!r}e0 * ({here} + {before}) + {far} * first_value({x}) OVER ({over} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"


def mean(d, x: str, n: int) -> str:
    """The mean of x over the last n rows to ten decimals, so that the order of its sum doesn't decide whether a price that equals it is above; null before there are n."""
    return d.r(full(f"avg({x})", n, 0, x), 10)


@relation("numbered")
def averages(d):
    """Moving averages, Bollinger bands, the mean volume before the row, true range."""
    prior = f"lag(close) OVER ({W})"
    return f"""SELECT symbol, day, i, n, open, high, low, close, volume, {prior} AS prev,
  {mean(d, 'close', 20)} AS ma20, {mean(d, 'close', 50)} AS ma50, {mean(d, 'close', 200)} AS ma200, {full('stddev_samp(close)', 20)} AS sd20,
  {full('avg(volume)', 20, 1, 'volume')} AS vol20, greatest(high - low, abs(high - {prior}), abs(low - {prior})) AS tr,
  max(close) OVER {rows(252)} AS max252, min(close) OVER {rows(252)} AS min252, lag(close, 21) OVER ({W}) AS back21, lag(close, 22) OVER ({W}) AS back22, lag(close, 62) OVER ({W}) AS back62
FROM numbered"""


@relation("numbered")
def macd_lines(d, fast=12, slow=26, signal=9):
    a, b, c = (2 / (n + 1) for n in (fast, slow, signal))
    return f"""SELECT symbol, day, i, close, line, {ewm('line', 'i', c, W, False)} AS sig
FROM (SELECT symbol, day, i, close, {ewm('close', 'i', a, W, False)} - {ewm('close', 'i', b, W, False)} AS line FROM numbered) x"""


@relation("numbered")
def rsi_parts(d, n=14):
    """Means of gains and losses with alpha = 1/n from the second row on, null before n of them."""
    a = 1 / n
    return f"""SELECT symbol, day, i, CASE WHEN i >= {n} THEN {ewm('gain', '(i - 1)', a, W, True)} END AS gain, CASE WHEN i >= {n} THEN {ewm('loss', '(i - 1)', a, W, True)} END AS loss
FROM (SELECT symbol, day, i, greatest(delta, 0) AS gain, greatest(-delta, 0) AS loss FROM (SELECT symbol, day, i, close - lag(close) OVER ({W}) AS delta FROM numbered) x WHERE delta IS NOT NULL) y"""


@relation("bars", covers="PRJ-01")
def simple_returns(d):
    return f"SELECT symbol, day, {d.r('r')} AS r FROM (SELECT symbol, day, close / nullif(lag(close) OVER ({W}), 0) - 1 AS r FROM bars) x WHERE r IS NOT NULL"


@relation("averages", covers="WIN-01")
def sma(d):
    return f"SELECT symbol, day, {d.r('ma20')} AS ma20, {d.r('ma50')} AS ma50, {d.r('ma200')} AS ma200 FROM averages"


@relation("averages", covers="WIN-02")
def bollinger(d):
    """Bands of 20 rows and 2 sample deviations, %B and the state of the close."""
    up, down = "ma20 + 2 * sd20", "ma20 - 2 * sd20"
    b = f"(close - ({down})) / nullif(4 * sd20, 0)"
    return f"""SELECT symbol, day, {d.r(up)} AS upper_band, {d.r(down)} AS lower_band, {d.r(b)} AS pct_b,
  CASE WHEN ma20 IS NULL THEN NULL WHEN close > {up} THEN 'above' WHEN close < {down} THEN 'below' WHEN {b} >= 0.9 THEN 'near_upper' WHEN {b} <= 0.1 THEN 'near_lower' ELSE 'inside' END AS state
FROM averages WHERE ma20 IS NOT NULL"""


@relation("rsi_parts", covers="WIN-03")
def rsi(d):
    """The three conventions for no losses: 50, 100 rounded to 1 place, and 100 also before there are enough rows."""
    v = "100 - 100 / (1 + gain / nullif(loss, 0))"
    return f"""SELECT symbol, day, {d.r(f'coalesce({v}, 50)')} AS rsi_rules, {d.r(f'CASE WHEN loss = 0 THEN 100 ELSE {v} END', 1)} AS rsi_score, {d.r(f'CASE WHEN loss = 0 OR loss IS NULL THEN 100 ELSE {v} END', 4)} AS rsi_screen FROM rsi_parts"""


@relation("macd_lines", covers="WIN-04, SRT-02")
def macd(d):
    h, p = "line - sig", f"lag(line - sig) OVER ({W})"
    return f"""SELECT symbol, day, {d.r('line')} AS macd_line, {d.r('sig')} AS signal, {d.r(h)} AS hist,
  CASE WHEN {h} > 0 AND {p} <= 0 THEN 'golden' WHEN {h} < 0 AND {p} >= 0 THEN 'death' WHEN {h} > 0 THEN 'bullish' ELSE 'bearish' END AS state FROM macd_lines"""


@relation("averages")
def atr_rows(d, n=14):
    return f"SELECT symbol, day, i, n, close, ma50, {mean(d, 'tr', n)} AS atr FROM averages"


@relation("atr_rows", covers="WIN-05, WIN-06")
def atr_zone(d):
    """Mean true range of 14 rows, and whether the close is within one of it below the 50-row mean, with stop and target."""
    inside = f"close <= ma50 AND close >= {d.r('ma50 - atr', 10)}"
    return f"""SELECT symbol, day, {d.r('atr')} AS atr, {inside} AS in_zone, {d.r('close - 1.5 * atr')} AS stop, {d.r('close + 2.5 * atr')} AS target FROM atr_rows WHERE atr IS NOT NULL AND ma50 IS NOT NULL"""


@relation("averages", covers="WIN-07")
def volume_spike(d, ratio=2.0):
    return f"SELECT symbol, day, {d.r('volume / vol20')} AS ratio FROM averages WHERE vol20 > 0 AND volume / vol20 > {ratio}"


@relation("bars")
def weekly(d):
    """symbol, week (the Sunday that ends it), close, i."""
    return f"""SELECT symbol, week, close, CAST(row_number() OVER (PARTITION BY symbol ORDER BY week) - 1 AS BIGINT) AS i FROM (SELECT symbol, {d.sunday('day')} AS week, max_by(close, day) AS close FROM bars GROUP BY symbol, {d.sunday('day')}) x"""


@relation("weekly")
def weekly_bias(d):
    """symbol, week, bias of -2 to 2: the close against its mean of 10 weeks and the sign of the MACD histogram."""
    w = "PARTITION BY symbol ORDER BY week"
    a, b, c = (2 / (n + 1) for n in (12, 26, 9))
    return f"""SELECT symbol, week, CASE WHEN n < 12 THEN NULL ELSE (CASE WHEN ma IS NULL THEN 0 WHEN close > ma THEN 1 ELSE -1 END) + (CASE WHEN line > sig THEN 1 ELSE -1 END) END AS bias
FROM (SELECT *, {ewm('line', 'i', c, w, False)} AS sig FROM (
  SELECT symbol, week, i, close, count(*) OVER (PARTITION BY symbol) AS n, CASE WHEN i >= 9 THEN {d.r(f'avg(close) OVER ({w} ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)', 10)} END AS ma, {ewm('close', 'i', a, w, False)} - {ewm('close', 'i', b, w, False)} AS line FROM weekly) x) y"""


@relation("bars", "weekly_bias", covers="WIN-08, JOI-05")
def weekly_bias_daily(d):
    """The bias of the last finished week for each day: shifted by a week, then carried forward in one window over both."""
    both = f"""SELECT symbol, day, CAST(NULL AS BIGINT) AS bias, 1 AS is_day FROM bars
  UNION ALL SELECT symbol, week AS day, CAST(coalesce(lag(bias) OVER (PARTITION BY symbol ORDER BY week), 0) AS BIGINT) AS bias, 0 AS is_day FROM weekly_bias"""
    return f"""SELECT symbol, day, coalesce(bias, 0) AS bias FROM (
  SELECT symbol, day, is_day, {d.last('bias', 'PARTITION BY symbol ORDER BY day, is_day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW')} AS bias FROM ({both}) x) y WHERE is_day = 1"""


@relation("averages", "macd_lines", "rsi_parts")
def state(d):
    """All that the entry rules look at, and the same of the row before."""
    v = "coalesce(100 - 100 / (1 + r.gain / nullif(r.loss, 0)), 50)"
    cols = "close ma20 ma50 ma200 up down line sig rsi".split()
    lagged = ", ".join(f"lag({c}) OVER ({W}) AS {c}_0" for c in cols)
    return f"""SELECT symbol, day, i, n, {', '.join(cols)}, {lagged} FROM (
  SELECT a.symbol, a.day, a.i, a.n, a.close, ma20, ma50, ma200, ma20 + 2 * sd20 AS up, ma20 - 2 * sd20 AS down, m.line, m.sig, {v} AS rsi
  FROM averages a JOIN macd_lines m ON m.symbol = a.symbol AND m.day = a.day LEFT JOIN rsi_parts r ON r.symbol = a.symbol AND r.day = a.day) x"""


def crosses(a: str, b: str, up: bool, const: bool = False) -> str:
    """a crosses b: strictly now, not strictly on the row before; null is no."""
    s, t = (">", "<=") if up else ("<", ">=")
    return f"coalesce({a} {s} {b} AND {a}_0 {t} {b if const else b + '_0'}, false)"


#: Rule, entry condition, whether it sells short.
RULES = [
    ("rsi_below_30", crosses("rsi", "30", False, True), False),
    ("rsi_above_70_short", crosses("rsi", "70", True, True), True),
    ("macd_golden", crosses("line", "sig", True), False),
    ("macd_death_short", crosses("line", "sig", False), True),
    ("ma20_50_golden", crosses("ma20", "ma50", True), False),
    ("lower_band", crosses("close", "down", False), False),
    ("upper_band", crosses("close", "up", True), False),
    ("triple_confirmation", f"{crosses('line', 'sig', True)} AND coalesce(rsi < 60 AND close > ma200, false)", False),
    ("golden_above_ma200", f"{crosses('ma20', 'ma50', True)} AND coalesce(close > ma200, false)", False),
]


@relation("state")
def entries(d):
    """symbol, rule, short, day, i, n of each entry."""
    case = " ".join(f"WHEN '{r}' THEN {c}" for r, c, _ in RULES)
    values = ", ".join(f"('{r}', {str(s).lower()})" for r, _, s in RULES)
    return f"SELECT symbol, rule, short, day, i, n FROM state CROSS JOIN (VALUES {values}) AS rules(rule, short) WHERE CASE rule {case} END"


@relation("entries", covers="WIN-09, WIN-10")
def entry_rules(d):
    return "SELECT symbol, rule, short, day FROM entries"


@relation("averages", "macd_lines", "rsi_parts")
def score_parts(d):
    """The five parts of the composite score on the last row of each symbol."""
    clip = lambda x: f"greatest(-1e0, least(1e0, {x}))"
    rsi = "CASE WHEN r.loss = 0 THEN 100 ELSE round(100 - 100 / (1 + r.gain / nullif(r.loss, 0)), 1) END"
    b = "(a.close - (ma20 - 2 * sd20)) / nullif(4 * sd20, 0)"
    return f"""SELECT symbol, day, close, vol_ratio, round(trend, 3) AS trend, round({clip('coalesce(macd, 0)')}, 3) AS macd, round({clip('coalesce(momentum, 0)')}, 3) AS momentum,
  round({clip('CASE WHEN rsi < 35 THEN (35 - rsi) / 25 WHEN rsi > 65 THEN -(rsi - 65) / 25 ELSE 0 END')}, 3) AS rsi, round({clip('CASE WHEN b < 0.15 THEN (0.15 - b) / 0.15 WHEN b > 0.85 THEN -(b - 0.85) / 0.15 ELSE 0 END')}, 3) AS bollinger
FROM (SELECT a.symbol, a.day, a.close, CASE WHEN a.n >= 21 THEN volume / nullif(vol20, 0) END AS vol_ratio,
    coalesce(CASE WHEN a.close > ma20 THEN 0.4e0 WHEN ma20 IS NOT NULL THEN -0.4e0 END, 0) + coalesce(CASE WHEN a.close > ma50 THEN 0.35e0 WHEN ma50 IS NOT NULL THEN -0.35e0 END, 0) + coalesce(CASE WHEN a.close > ma200 THEN 0.25e0 WHEN ma200 IS NOT NULL THEN -0.25e0 END, 0) AS trend,
    CASE WHEN a.n >= 35 THEN (m.line - m.sig) / a.close * 400 END AS macd, (a.close / a.back21 - 1) * 8 AS momentum, {rsi} AS rsi, {b} AS b
  FROM averages a JOIN macd_lines m ON m.symbol = a.symbol AND m.day = a.day LEFT JOIN rsi_parts r ON r.symbol = a.symbol AND r.day = a.day WHERE a.i = a.n - 1) x"""


@relation("score_parts", covers="WIN-17, PRJ-10")
def composite_score(d):
    """The weighted score, amplified by volume, with its rating. Weights: .35, .25, .20, .10, .10."""
    raw = "0.35e0 * trend + 0.25e0 * macd + 0.2e0 * momentum + 0.1e0 * rsi + 0.1e0 * bollinger"
    score = f"greatest(-1e0, least(1e0, ({raw}) * (1 + CASE WHEN vol_ratio > 1.5 THEN least(0.15e0, (vol_ratio - 1.5) * 0.1) ELSE 0 END)))"
    return f"""SELECT symbol, day, trend, macd, momentum, rsi, bollinger, round(score, 3) AS score,
  CASE WHEN score >= 0.5 THEN 'strong_buy' WHEN score >= 0.2 THEN 'buy' WHEN score > -0.2 THEN 'neutral' WHEN score > -0.5 THEN 'sell' ELSE 'strong_sell' END AS rating
FROM (SELECT *, {score} AS score FROM score_parts) x"""


@relation("composite_score", covers="SRT-03, FIL-10")
def leaders(d, k=5):
    """The k highest and lowest scores, and which are far enough from 0 to report."""
    return f"""SELECT symbol, score, CAST(place AS BIGINT) AS place, score >= 0.2 AS bullish, score <= -0.2 AS bearish FROM (
  SELECT symbol, score, row_number() OVER (ORDER BY score DESC, symbol) AS place, count(*) OVER () AS n FROM composite_score) x WHERE place <= {k} OR place > n - {k}"""


@relation("composite_score", "state", "atr_rows", "averages", covers="WIN-18, WIN-19, MOD-01")
def watch_scan(d, capital=100000, risk=0.01):
    """For each symbol of 20 rows or more: score, the signals of the last row, a size by its true range."""
    sig = [("golden_cross", crosses("ma20", "ma50", True)), ("macd_golden", crosses("line", "sig", True)), ("macd_death", crosses("line", "sig", False)), ("oversold", "coalesce(rsi < 30, false)"), ("overbought", "coalesce(rsi > 70, false)"), ("below_band", "coalesce(close < down, false)"), ("above_band", "coalesce(close > up, false)")]
    joined = "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in sig) + ")"
    size = f"CAST(floor({capital} * {risk} / nullif(2 * t.atr, 0)) AS BIGINT)"
    return f"""SELECT s.symbol, c.score, {joined} AS signals, {d.r('t.atr', 4)} AS atr, {size} AS shares, {d.r('s.close - 2 * t.atr', 4)} AS stop
FROM state s JOIN (SELECT symbol, score FROM composite_score) c ON c.symbol = s.symbol JOIN (SELECT symbol, day, atr FROM atr_rows) t ON t.symbol = s.symbol AND t.day = s.day WHERE s.i = s.n - 1 AND s.n >= 20"""


@relation("returns", covers="WIN-20, AGG-30")
def rolling_risk(d, n=30):
    return f"""SELECT symbol, day, {d.r('vol')} AS vol, {d.r('m / nullif(s, 0) * sqrt(252e0)')} AS sharpe FROM (
  SELECT symbol, day, {full('stddev_samp(r)', n, 0, 'r')} * sqrt(252e0) AS vol, {full('avg(r)', n, 0, 'r')} AS m, {full('stddev_samp(r)', n, 0, 'r')} AS s FROM returns) x WHERE vol IS NOT NULL"""


@relation("paired", covers="WIN-21")
def rolling_beta(d, n=60):
    return f"SELECT symbol, day, {d.r('c / nullif(v, 0)', 4)} AS beta FROM (SELECT symbol, day, {full('covar_samp(r, b)', n, 0, 'r')} AS c, {full('var_samp(b)', n, 0, 'b')} AS v FROM paired) x WHERE c IS NOT NULL"


@relation("bars", covers="WIN-23")
def compounded(d, h=10):
    return f"SELECT symbol, day, {d.r(f'close / lag(close, {h}) OVER ({W}) - 1')} AS ret FROM bars"


@relation("bars")
def drawdown(d):
    return f"SELECT symbol, day, close / max(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM bars"


@relation("drawdown", covers="WIN-24")
def drawdown_curve(d):
    return f"SELECT symbol, day, {d.r('dd')} AS dd FROM drawdown"


@relation("drawdown", covers="WIN-25, SRT-05")
def drawdown_periods(d, k=5):
    """The k deepest spells below a peak: peak day, trough, recovery (null while open), depth, days."""
    return f"""SELECT symbol, peak, trough, recovery, {d.r('depth')} AS depth, {d.days('coalesce(recovery, last_day_)', 'peak')} AS days FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY depth, peak) AS k FROM (
    SELECT symbol, island, min(day) AS peak, min(CASE WHEN dd = low THEN day END) AS trough, min(dd) AS depth, max(day) AS last_day_, max(next_) AS recovery FROM (
      SELECT symbol, day, dd, island, min(dd) OVER (PARTITION BY symbol, island) AS low, min(CASE WHEN dd = 0 THEN day END) OVER ({W} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ FROM (
        SELECT symbol, day, round(dd, 12) AS dd, sum(CASE WHEN dd = 0 THEN 1 ELSE 0 END) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM drawdown) a) b
    GROUP BY symbol, island HAVING min(dd) < 0) c) e WHERE k <= {k}"""


@relation("averages", covers="WIN-28")
def regimes(d):
    """Price against its 50-row mean and one-month momentum, with a lag of 22 rows and of 21."""
    lab = lambda m: f"CASE WHEN ma50 IS NULL OR {m} IS NULL THEN NULL WHEN close > ma50 AND {m} > 0 THEN 'risk_on' WHEN close < ma50 AND {m} < 0 THEN 'risk_off' ELSE 'neutral' END"
    return f"SELECT symbol, day, {lab('(close / back22 - 1)')} AS regime, {lab('(close / back21 - 1)')} AS bot_regime FROM averages"


@relation("averages", covers="AGG-43")
def trend_fields(d):
    return f"""SELECT symbol, {d.r('close')} AS price, {d.r('(close - min252) / nullif(max252 - min252, 0)')} AS position_52w, {d.r('close / ma50 - 1')} AS dev50, {d.r('close / ma200 - 1')} AS dev200 FROM averages WHERE i = n - 1"""


@relation("averages", "universe", covers="AGG-45")
def snapshot(d):
    """The last close by industry: change over one row, and over 21 rows (over one where there are fewer)."""
    return f"SELECT u.industry, a.symbol, {d.r('close')} AS last_, {d.r('close / prev - 1')} AS chg1, {d.r('close / coalesce(back21, prev) - 1')} AS chg22 FROM averages a JOIN universe u ON u.symbol = a.symbol WHERE i = n - 1"


@relation("averages", covers="AGG-37")
def breadth(d):
    """The share of symbols above their 50-row mean by day, where six have one."""
    return f"SELECT day, {d.r('avg(CASE WHEN close > ma50 THEN 1e0 ELSE 0e0 END)')} AS share FROM averages WHERE ma50 IS NOT NULL GROUP BY day HAVING count(*) >= 6"


@relation("bars", covers="WIN-30")
def rotation(d, n=10):
    """Relative rotation by week (to Friday): z-score of the ratio to the mean of all, and of its change; population deviations."""
    w = "PARTITION BY symbol ORDER BY week"
    f = f"({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    z = lambda x: f"CASE WHEN count({x}) OVER {f} = {n} THEN 100 + ({x} - avg({x}) OVER {f}) / nullif(stddev_pop({x}) OVER {f}, 0) END"
    quad = "CASE WHEN ratio >= 100 AND mom >= 100 THEN 'leading' WHEN ratio >= 100 THEN 'weakening' WHEN mom >= 100 THEN 'improving' ELSE 'lagging' END"
    return f"""SELECT symbol, week, {d.r('ratio', 4)} AS ratio, {d.r('mom', 4)} AS mom, {quad} AS quadrant FROM (
  SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY week DESC) AS k FROM (
    SELECT symbol, week, ratio, {z('change')} AS mom FROM (
      SELECT symbol, week, ratio, ratio - lag(ratio) OVER ({w}) AS change FROM (
        SELECT symbol, week, {z('rs')} AS ratio FROM (SELECT a.symbol, a.week, a.close / b.close * 100 AS rs FROM (SELECT symbol, {d.friday('day')} AS week, max_by(close, day) AS close FROM bars GROUP BY symbol, {d.friday('day')}) a
          JOIN (SELECT week, avg(close) AS close FROM (SELECT symbol, {d.friday('day')} AS week, max_by(close, day) AS close FROM bars GROUP BY symbol, {d.friday('day')}) q GROUP BY week) b ON b.week = a.week) s) t) u) v WHERE mom IS NOT NULL) y WHERE k <= 5"""
