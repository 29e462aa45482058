"""Risk and performance: aggregates over returns."""

from __future__ import annotations

from tidewell.operators.indicators import W, full, rows
from tidewell.plans.compose import relation

Z95 = "1.6448536269514722e0"  # the normal quantile at 0.95


@relation("bars", covers="AGG-28")
def growth_stats(d):
    """CAGR by calendar days, deepest drawdown, Sharpe, Sortino (downside over all rows), Calmar."""
    cagr = f"power(last_ / first_, 365.25e0 / nullif({d.days('to_', 'from_')}, 0)) - 1"
    return f"""SELECT symbol, {d.r(cagr)} AS cagr, {d.r('max_dd')} AS max_dd, {d.r('m / nullif(s, 0) * sqrt(252e0)', 5)} AS sharpe, {d.r('m / nullif(down, 0) * sqrt(252e0)', 5)} AS sortino, {d.r(f'({cagr}) / nullif(abs(max_dd), 0)', 5)} AS calmar
FROM (SELECT symbol, min_by(close, day) AS first_, max_by(close, day) AS last_, min(day) AS from_, max(day) AS to_, min(dd) AS max_dd, avg(r) AS m, stddev_samp(r) AS s, sqrt(sum(CASE WHEN r < 0 THEN r * r ELSE 0 END) / nullif(count(r), 0)) AS down
  FROM (SELECT symbol, day, close, close / lag(close) OVER ({W}) - 1 AS r, close / max(close) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM bars) x GROUP BY symbol) y"""


@relation("paired", covers="AGG-29, AGG-35, JOI-01")
def tear_sheet(d, rf=0.0):
    """Moments (bias-corrected), 5th percentile, alpha, beta and correlation with the benchmark, excess Sharpe, information ratio, Treynor."""
    beta = "covar_samp(r, b) / nullif(var_samp(b), 0)"
    return f"""SELECT symbol, CAST(count(*) AS BIGINT) AS n, {d.r('avg(r) * 252')} AS mean, {d.r('stddev_samp(r) * sqrt(252e0)')} AS vol, {d.r(d.g1('r'), 4)} AS skew, {d.r(d.g2('r'), 4)} AS kurt, {d.r(d.pct('r', 0.05))} AS p5,
  {d.r(beta, 5)} AS beta, {d.r(f'(avg(r) - ({beta}) * avg(b)) * 252', 5)} AS alpha, {d.r(d.corr('r', 'b'), 5)} AS corr_, {d.r(f'(avg(r) * 252 - {rf}) / nullif(stddev_samp(r) * sqrt(252e0), 0)', 5)} AS sharpe, {d.r('avg(r - b) / nullif(stddev_samp(r - b), 0) * sqrt(252e0)', 5)} AS info_ratio, {d.r(f'(avg(r) * 252 - {rf}) / nullif({beta}, 0)', 1)} AS treynor
FROM paired GROUP BY symbol"""


@relation("returns", covers="AGG-25")
def monthly_table(d):
    """Compounded returns by year, a column a month, and of the year."""
    months = ", ".join(f"{d.r(f'exp(sum(CASE WHEN m = {k} THEN ln(1 + r) END)) - 1')} AS m{k:02d}" for k in range(1, 13))
    return f"SELECT symbol, y AS year, {months}, {d.r('exp(sum(ln(1 + r))) - 1')} AS ytd FROM (SELECT symbol, r, {d.part('year', 'day')} AS y, {d.part('month', 'day')} AS m FROM returns) x GROUP BY symbol, y"


@relation("returns", covers="AGG-30, AGG-39")
def value_at_risk(d, c=0.95):
    """Historical value at risk (the quantile itself), mean at or below it, and the normal one."""
    p = d.pct("r", round(1 - c, 4))
    return f"""SELECT r.symbol, {d.r('max(v)')} AS var_hist, {d.r('avg(CASE WHEN r.r <= v THEN r.r END)')} AS cvar, {d.r(f'avg(r.r) - {Z95} * stddev_samp(r.r)')} AS var_normal
FROM returns r JOIN (SELECT symbol, {p} AS v FROM returns GROUP BY symbol) q ON q.symbol = r.symbol GROUP BY r.symbol"""


@relation("returns")
def pairs(d):
    """Both returns of each day for each two symbols."""
    return "SELECT a.symbol AS s1, b.symbol AS s2, a.day, a.r AS r1, b.r AS r2 FROM returns a JOIN returns b ON b.day = a.day"


@relation("pairs", covers="AGG-31, AGG-33")
def covariance(d):
    return f"SELECT s1, s2, CAST(count(*) AS BIGINT) AS n, {d.r('covar_samp(r1, r2)', 9)} AS cov, {d.r(d.corr('r1', 'r2'))} AS corr_ FROM pairs WHERE s1 <= s2 GROUP BY s1, s2"


@relation("returns", "pairs", covers="AGG-31 (EWMA)")
def ewma_covariance(d, lam=0.94):
    """Covariance of demeaned returns with weight (1 - lam) * lam ** age."""
    return f"""SELECT s1, s2, {d.r(f'sum((1 - {lam}) * power({lam}e0, n - 1 - i) * (r1 - m1) * (r2 - m2))', 9)} AS cov FROM (
  SELECT s1, s2, r1, r2, avg(r1) OVER (PARTITION BY s1, s2) AS m1, avg(r2) OVER (PARTITION BY s1, s2) AS m2, row_number() OVER (PARTITION BY s1, s2 ORDER BY day) - 1 AS i, count(*) OVER (PARTITION BY s1, s2) AS n FROM pairs WHERE s1 <= s2) x GROUP BY s1, s2"""


@relation("returns")
def portfolio(d):
    """day, r: the equally weighted mean of the symbols that have one that day."""
    return "SELECT day, avg(r) AS r FROM returns GROUP BY day"


@relation("portfolio", covers="AGG-32, WIN-23, JOI-15 (portfolio)")
def portfolio_var(d, hold=10, value=1000000):
    """Value at risk and shortfall of returns compounded over hold rows, in money."""
    h = f"CASE WHEN count(r) OVER w = {hold} THEN exp(sum(ln(1 + r)) OVER w) - 1 END"
    return f"""SELECT CAST(count(*) AS BIGINT) AS n, {d.r(f'-{value} * max(v)', 2)} AS var_, {d.r(f'-{value} * avg(CASE WHEN r <= v THEN r END)', 2)} AS cvar, {d.r(f'-{value} * (avg(r) - {Z95} * stddev_samp(r))', 2)} AS var_normal
FROM (SELECT r, v FROM (SELECT {h} AS r FROM portfolio WINDOW w AS (ORDER BY day ROWS BETWEEN {hold - 1} PRECEDING AND CURRENT ROW)) a CROSS JOIN (SELECT {d.pct('r', 0.05)} AS v FROM (SELECT {h} AS r FROM portfolio WINDOW w AS (ORDER BY day ROWS BETWEEN {hold - 1} PRECEDING AND CURRENT ROW)) b) q WHERE r IS NOT NULL) x"""


@relation("portfolio", covers="WIN-22")
def rolling_var(d, n=250):
    """The normal value at risk from the n rows before each day."""
    w = f"(ORDER BY day ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    return f"SELECT day, CASE WHEN count(r) OVER {w} = {n} THEN {d.r(f'avg(r) OVER {w} - {Z95} * stddev_samp(r) OVER {w}')} END AS var_ FROM portfolio"


@relation("rolling_var", "portfolio", covers="MOD-10")
def kupiec(d, p=0.05):
    """Days below the value at risk of the day, the likelihood ratio that their share is p, and its p-value (chi-square, one degree); null for none or all."""
    share = "(x / nullif(CAST(n AS DOUBLE), 0))"
    lr = f"-2 * ((n - x) * ln(1 - {p}e0) + x * ln({p}e0) - (n - x) * ln(1 - {share}) - x * ln({share}))"
    counts = "SELECT CAST(count(*) AS BIGINT) AS n, CASE WHEN sum(CASE WHEN p.r < v.var_ THEN 1 ELSE 0 END) BETWEEN 1 AND count(*) - 1 THEN CAST(sum(CASE WHEN p.r < v.var_ THEN 1 ELSE 0 END) AS BIGINT) END AS x FROM portfolio p JOIN rolling_var v ON v.day = p.day AND v.var_ IS NOT NULL"
    return f"SELECT n, x, {d.r(f'n * {p}e0', 4)} AS expected, {d.r('lr', 4)} AS lr, {d.r(d.erfc('sqrt(greatest(lr, 0e0) / 2)'), 5)} AS p_value FROM (SELECT n, x, {lr} AS lr FROM ({counts}) q) y"


@relation("paired", covers="AGG-34, PRJ-02")
def tracking(d, last=252):
    """Tracking error, alpha and beta over all days and the last ones, capture of up and down days (30 of each at least)."""
    beta = lambda w: f"covar_samp(CASE WHEN {w} THEN r END, CASE WHEN {w} THEN b END) / nullif(var_samp(CASE WHEN {w} THEN b END), 0)"
    return f"""SELECT symbol, {d.r('stddev_samp(r - b) * sqrt(252e0)')} AS tracking_error, {d.r(beta('k > 0'), 5)} AS beta, {d.r(beta(f'k <= {last}'), 5)} AS beta_last,
  CASE WHEN count(CASE WHEN b > 0 THEN 1 END) >= 30 THEN {d.r('avg(CASE WHEN b > 0 THEN r END) / nullif(avg(CASE WHEN b > 0 THEN b END), 0)', 5)} END AS up_capture, CASE WHEN count(CASE WHEN b < 0 THEN 1 END) >= 30 THEN {d.r('avg(CASE WHEN b < 0 THEN r END) / nullif(avg(CASE WHEN b < 0 THEN b END), 0)', 5)} END AS down_capture
FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k FROM paired) x GROUP BY symbol"""


@relation("averages", "rsi_parts", "returns", "drawdown")
def metrics(d):
    """Price metrics of symbols of 20 rows or more."""
    v = "CASE WHEN r.loss = 0 OR r.loss IS NULL THEN 100 ELSE 100 - 100 / (1 + r.gain / r.loss) END"
    return f"""SELECT a.symbol, a.close AS price, a.close / a.back21 - 1 AS return_1m, a.close / a.back62 - 1 AS return_3m, s.vol AS ann_vol, s.sharpe, m.max_dd, {v} AS rsi
FROM averages a LEFT JOIN rsi_parts r ON r.symbol = a.symbol AND r.day = a.day JOIN (SELECT symbol, stddev_samp(r) * sqrt(252e0) AS vol, avg(r) / nullif(stddev_samp(r), 0) * sqrt(252e0) AS sharpe FROM returns GROUP BY symbol) s ON s.symbol = a.symbol
JOIN (SELECT symbol, min(dd) AS max_dd FROM drawdown GROUP BY symbol) m ON m.symbol = a.symbol WHERE a.i = a.n - 1 AND a.n >= 20"""


@relation("metrics", covers="AGG-36, SRC-01")
def price_metrics(d):
    return f"SELECT symbol, round(price, 2) AS price, {d.r('return_1m')} AS return_1m, {d.r('return_3m')} AS return_3m, {d.r('ann_vol')} AS ann_vol, {d.r('sharpe', 5)} AS sharpe, {d.r('max_dd')} AS max_dd, {d.r('rsi', 1)} AS rsi FROM metrics"


@relation("metrics", "universe", covers="AGG-04, JOI-09")
def by_industry(d):
    return f"SELECT industry, CAST(count(*) AS BIGINT) AS n, {d.r('avg(return_1m)')} AS return_1m, {d.r('avg(return_3m)')} AS return_3m, {d.r('avg(ann_vol)')} AS ann_vol, {d.r('avg(sharpe)', 5)} AS sharpe, CAST(row_number() OVER (ORDER BY round(coalesce(avg(return_3m), -9), 9) DESC, industry) AS BIGINT) AS place FROM metrics m JOIN universe u ON u.symbol = m.symbol GROUP BY industry"


@relation("metrics", "universe", covers="WIN-35")
def peer_rank(d):
    return f"SELECT m.symbol, industry, CAST(row_number() OVER (PARTITION BY industry ORDER BY round(return_3m, 9) DESC, m.symbol) AS BIGINT) AS place, CAST(count(*) OVER (PARTITION BY industry) AS BIGINT) AS peers FROM metrics m JOIN universe u ON u.symbol = m.symbol"


@relation("metrics", "universe", covers="FIL-01, JOI-18")
def screener(d):
    """Symbols by return, volatility and RSI limits with defaults for what is missing, best first."""
    return f"SELECT m.symbol, industry, {d.r('return_3m')} AS return_3m, {d.r('rsi', 1)} AS rsi FROM metrics m LEFT JOIN universe u ON u.symbol = m.symbol WHERE coalesce(return_3m, -999) >= -0.5 AND coalesce(ann_vol, 999) <= 1 AND coalesce(rsi, 50) BETWEEN 20 AND 80"


@relation("pairs", covers="JOI-15")
def correlation_guard(d, limit=0.05):
    """Candidates too close to one of the first five symbols, which are held: 30 days in common at least."""
    return f"""SELECT s1 AS candidate, CAST(max(n) AS BIGINT) AS n, {d.r('max(c)')} AS highest FROM (
  SELECT s1, s2, count(*) AS n, {d.corr('r1', 'r2')} AS c FROM pairs WHERE s1 <> s2 AND s2 IN (SELECT s FROM (SELECT s1 AS s, row_number() OVER (ORDER BY s1) AS k FROM (SELECT DISTINCT s1 FROM pairs) a) b WHERE k <= 5) GROUP BY s1, s2 HAVING count(*) >= 30) x
GROUP BY s1 HAVING max(c) >= {limit}"""


@relation("returns", covers="MOD-02, MOD-03, MOD-04")
def sizing(d, target=0.15):
    """Leverage to a volatility (2 at most), Kelly fraction (a quarter of it, 0.25 at most), inverse-volatility weights."""
    kelly = "(p - (1 - p) / nullif(w / nullif(l, 0), 0))"
    return f"""SELECT symbol, round(least(2e0, {target} / vol), 3) AS leverage, {d.r(f'greatest(0e0, {kelly})', 5)} AS kelly, {d.r(f'least(0.25e0, greatest(0e0, {kelly}) / 4)', 5)} AS kelly_used, {d.r('1 / vol / sum(1 / vol) OVER ()')} AS inverse_vol_weight
FROM (SELECT symbol, stddev_samp(r) * sqrt(252e0) AS vol, avg(CASE WHEN r > 0 THEN 1e0 ELSE 0e0 END) AS p, avg(CASE WHEN r > 0 THEN r END) AS w, -avg(CASE WHEN r < 0 THEN r END) AS l FROM returns GROUP BY symbol) x"""


@relation("pairs", covers="MOD-04 (contributions)")
def risk_contributions(d):
    """Share of each symbol in the variance of the equally weighted portfolio."""
    return f"SELECT s1 AS symbol, {d.r('sum(c) / sum(sum(c)) OVER ()')} AS share FROM (SELECT s1, s2, covar_samp(r1, r2) AS c FROM pairs GROUP BY s1, s2) x GROUP BY s1"


@relation("universe", "metrics", covers="MOD-11")
def scenario_pnl(d, value=100000):
    """The loss of an equally weighted portfolio under shocks by industry."""
    return f"""SELECT scenario, {d.r(f'sum({value} * shock / n)', 2)} AS pnl FROM (SELECT scenario, CASE WHEN industry = hit THEN deep ELSE mild END AS shock, count(*) OVER (PARTITION BY scenario) AS n
  FROM metrics m JOIN universe u ON u.symbol = m.symbol CROSS JOIN (SELECT industry AS hit, concat('crash_', industry) AS scenario, -0.3e0 AS deep, -0.05e0 AS mild FROM (SELECT DISTINCT industry FROM universe) i) s) x GROUP BY scenario"""


@relation("portfolio", covers="MOD-11 (replay), PRJ-11")
def historical_replay(d):
    """The return from the first to the last value of each year; the first day's own return isn't part of it."""
    return f"SELECT year, {d.r('exp(sum(CASE WHEN k > 1 THEN ln(1 + r) END)) - 1')} AS ret, {d.r('min(nav)')} AS lowest FROM (SELECT {d.part('year', 'day')} AS year, r, row_number() OVER (PARTITION BY {d.part('year', 'day')} ORDER BY day) AS k, exp(sum(ln(1 + r)) OVER (PARTITION BY {d.part('year', 'day')} ORDER BY day)) AS nav FROM portfolio) x GROUP BY year"


@relation("documents", "labels", covers="AGG-27")
def woe_iv(d, bins=10):
    """Weight of evidence of text length for toxicity over bins by exact quantiles, and the information value."""
    cut_ = " + ".join(f"CASE WHEN x > (SELECT {d.pct('x', round(k / bins, 2))} FROM s) THEN 1 ELSE 0 END" for k in range(1, bins))
    return f"""SELECT bin, good, bad, {d.r('ln(pg / pb)')} AS woe, {d.r('sum((pg - pb) * ln(pg / pb)) OVER ()')} AS iv FROM (
  SELECT CAST(bin AS BIGINT) AS bin, CAST(sum(1 - y) AS BIGINT) AS good, CAST(sum(y) AS BIGINT) AS bad, greatest(sum(1 - y) / CAST(sum(sum(1 - y)) OVER () AS DOUBLE), 1e-9) AS pg, greatest(sum(y) / CAST(sum(sum(y)) OVER () AS DOUBLE), 1e-9) AS pb
  FROM (WITH s AS (SELECT CAST(length(text) AS DOUBLE) AS x, toxic AS y FROM documents JOIN labels ON labels.doc_id = documents.doc_id) SELECT {cut_} AS bin, y FROM s) q GROUP BY bin) z"""
