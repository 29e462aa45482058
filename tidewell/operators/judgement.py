"""Scores, regimes, valuations and rules that judge companies, markets and positions."""

from __future__ import annotations

from tidewell.operators.indicators import W
from tidewell.plans.compose import relation

# Fixed values of the rules: bands are (limit, points); of what is better the smaller, limits from above.
HEALTH = {
    "profit": [("roe", ((0.20, 12), (0.15, 9.6), (0.10, 7.2), (0.05, 4.8), (0.0001, 2.4)), False), ("net_margin", ((0.20, 8), (0.10, 6), (0.05, 4), (0.0001, 2)), False)],
    "growth": [("revenue_growth", ((0.20, 10), (0.10, 7.5), (0.05, 5), (0.0001, 2.5)), False), ("earnings_growth", ((0.20, 10), (0.10, 7.5), (0.05, 5), (0.0001, 2.5)), False)],
    "safety": [("debt_to_equity", ((0.5, 10), (1.0, 7.5), (1.5, 5), (2.5, 2.5)), True), ("current_ratio", ((2.0, 10), (1.5, 8), (1.0, 5), (0.5, 2)), False)],
    "cash": [("fcf", (), False), ("fcf_margin", ((0.15, 8), (0.08, 6), (0.03, 4), (0.0001, 2)), False)],
    "value": [("pe", ((10, 10), (15, 8), (25, 6), (40, 3)), True), ("peg", ((1.0, 10), (1.5, 7), (2.0, 4), (3.0, 2)), True)],
}
FLAGS = {"pe": (15, 30), "pb": (1.5, 4), "peg": (1.0, 2.0), "ev_ebitda": (10, 18)}
WEATHER = {"breadth": 0.30, "credit": 0.25, "vix_ts": 0.20, "yield_curve": 0.15, "copper_gold": 0.10}
OVERLAY = {"veto_days": 3, "insider": 0.15, "cluster": 0.05, "options": 0.10, "short_from": 0.15, "short": -0.10, "most": 0.15, "greed_size": 0.5}


def bands(x: str, limits, reverse: bool) -> str:
    """Points of x by its bands, null where x is."""
    sign = "<=" if reverse else ">="
    return f"CASE WHEN {x} IS NULL THEN NULL " + " ".join(f"WHEN {x} {sign} {t} THEN {p}e0" for t, p in limits) + " ELSE 0e0 END"


@relation("fundamentals", covers="MOD-19, PRJ-09")
def health_score(d):
    """Five parts by bands of two items each, 0 to 100 over the items there are; what is missing counts for nothing. Rating, and how many parts there are."""
    parts, got, full = {}, [], []
    for part, items in HEALTH.items():
        points = [bands(x, limits, reverse) if limits else f"CASE WHEN {x} > 0 THEN 12e0 WHEN {x} IS NOT NULL THEN 0e0 END" for x, limits, reverse in items]
        most = [limits[0][1] if limits else 12 for _, limits, _ in items]
        got.append(" + ".join(f"coalesce({p}, 0e0)" for p in points))
        full.append(" + ".join(f"CASE WHEN {x} IS NULL THEN 0e0 ELSE {m}e0 END" for (x, _, _), m in zip(items, most)))
        parts[part] = f"100 * ({got[-1]}) / nullif({full[-1]}, 0)"
    score = d.r(f"100 * ({' + '.join(got)}) / nullif({' + '.join(full)}, 0)", 1)
    covered = " + ".join(f"CASE WHEN {f} > 0 THEN 1 ELSE 0 END" for f in full)
    columns = ", ".join(f"{d.r(x, 1)} AS {part}" for part, x in parts.items())
    return f"SELECT *, CASE WHEN score IS NULL THEN 'none' WHEN score >= 75 THEN 'excellent' WHEN score >= 55 THEN 'good' WHEN score >= 40 THEN 'fair' ELSE 'weak' END AS rating FROM (SELECT symbol, {score} AS score, {columns}, CAST({covered} AS BIGINT) AS covered FROM fundamentals) x"


@relation("fundamentals", covers="MOD-19 (flags)")
def valuation_flags(d):
    """Each multiple as cheap, fair or dear; 'na' where it is missing or not positive."""
    return "SELECT symbol, " + ", ".join(f"CASE WHEN coalesce({x}, 0) <= 0 THEN 'na' WHEN {x} < {low} THEN 'cheap' WHEN {x} > {high} THEN 'dear' ELSE 'fair' END AS {x}" for x, (low, high) in FLAGS.items()) + " FROM fundamentals"


@relation("bars")
def cross_assets(d):
    """day and the levels of eight assets: credit, treasuries, two volatilities, two yields, two metals; null on days without a price. From eight of the symbols here."""
    names = ["hyg", "lqd", "vix", "vix3m", "tnx", "irx", "copper", "gold"]
    scale = {"tnx": " / 25", "irx": " / 30"}
    columns = ", ".join(f"max(CASE WHEN k = {n} THEN close{scale.get(x, '')} END) AS {x}" for n, x in enumerate(names, 1))
    return f"SELECT day, {columns} FROM (SELECT symbol, day, close, dense_rank() OVER (ORDER BY symbol) AS k FROM bars) x WHERE k <= 8 GROUP BY day"


def ratio(d, a: str, b: str, more: str) -> str:
    """SELECT of day, v (a / b on the days of both) and more over those days in order."""
    return f"SELECT day, v, {more} FROM (SELECT day, {a} / nullif({b}, 0) AS v, row_number() OVER (ORDER BY day) AS k FROM cross_assets WHERE {a} IS NOT NULL AND {b} IS NOT NULL) q"


@relation("cross_assets", "breadth")
def weather_parts(d):
    """By day the five components, 0 to 100, of the last values known by then."""
    linear = lambda x, low, high: f"CASE WHEN {x} IS NOT NULL THEN " + d.r(f"greatest(0e0, least(100e0, ({x} - ({low}e0)) / ({high}e0 - ({low}e0)) * 100))", 1) + " END"
    last = lambda x: d.last(x, "ORDER BY c.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")
    credit = ratio(d, "hyg", "lqd", "CASE WHEN k >= 50 THEN avg(v) OVER (ORDER BY day ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) END AS ma")
    metals = ratio(d, "copper", "gold", "lag(v, 20) OVER (ORDER BY day) AS back")
    known = f"""SELECT c.day, {last('b.share')} AS share, {last('r.v / r.ma - 1')} AS credit, {last('c.vix')} AS vix, {last('c.vix3m')} AS vix3m, {last('c.tnx')} AS tnx, {last('c.irx')} AS irx, {last('m.v / m.back - 1')} AS metals
  FROM cross_assets c LEFT JOIN breadth b ON b.day = c.day LEFT JOIN ({credit}) r ON r.day = c.day LEFT JOIN ({metals}) m ON m.day = c.day"""
    return f"""SELECT day, {d.r('share * 100', 1)} AS breadth, {linear('credit', -0.02, 0.02)} AS credit, CASE WHEN vix > 0 THEN {linear('(vix3m / vix)', 0.95, 1.15)} END AS vix_ts, {linear('(tnx - irx)', -0.5, 1.5)} AS yield_curve, {linear('metals', -0.08, 0.08)} AS copper_gold FROM ({known}) x"""


@relation("weather_parts", covers="MOD-20, PRJ-08, WIN-34, SRC-10")
def weather(d):
    """The weighted components of each day; a missing one counts 50, and with fewer than three there is no score."""
    have = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in WEATHER)
    thousandths = " + ".join(f"{round(w * 100)} * CAST(round(coalesce({c}, 50e0) * 10) AS BIGINT)" for c, w in WEATHER.items())  # whole: parts have one decimal
    parts = ", ".join(WEATHER)
    return f"SELECT day, {parts}, CASE WHEN {have} >= 3 THEN {d.whole(f'{thousandths} + 50', '100')} / 10e0 END AS score FROM weather_parts"


@relation("chain", "bars")
def option_totals(d):
    """Volume and open interest by right over all expiries; at the money (within a tenth) implied volatility of the nearest one by right, weighted by open interest."""
    near = "expiry = first_ AND abs(strike / spot - 1) <= 0.1 AND iv > 0 AND iv < 3"
    iv = lambda cp: f"coalesce(sum(CASE WHEN {near} AND cp = '{cp}' THEN iv * oi END) / nullif(sum(CASE WHEN {near} AND cp = '{cp}' THEN oi END), 0), avg(CASE WHEN {near} AND cp = '{cp}' THEN iv END))"
    both = lambda x: f"sum(CASE WHEN cp = 'P' THEN {x} END) / nullif(sum(CASE WHEN cp = 'C' THEN {x} END), 0)"
    return f"""SELECT symbol, {both('volume')} AS pcr_volume, {both('oi')} AS pcr_oi, {iv('C')} AS call_iv, {iv('P')} AS put_iv
FROM (SELECT c.*, b.close AS spot, min(expiry) OVER (PARTITION BY c.symbol) AS first_ FROM chain c JOIN (SELECT symbol, max_by(close, day) AS close FROM bars GROUP BY symbol) b ON b.symbol = c.symbol) x GROUP BY symbol"""


@relation("option_totals", covers="AGG-14, MOD-21")
def options_summary(d):
    """Put/call ratios, implied volatility at the money, its skew, and a sentiment of -1 to 1 from open interest (0.6) and skew (0.4), over those there are."""
    clip = lambda x: f"CASE WHEN {x} IS NOT NULL THEN greatest(-1e0, least(1e0, {x})) END"  # noqa: E731  both skip nulls
    skew, pcr = "(put_iv - call_iv)", "pcr_oi"
    score = d.r(f"(coalesce(0.6 * {clip(f'(1 - {pcr}) / 0.5')}, 0) + coalesce(0.4 * {clip(f'-{skew} / 0.05')}, 0)) / nullif(CASE WHEN {pcr} IS NULL THEN 0e0 ELSE 0.6e0 END + CASE WHEN {skew} IS NULL THEN 0e0 ELSE 0.4e0 END, 0)", 2)
    iv = "CASE WHEN put_iv IS NULL THEN call_iv WHEN call_iv IS NULL THEN put_iv ELSE (put_iv + call_iv) / 2 END"
    return f"SELECT *, CASE WHEN sentiment IS NULL THEN 'none' WHEN sentiment >= 0.3 THEN 'bullish' WHEN sentiment <= -0.3 THEN 'bearish' ELSE 'neutral' END AS label FROM (SELECT symbol, {d.r('pcr_volume')} AS pcr_volume, {d.r('pcr_oi')} AS pcr_oi, {d.r(iv)} AS atm_iv, {d.r(skew)} AS skew, {score} AS sentiment FROM option_totals) x"


def insiders(d, rows: str) -> str:
    """SELECT by symbol of open-market buys (P, A) and sells (S, D), the score and the label of both."""
    buy, sell = "code = 'P' AND ad = 'A'", "code = 'S' AND ad = 'D'"
    total = lambda c, x: f"sum(CASE WHEN {c} THEN {x} ELSE 0 END)"
    owners = lambda c: f"CAST(count(DISTINCT CASE WHEN {c} THEN owner END) AS BIGINT)"
    value = "coalesce(shares * price, 0)"
    sums = f"SELECT symbol, CAST({total(buy, 1)} AS BIGINT) AS buys, CAST({total(sell, 1)} AS BIGINT) AS sells, {total(buy, value)} AS buy_value, {total(sell, value)} AS sell_value, {owners(buy)} AS buyers, {owners(sell)} AS sellers FROM ({rows}) i GROUP BY symbol"
    score = f"CASE WHEN buys > 0 AND sells > 0 THEN coalesce({d.r('(buy_value - sell_value) / nullif(buy_value + sell_value, 0)', 2)}, 0e0) WHEN buys > 0 THEN 1e0 WHEN sells > 0 THEN -0.3e0 END"
    bought = "CASE WHEN buyers >= 2 THEN 'cluster_buy' ELSE 'buy' END"
    label = f"CASE WHEN buys = 0 AND sells = 0 THEN 'none' WHEN sells = 0 THEN {bought} WHEN buys = 0 THEN 'weak_sell' WHEN buy_value > sell_value THEN {bought} WHEN buy_value < sell_value THEN 'sell' ELSE 'mixed' END"
    return f"SELECT symbol, buys, sells, {d.r('buy_value', 2)} AS buy_value, {d.r('sell_value', 2)} AS sell_value, buyers, sellers, buyers >= 2 AS cluster, {score} AS score, {label} AS label FROM ({sums}) x"


@relation("insider", covers="AGG-15")
def insider_summary(d):
    """Counts, values, owners of all open-market transactions: score by net value where both sides traded, 1 for buys alone, -0.3 for sells alone."""
    return insiders(d, "SELECT * FROM insider")


@relation("insider", covers="FIL-04")
def insider_window(d, days=365):
    """The same of the transactions within so many days of the newest; those without a day are left out."""
    return insiders(d, f"SELECT i.* FROM insider i CROSS JOIN (SELECT max(day) AS newest FROM insider) n WHERE i.day >= {d.plus('n.newest', -days)}")


@relation("composite_score", "insider_summary", "options_summary")
def overlay_inputs(d):
    """symbol, score and what may change it: insiders, options, share sold short, days to earnings; the last two are made up from the symbol's number."""
    k = "row_number() OVER (ORDER BY symbol) - 1"
    return f"""SELECT c.symbol, c.score, i.score AS insider_score, i.cluster, o.sentiment AS opt_score, c.k % 10 / 40e0 AS short_pct, CASE WHEN c.k % 5 <> 4 THEN c.k % 15 - 2 END AS to_earnings
FROM (SELECT symbol, score, {k} AS k FROM composite_score) c LEFT JOIN insider_summary i ON i.symbol = c.k LEFT JOIN options_summary o ON o.symbol = c.symbol"""


@relation("overlay_inputs", covers="MOD-22, JOI-14")
def overlays(d):
    """What insiders, options and short interest add to a score, within 0.15, and whether earnings within three days veto an entry; nothing where nothing is known."""
    o = OVERLAY
    delta = f"coalesce(insider_score * {o['insider']} + CASE WHEN cluster AND insider_score > 0 THEN {o['cluster']} ELSE 0 END, 0) + coalesce(opt_score * {o['options']}, 0) + CASE WHEN short_pct >= {o['short_from']} THEN {o['short']} ELSE 0 END"
    return f"SELECT symbol, score, delta, no_entry, {d.r('score + delta', 3)} AS adjusted FROM (SELECT symbol, score, {d.r(f'''greatest(-{o['most']}e0, least({o['most']}e0, {delta}))''', 3)} AS delta, coalesce(to_earnings BETWEEN 0 AND {o['veto_days']}, false) AS no_entry FROM overlay_inputs) x"


@relation("events")
def fear_greed(d):
    """day and two indices of fear and greed, 0 to 100; here from two types of event."""
    v = lambda t: f"avg(CASE WHEN event_type = '{t}' THEN greatest(0e0, least(100e0, 50 + (value - 50) * 1.5)) END)"
    return f"SELECT day, 50 + (stocks - 50) * 6 AS stocks, 50 + (crypto - 50) * 6 AS crypto FROM (SELECT CAST(ts AS DATE) AS day, {v('click')} AS stocks, {v('view')} AS crypto FROM events GROUP BY CAST(ts AS DATE)) x"


@relation("fear_greed", covers="MOD-22 (account), 2.8 dual signal")
def account_overlay(d):
    """Both indices under 25 or over 75 at once, and the size of new positions that follows: half in greed."""
    return f"SELECT day, coalesce(stocks < 25 AND crypto < 25, false) AS both_fear, coalesce(stocks > 75 AND crypto > 75, false) AS both_greed, CASE WHEN stocks > 75 AND crypto > 75 THEN {OVERLAY['greed_size']}e0 ELSE 1e0 END AS size FROM fear_greed"


@relation("metrics", "composite_score", "atr_rows", "scoreboard", "market_regime")
def risk_facts(d):
    """symbol, regime (of the market), ann_vol, score, hit_rate, decisions, position (by true range, as a share): what hard rules look at."""
    hits = "SELECT sum(hits) / CAST(nullif(sum(n), 0) AS DOUBLE) AS hit_rate, sum(n) AS decisions FROM scoreboard"
    return f"SELECT m.symbol, r.regime, m.ann_vol, c.score, h.hit_rate, h.decisions, 0.01e0 * t.close / nullif(1.5 * t.atr, 0) AS position FROM metrics m JOIN composite_score c ON c.symbol = m.symbol JOIN atr_rows t ON t.symbol = m.symbol AND t.i = t.n - 1 CROSS JOIN ({hits}) h CROSS JOIN market_regime r"


@relation("risk_facts", covers="FIL-08")
def hard_rules(d):
    """The limits that hold whatever anyone says, by name in order; empty where none does."""
    rules = [("regime", "regime = 'risk_off'"), ("volatility", "ann_vol > 0.8"), ("hit_rate", "decisions >= 5 AND hit_rate < 0.4"), ("neutral_score", "abs(score) < 0.15"), ("position", "position > 0.25")]
    return "SELECT symbol, concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in rules) + ") AS rules FROM risk_facts"


@relation("fundamentals")
def dcf_inputs(d):
    """symbol, revenue, growth (within 0 and 25 %), margin (within 2 and 60 %), net_debt, shares, wacc of a company."""
    return "SELECT symbol, 1e6 * (1 + net_margin) AS revenue, greatest(0e0, least(0.25e0, coalesce(revenue_growth, earnings_growth, 0.05e0))) AS growth, greatest(0.02e0, least(0.6e0, coalesce(net_margin / 0.79, fcf_margin, 0.1e0))) AS margin, debt_to_equity * 2e5 - coalesce(fcf, 0) / 20 AS net_debt, 1e3 AS shares, 0.06e0 + 0.02 * least(2e0, debt_to_equity) AS wacc FROM fundamentals"


def projected(d, years: int, tax: float, da=0.04, capex=0.05, nwc=0.01) -> str:
    """SELECT of symbol, t, revenue, ebit, nopat, fcf: what is left of each year's revenue after taxes, investment and working capital for the growth."""
    now, before = "revenue * power(1 + growth, t)", "revenue * power(1 + growth, t - 1)"
    return f"SELECT symbol, t, {now} AS revenue, {now} * margin AS ebit, {now} * margin * (1 - {tax}) AS nopat, {now} * margin * (1 - {tax}) + {now} * {da} - {now} * {capex} - ({now} - {before}) * {nwc} AS fcf FROM dcf_inputs CROSS JOIN {d.series(1, years, 't')} y"


def bridge(years: int) -> dict[str, str]:
    """Present values at mid-year of the cash flows (t, fcf; dr, tg) and of what comes after, as aggregates."""
    pv = "sum(fcf / power(1 + dr, t - 0.5e0))"
    after = f"max(CASE WHEN t = {years} THEN fcf END) * (1 + tg) / (dr - tg) / power(1 + dr, {years} - 0.5e0)"
    return {"pv": pv, "after": after}


@relation("dcf_inputs", covers="MOD-17 (projection), SRC-40")
def fcf_projection(d, years=5, tax=0.21):
    return "SELECT symbol, t, " + ", ".join(f"{d.r(c, 2)} AS {c}" for c in ("revenue", "ebit", "nopat", "fcf")) + f" FROM ({projected(d, years, tax)}) x"


@relation("dcf_inputs", covers="MOD-17")
def dcf_value(d, years=5, tax=0.21, growth=0.025):
    """Enterprise and equity value, value a share, share of what comes after the years; warnings where that is over 75 % or under 40 % or equity is gone. None where growth isn't below the cost of capital."""
    b = bridge(years)
    sums = f"SELECT p.symbol, i.net_debt, i.shares, {b['pv']} AS pv, {b['after']} AS after_ FROM (SELECT symbol, t, fcf FROM ({projected(d, years, tax)}) q) p JOIN (SELECT symbol, net_debt, shares, wacc AS dr, {growth}e0 AS tg FROM dcf_inputs) i ON i.symbol = p.symbol WHERE tg < dr GROUP BY p.symbol, i.net_debt, i.shares, dr, tg"
    share = "CASE WHEN pv + after_ > 0 THEN after_ / (pv + after_) END"
    warn = f"concat_ws(',', CASE WHEN {share} > 0.75 THEN 'late' WHEN {share} < 0.4 THEN 'early' END, CASE WHEN pv + after_ - net_debt <= 0 THEN 'debt' END)"
    return f"SELECT symbol, {d.r('pv + after_', 2)} AS ev, {d.r('pv + after_ - net_debt', 2)} AS equity, CASE WHEN shares > 0 THEN {d.r('(pv + after_ - net_debt) / shares', 4)} END AS per_share, {d.r(share, 4)} AS tv_share, {warn} AS warnings FROM ({sums}) x"


@relation("dcf_inputs", covers="MOD-17 (grid), SRC-34")
def dcf_grid(d, years=5, tax=0.21, rates=(0.02, 0.08, 0.1), growths=(0.01, 0.02, 0.03)):
    """Value a share over a grid of costs of capital and growth; null where growth isn't below the cost."""
    b = bridge(years)
    grid = f"(VALUES {', '.join(f'({r}e0)' for r in rates)}) AS a(dr) CROSS JOIN (VALUES {', '.join(f'({g}e0)' for g in growths)}) AS b(tg)"
    return f"SELECT p.symbol, dr, tg, CASE WHEN tg < dr AND max(shares) > 0 THEN {d.r(f'''({b['pv']} + {b['after'].replace('(dr - tg)', 'nullif(dr - tg, 0)')} - max(net_debt)) / max(shares)''', 4)} END AS value FROM ({projected(d, years, tax)}) p JOIN (SELECT symbol, net_debt, shares FROM dcf_inputs) i ON i.symbol = p.symbol CROSS JOIN {grid} GROUP BY p.symbol, dr, tg"


@relation("bars")
def momentum_close(d):
    """day, close of the momentum factor: here the mean of the later half of the symbols."""
    return "SELECT day, avg(close) AS close FROM (SELECT day, close, percent_rank() OVER (PARTITION BY day ORDER BY symbol) AS k FROM bars) x WHERE k >= 0.5 GROUP BY day"


@relation("aligned", "momentum_close")
def confound(d):
    """One row of regressions of the basket's log returns on the benchmark's, alone and with the momentum factor's: alphas with t, and the moments of the relative returns."""
    rows = "SELECT ln(b / lag(b) OVER (ORDER BY day)) AS y, ln(m / lag(m) OVER (ORDER BY day)) AS x, ln(f / lag(f) OVER (ORDER BY day)) AS z FROM (SELECT a.day, a.b, a.m, f.close AS f FROM aligned a JOIN momentum_close f ON f.day = a.day) q"
    cov = {p: f"covar_samp({p[0]}, {p[1]})" for p in ("xx", "xz", "zz", "xy", "zy", "yy")}
    sums = f"SELECT nullif(CAST(count(*) AS DOUBLE), 0) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, {', '.join(f'{e} AS {p}' for p, e in cov.items())}, avg(y - x) / nullif(stddev_samp(y - x), 0) AS sharpe, {d.g1('(y - x)')} AS skew, {d.g2('(y - x)')} + 3 AS kurt FROM ({rows}) r WHERE y IS NOT NULL AND z IS NOT NULL"
    det = "nullif(xx * zz - xz * xz, 0)"
    betas = f"SELECT *, xy / nullif(xx, 0) AS b1, (zz * xy - xz * zy) / {det} AS c1, (xx * zy - xz * xy) / {det} AS c2 FROM ({sums}) s"
    one = "(yy - b1 * xy) * (n - 1) / greatest(n - 2, 1) * (1 / n + mx * mx / nullif(xx * (n - 1), 0))"
    two = f"(yy - c1 * xy - c2 * zy) * (n - 1) / greatest(n - 3, 1) * (1 / n + (zz * mx * mx - 2 * xz * mx * mz + xx * mz * mz) / nullif({det} * (n - 1), 0))"
    return f"SELECT n, sharpe, skew, kurt, b1, c1, c2, my - b1 * mx AS a1, (my - b1 * mx) / sqrt(greatest({one}, 1e-18)) AS t1, my - c1 * mx - c2 * mz AS a2, (my - c1 * mx - c2 * mz) / sqrt(greatest({two}, 1e-18)) AS t2 FROM ({betas}) t"


@relation("confound", covers="MOD-14, AGG-38")
def momentum_confound(d, least=252):
    """Whether an alpha outlives the momentum factor: both regressions' alphas a year with t, how much of the first the factor takes; null with too few days."""
    shrink = "CASE WHEN a1 > 0 THEN 1 - a2 / a1 END"
    return f"SELECT CAST(coalesce(n, 0) AS BIGINT) AS n, {d.r('b1')} AS beta, {d.r('c2')} AS momentum_beta, {d.r('a1 * 252')} AS alpha_one, {d.r('t1', 4)} AS t_one, {d.r('a2 * 252')} AS alpha, {d.r('t2', 4)} AS t, {d.r(shrink, 4)} AS shrink, CASE WHEN n >= {least} THEN a2 > 0 AND t2 > 1 END AS survived, {d.r('sharpe')} AS sharpe, {d.r('skew', 4)} AS skew, {d.r('kurt', 4)} AS kurt FROM confound"


@relation("customer", covers="2.8 credit score")
def scorecard(d, base=600, odds=20, pdo=50):
    """Points of a default probability by the logarithm of its odds, the probability held between 1e-6 and 1 - 1e-6."""
    p = "greatest(1e-6, least(1 - 1e-6, (c_acctbal + 1000) / 11000))"
    return f"SELECT c_custkey AS id, {d.r(f'{base} + {pdo} / ln(2e0) * (ln({odds}e0) - ln((1 - {p}) / {p}))', 4)} AS points FROM customer"


@relation("journal", "bars")
def theses(d):
    """symbol, direction, status, updated, stop, target: one thesis a symbol, from its first trade and its last."""
    return f"""SELECT j.symbol, CASE WHEN j.n % 3 = 0 THEN 'short' ELSE 'long' END AS direction, CASE WHEN j.n % 7 = 0 THEN 'closed' ELSE 'active' END AS status, j.updated, b.close * CASE WHEN j.n % 3 = 0 THEN 1.1e0 ELSE 0.9e0 END AS stop, b.close * CASE WHEN j.n % 3 = 0 THEN 0.8e0 ELSE 1.2e0 END AS target, j.first_ AS set_on
FROM (SELECT symbol, count(*) AS n, min(day) AS first_, max(day) AS updated FROM journal GROUP BY symbol) j JOIN (SELECT symbol, min_by(close, day) AS close FROM bars GROUP BY symbol) b ON b.symbol = j.symbol"""


@relation("theses", "bench_close", covers="FIL-05")
def stale_theses(d, days=90):
    """Active theses that have not been touched for so many days before the newest day."""
    age = d.days("newest", "updated")
    return f"SELECT symbol, updated, {age} AS age FROM theses CROSS JOIN (SELECT max(day) AS newest FROM bench_close) n WHERE status = 'active' AND {age} >= {days}"


@relation("theses", "bars", covers="STR-03")
def thesis_triggers(d):
    """The first day from its set-up on at which a thesis that isn't closed meets its stop and its target, each once, by direction."""
    hit = lambda long_, short: f"CASE direction WHEN 'long' THEN {long_} ELSE {short} END"
    return f"SELECT t.symbol, direction, min(CASE WHEN {hit('b.close <= t.stop', 'b.close >= t.stop')} THEN b.day END) AS stopped, min(CASE WHEN {hit('b.close >= t.target', 'b.close <= t.target')} THEN b.day END) AS reached FROM theses t JOIN bars b ON b.symbol = t.symbol AND b.day >= t.set_on AND b.close > 0 WHERE t.status <> 'closed' GROUP BY t.symbol, direction"


@relation("events", covers="STR-10")
def stale_caches(d):
    """Kinds of cached values, hours since each was last fetched, and whether it is due: weather after 1 hour, overlay after 12 (2 when empty), fear and greed after 2, earnings daily, calibration weekly."""
    kinds = "(VALUES ('click', 'weather', 1e0, 1e0), ('view', 'overlay', 12e0, 2e0), ('purchase', 'fear_greed', 2e0, 2e0), ('signup', 'earnings', 24e0, 24e0), ('logout', 'calibration', 168e0, 168e0)) AS k(event_type, kind, ttl, ttl_empty)"
    hours = f"{d.seconds('newest', 'fetched')} / 3600e0"
    return f"SELECT kind, {d.r(hours, 4)} AS hours, coalesce({hours} >= CASE WHEN empty THEN ttl_empty ELSE ttl END, true) AS due FROM (SELECT kind, ttl, ttl_empty, max(ts) AS fetched, max_by(value, ts) IS NULL AS empty FROM {kinds} LEFT JOIN events e ON e.event_type = k.event_type GROUP BY kind, ttl, ttl_empty) x CROSS JOIN (SELECT max(ts) AS newest FROM events) n"


@relation("option_totals", "upcoming", covers="MOD-26")
def earnings_scenarios(d):
    """The move that options imply up to an event, and the reactions of three cases; 5 % where nothing is implied."""
    ahead = "greatest(1, 1 + row_number() OVER (ORDER BY symbol) % 21)"
    move = d.r(f"coalesce(put_iv, call_iv) * sqrt({ahead} / 365e0) * 100", 1)
    return f"SELECT symbol, case_, CASE case_ WHEN 'up' THEN coalesce(move, 5e0) WHEN 'base' THEN greatest(coalesce(move, 5e0) * 0.4, 1e0) ELSE -coalesce(move, 5e0) END AS reaction FROM (SELECT symbol, CASE WHEN coalesce(put_iv, call_iv) > 0 THEN {move} END AS move FROM option_totals) x CROSS JOIN (VALUES ('up'), ('base'), ('down')) AS c(case_)"


@relation("journal", covers="MOD-27")
def manual_plan(d, account=100_000, risk=0.01):
    """For each buy with a price: shares by the risk of its stop 4 % below, reward to risk of a target 9 % above, and the share of wins that breaks even."""
    rr = "(target - price) / nullif(price - stop, 0)"
    return f"SELECT event, symbol, CAST(floor({account * risk}e0 / nullif(price - stop, 0)) AS BIGINT) AS shares, {d.r(rr, 4)} AS reward_to_risk, {d.r(f'1 / (1 + {rr})', 4)} AS break_even FROM (SELECT event, symbol, price, price * 0.96e0 AS stop, price * 1.09e0 AS target FROM journal WHERE side = 'buy' AND price > 0) x"


@relation("bars", covers="STR-07 (rule)")
def legacy_orders(d, enter=0.5, leave=0.0, slots=8):
    """Orders of the plain rule by day: what is held and scores below the limit goes; the best that score enough come in, up to so many a day. The score is the month's return times ten."""
    scored = f"SELECT symbol, day, close, 10 * (close / lag(close, 21) OVER ({W}) - 1) AS score FROM bars"
    ranked = f"SELECT symbol, day, close, score, lag(score) OVER ({W}) AS before, row_number() OVER (PARTITION BY day ORDER BY score DESC, symbol) AS place FROM ({scored}) x WHERE score IS NOT NULL"
    return f"SELECT symbol, day, CASE WHEN score >= {enter} THEN 'buy' ELSE 'sell' END AS side, {d.r('score', 4)} AS score FROM ({ranked}) y WHERE score >= {enter} AND place <= {slots} AND coalesce(before < {enter}, true) OR score < {leave} AND before >= {leave}"
