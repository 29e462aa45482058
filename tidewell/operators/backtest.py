"""Triple-barrier backtests of entry rules: all symbols, rules and parameters in one plan."""

from __future__ import annotations

from tidewell.operators.indicators import RULES, W, crosses, ewm
from tidewell.plans.compose import relation

TP, SL, HORIZON, COST = 0.05, 0.03, 10, 0.001


def barrier(d, entries: str, closes: str, keys: str, tp="5e-2", sl="3e-2", h="10", most: int = HORIZON) -> str:
    """Trades of entries (keys, symbol, i, n, short) on closes (symbol, i, close).

    Entry at the close after the signal; from the next row on, up to h rows, the first close at or past
    the target (tested first) or the stop ends the trade there, else the last close of the span does.
    One equi-join by row number looks ahead: no window over a symbol's whole history for each entry.
    """
    on = f"j.symbol = e.symbol AND j.i = e.i + 1 + k.k{' AND j.fold = e.fold' if 'fold' in keys else ''}"
    at = f"p.symbol = e.symbol AND p.i = e.i + 1{' AND p.fold = e.fold' if 'fold' in keys else ''}"
    win = f"CASE WHEN short THEN j.close <= p.close * (1 - {tp}) ELSE j.close >= p.close * (1 + {tp}) END"
    loss = f"CASE WHEN short THEN j.close >= p.close * (1 + {sl}) ELSE j.close <= p.close * (1 - {sl}) END"
    cols = ", ".join(f"e.{c.strip()}" for c in keys.split(","))
    return f"""SELECT {keys}, i, day, outcome, held, (CASE outcome WHEN 'win' THEN {tp} WHEN 'loss' THEN -{sl} ELSE (last_px / entry_px - 1) * CASE WHEN short THEN -1 ELSE 1 END END) - {COST}e0 AS ret FROM (
  SELECT {keys}, i, day, short, entry_px, last_px, CASE WHEN hit IS NULL THEN 'time' WHEN hit % 2 = 0 THEN 'win' ELSE 'loss' END AS outcome, CASE WHEN hit IS NULL THEN last_k ELSE {d.whole('hit', '2')} END AS held FROM (
    SELECT {cols}, e.i, e.day, e.short, p.close AS entry_px, max_by(j.close, k.k) AS last_px, max(k.k) AS last_k, min(CASE WHEN {win} THEN 2 * k.k WHEN {loss} THEN 2 * k.k + 1 END) AS hit
    FROM {entries} e JOIN {closes} p ON {at} CROSS JOIN {d.series(1, most, 'k')} k JOIN {closes} j ON {on} WHERE k.k <= {h} AND p.close > 0
    GROUP BY {cols}, e.i, e.day, e.short, p.close) x) y"""


def evaluated(d, keys: str, trades: str) -> str:
    """Statistics of trades by keys; the profit factor is null where there is no loss."""
    win, loss = "CASE WHEN ret > 0 THEN ret END", "CASE WHEN ret < 0 THEN ret END"
    return f"""SELECT {keys}, CAST(count(*) AS BIGINT) AS trades, avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) AS win_rate, coalesce(sum({win}), 0) / nullif(-coalesce(sum({loss}), 0), 0) AS profit_factor,
  avg(ret) AS expectancy, coalesce(avg({win}), 0) AS avg_win, coalesce(avg({loss}), 0) AS avg_loss, avg(CAST(held AS DOUBLE)) AS avg_held, sum(ret) AS total_ret FROM {trades} GROUP BY {keys}"""


STATS = "trades win_rate profit_factor expectancy avg_win avg_loss avg_held total_ret".split()


def rounded(d, columns=STATS) -> str:
    return ", ".join(c if c in ("trades", "n") else f"{d.r(c)} AS {c}" for c in columns)


@relation("entries", "numbered")
def trades(d):
    return barrier(d, "entries", "numbered", "symbol, rule")


@relation("trades", covers="WIN-11")
def triple_barrier(d):
    return f"SELECT symbol, rule, day, outcome, CAST(held AS BIGINT) AS held, {d.r('ret')} AS ret FROM trades"


@relation("trades")
def by_rule(d):
    return evaluated(d, "symbol, rule", "trades")


@relation("by_rule", covers="AGG-01, WIN-12, SRT-01")
def backtest_all(d):
    """Statistics by symbol and rule, with the place by profit factor; fewer than five trades or no loss come last."""
    key = "CASE WHEN trades >= 5 AND profit_factor IS NOT NULL THEN profit_factor ELSE -1 END"
    return f"SELECT symbol, rule, {rounded(d)}, CAST(row_number() OVER (PARTITION BY symbol ORDER BY round({key}, 9) DESC, rule) AS BIGINT) AS place FROM by_rule"


@relation("trades", covers="WIN-10, AGG-01 (flagship)")
def flagship_golden_cross(d):
    """Backtest statistics of the moving-average golden cross by symbol."""
    return f"SELECT symbol, {rounded(d)} FROM ({evaluated(d, 'symbol', '(SELECT * FROM trades WHERE rule = ' + chr(39) + 'ma20_50_golden' + chr(39) + ') g')}) x"


@relation("entries", "weekly_bias_daily", "numbered", covers="WIN-12 (weekly filter)")
def backtest_weekly(d):
    """As backtest_all, with entries only where the weekly bias doesn't speak against their direction."""
    kept = "(SELECT e.* FROM entries e JOIN weekly_bias_daily w ON w.symbol = e.symbol AND w.day = e.day WHERE CASE WHEN short THEN bias <= 0 ELSE bias >= 0 END)"
    return f"SELECT symbol, rule, {rounded(d)} FROM ({evaluated(d, 'symbol, rule', '(' + barrier(d, kept, 'numbered', 'symbol, rule') + ') t')}) x"


@relation("numbered")
def folds(d, k=4):
    """numbered with its fold of k spans of rows, and i within the fold; symbols of fewer than 40 rows a fold are left out."""
    return f"""SELECT symbol, day, close, fold, CAST(row_number() OVER (PARTITION BY symbol, fold ORDER BY day) - 1 AS BIGINT) AS i, CAST(count(*) OVER (PARTITION BY symbol, fold) AS BIGINT) AS n
FROM (SELECT symbol, day, close, {d.whole(f'(i + 1) * {k} - 1', 'n')} AS fold FROM numbered WHERE n >= {40 * k}) x"""


@relation("folds")
def fold_entries(d):
    """The entries of each rule with all indicators restarted in each fold."""
    w = "PARTITION BY symbol, fold ORDER BY day"
    mean = lambda f, n: f"CASE WHEN i >= {n - 1} THEN {f} OVER ({w} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) END"
    a, b, c, e = (2 / 13, 2 / 27, 2 / 10, 1 / 14)
    cols = "close ma20 ma50 ma200 up down line sig rsi".split()
    lagged = ", ".join(f"lag({x}) OVER ({w}) AS {x}_0" for x in cols)
    case = " ".join(f"WHEN '{r}' THEN {x}" for r, x, _ in RULES)
    values = ", ".join(f"('{r}', {str(s).lower()})" for r, _, s in RULES)
    return f"""SELECT symbol, fold, rule, short, day, i, n FROM (SELECT symbol, fold, day, i, n, {', '.join(cols)}, {lagged} FROM (
    SELECT *, {ewm('line', 'i', c, w, False)} AS sig, CASE WHEN i >= 14 THEN coalesce(100 - 100 / (1 + {ewm('gain', 'greatest(i - 1, 0)', e, w, True)} / nullif({ewm('loss', 'greatest(i - 1, 0)', e, w, True)}, 0)), 50) ELSE 50 END AS rsi FROM (
      SELECT symbol, fold, day, i, n, close, {mean('avg(close)', 20)} AS ma20, {mean('avg(close)', 50)} AS ma50, {mean('avg(close)', 200)} AS ma200, {mean('avg(close)', 20)} + 2 * {mean('stddev_samp(close)', 20)} AS up, {mean('avg(close)', 20)} - 2 * {mean('stddev_samp(close)', 20)} AS down,
        {ewm('close', 'i', a, w, False)} - {ewm('close', 'i', b, w, False)} AS line, coalesce(greatest(close - lag(close) OVER ({w}), 0), 0) AS gain, coalesce(greatest(lag(close) OVER ({w}) - close, 0), 0) AS loss FROM folds) x) y) z
CROSS JOIN (VALUES {values}) AS rules(rule, short) WHERE CASE rule {case} END"""


@relation("fold_entries", "folds")
def fold_stats(d):
    return evaluated(d, "symbol, rule, fold", "(" + barrier(d, "fold_entries", "folds", "symbol, rule, fold") + ") t")


@relation("fold_stats", covers="WIN-13 (details)")
def walk_forward_details(d):
    return f"SELECT symbol, rule, fold, {rounded(d)} FROM fold_stats"


@relation("fold_stats", "numbered")
def consistency(d):
    """The share of folds of three trades or more that earn something; a half where there are fewer than two."""
    values = ", ".join(f"('{r}')" for r, _, _ in RULES)
    return f"""SELECT s.symbol, r.rule, CASE WHEN coalesce(v.valid, 0) >= 2 THEN v.good / CAST(v.valid AS DOUBLE) ELSE 0.5e0 END AS consistency
FROM (SELECT symbol FROM numbered GROUP BY symbol HAVING count(*) >= 160) s CROSS JOIN (VALUES {values}) AS r(rule)
LEFT JOIN (SELECT symbol, rule, count(*) AS valid, sum(CASE WHEN expectancy > 0 THEN 1 ELSE 0 END) AS good FROM fold_stats WHERE trades >= 3 GROUP BY symbol, rule) v ON v.symbol = s.symbol AND v.rule = r.rule"""


@relation("consistency", covers="WIN-13")
def walk_forward(d):
    return f"SELECT symbol, rule, {d.r('consistency')} AS consistency FROM consistency"


@relation("by_rule", "consistency")
def edges(d):
    return """SELECT b.symbol, b.rule, CASE WHEN trades < 5 OR profit_factor IS NULL THEN 0e0 ELSE greatest(-1e0, least(1e0, (win_rate - 0.5) * 2 * least(profit_factor, 3) / 3)) END * coalesce(c.consistency, 0.5e0) AS edge
FROM by_rule b LEFT JOIN consistency c ON c.symbol = b.symbol AND c.rule = b.rule"""


@relation("edges", covers="WIN-14, JOI-20")
def rule_edge(d):
    return f"SELECT symbol, rule, {d.r('edge')} AS edge FROM edges"


#: Which part of the composite score each rule calibrates.
PARTS = {"rsi_below_30": "rsi", "rsi_above_70_short": "rsi", "macd_golden": "macd", "macd_death_short": "macd", "ma20_50_golden": "trend", "golden_above_ma200": "trend", "lower_band": "bollinger", "upper_band": "bollinger", "triple_confirmation": "trend"}


@relation("edges", covers="WIN-16")
def calibration(d):
    """A multiplier of 1 plus the mean edge, within a half, for each part of the score."""
    values = ", ".join(f"('{r}', '{p}')" for r, p in PARTS.items())
    return f"SELECT symbol, part, {d.r('greatest(0.5e0, least(1.5e0, 1 + avg(edge)))')} AS multiplier FROM edges JOIN (VALUES {values}) AS parts(rule, part) USING (rule) GROUP BY symbol, part"


TARGETS, STOPS, HORIZONS = (0.03, 0.05, 0.08), (0.02, 0.03, 0.05), (5, 10, 20)


@relation("entries", "numbered")
def paths(d):
    """One row an entry: the first row that meets each target and each stop, and the last close of each horizon. All sets of parameters share one look ahead."""
    move = "(j.close / p.close - 1) * CASE WHEN short THEN -1 ELSE 1 END"
    win = lambda t: f"CASE WHEN short THEN j.close <= p.close * (1 - {t}e0) ELSE j.close >= p.close * (1 + {t}e0) END"
    loss = lambda t: f"CASE WHEN short THEN j.close >= p.close * (1 + {t}e0) ELSE j.close <= p.close * (1 - {t}e0) END"
    firsts = [f"min(CASE WHEN {win(t)} THEN k.k END) AS win_{n}" for n, t in enumerate(TARGETS)] + [f"min(CASE WHEN {loss(t)} THEN k.k END) AS loss_{n}" for n, t in enumerate(STOPS)]
    lasts = [f"max_by({move}, CASE WHEN k.k <= {h} THEN k.k END) AS move_{h}, max(CASE WHEN k.k <= {h} THEN k.k END) AS last_{h}" for h in HORIZONS]
    return f"""SELECT e.symbol, e.rule, e.i, {', '.join(firsts + lasts)} FROM entries e JOIN numbered p ON p.symbol = e.symbol AND p.i = e.i + 1 CROSS JOIN {d.series(1, max(HORIZONS), 'k')} k
JOIN numbered j ON j.symbol = e.symbol AND j.i = e.i + 1 + k.k WHERE p.close > 0 GROUP BY e.symbol, e.rule, e.i"""


@relation("paths")
def grid(d):
    """Statistics for 27 sets of target, stop and horizon, each from the paths of the entries."""
    sets = ", ".join(f"({a}, {b}, {h}, {t}e0, {s}e0)" for a, t in enumerate(TARGETS) for b, s in enumerate(STOPS) for h in HORIZONS)
    pick = lambda name, key, values: f"CASE {key} " + " ".join(f"WHEN {v} THEN {name}_{v}" for v in values) + " END"
    rows = f"SELECT symbol, rule, tp, sl, h, {pick('win', 'a', range(3))} AS w, {pick('loss', 'b', range(3))} AS l, {pick('move', 'h', HORIZONS)} AS move, {pick('last', 'h', HORIZONS)} AS last_k FROM paths CROSS JOIN (VALUES {sets}) AS g(a, b, h, tp, sl)"
    within = "SELECT symbol, rule, tp, sl, h, move, last_k, CASE WHEN w <= h THEN w END AS w, CASE WHEN l <= h THEN l END AS l FROM (" + rows + ") r"
    trades = f"SELECT symbol, rule, tp, sl, h, CASE WHEN w IS NOT NULL AND (l IS NULL OR w <= l) THEN tp WHEN l IS NOT NULL THEN -sl ELSE move END - {COST}e0 AS ret, coalesce(least(coalesce(w, l), coalesce(l, w)), last_k) AS held FROM ({within}) q"
    return evaluated(d, "symbol, rule, tp, sl, h", f"({trades}) t")


@relation("grid", "consistency", covers="WIN-15, SRT-02")
def optimize_params(d):
    """For each symbol and set the best rule of eight trades or more by expectancy, profit factor and consistency."""
    return f"""SELECT symbol, tp, sl, CAST(h AS BIGINT) AS h, rule, trades, {d.r('objective', 9)} AS objective FROM (
  SELECT g.symbol, tp, sl, h, g.rule, trades, expectancy * least(profit_factor, 3) * coalesce(consistency, 0.5e0) AS objective,
         row_number() OVER (PARTITION BY g.symbol, tp, sl, h ORDER BY round(expectancy * least(profit_factor, 3) * coalesce(consistency, 0.5e0), 12) DESC, g.rule) AS k
  FROM grid g LEFT JOIN consistency c ON c.symbol = g.symbol AND c.rule = g.rule WHERE trades >= 8 AND profit_factor IS NOT NULL) x WHERE k = 1"""


@relation("optimize_params", covers="AGG-26")
def param_heatmap(d):
    """The best objective by stop (rows) and target (columns)."""
    return f"SELECT symbol, sl, " + ", ".join(f"max(CASE WHEN tp = {v}e0 THEN objective END) AS tp_{n}" for n, v in (("3", 0.03), ("5", 0.05), ("8", 0.08))) + " FROM optimize_params GROUP BY symbol, sl"


@relation("by_rule", covers="AGG-40")
def rule_means(d):
    return f"SELECT rule, {d.r('avg(win_rate)')} AS win_rate, {d.r('avg(profit_factor)')} AS profit_factor, CAST(count(*) AS BIGINT) AS symbols FROM by_rule WHERE trades >= 5 GROUP BY rule"
