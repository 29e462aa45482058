"""Whether a drift is more than luck: resampling of blocks, and Sharpe ratios held against the luckiest of many trials."""

from __future__ import annotations

import math

from tidewell.plans.compose import relation, source

# Fixed values of the rules.
DRAWS, BLOCK, SEED, CAP, EULER = 1000, 21, 7, 50, 0.5772156649015329


def _bootstrap_by_hand() -> str:
    """Every resampled row by itself, where the operator takes two sums a block."""
    return f"""{source("relative_rows")}, d AS (SELECT unnest(range(1, {DRAWS} + 1)) AS b),
p AS (SELECT b, x.i AS at, n, ('0x' || substr(md5('{SEED} ' || b || ' ' || (x.i // {BLOCK})), 1, 12))::BIGINT % n AS start FROM d, relative_rows x),
m AS (SELECT b, avg(v - m) AS mean, any_value(m) AS obs, any_value(p.n) AS n FROM p JOIN relative_rows r ON r.i = (p.start + p.at % {BLOCK}) % p.n GROUP BY b)
SELECT n, count(*) AS draws, round(any_value(obs), 9) AS observed, round(greatest(avg(CASE WHEN mean >= obs THEN 1.0 ELSE 0.0 END), 1.0 / {DRAWS}), 4) AS p FROM m GROUP BY n"""


@relation("relative_rows")
def block_means(d, draws=DRAWS, block=BLOCK, seed=SEED):
    """b, n, obs, mean of each circular block resample of the demeaned relative returns: n rows each, in blocks whose last is cut short.

    A block is the difference of two running sums, one more where it goes round the end: so a draw costs
    n / block rows, whatever the block. A block starts where a digest of seed, draw and block says.
    """
    sums = "SELECT i, n, m, sum(v - m) OVER (ORDER BY i) AS upto FROM relative_rows"
    blocks = f"SELECT {d.whole('i', str(block))} AS k, n, m, least(CAST({block} AS BIGINT), n - i) AS size FROM relative_rows WHERE i % {block} = 0"
    name = f"concat('{seed} ', CAST(b AS STRING), ' ', CAST(k AS STRING))" if d.name == "spark" else f"concat('{seed} ', b, ' ', k)"
    starts = f"SELECT b, n, m, size, {d.digest(name)} % n AS s FROM ({blocks}) q CROSS JOIN {d.series(1, draws, 'b')} r"
    # the sum up to and without a row is the one up to the row before; all of them add up to nothing
    ends = f"SELECT b, n, m, s - 1 AS before, (s + size - 1) % n AS last_ FROM ({starts}) w"
    return f"""SELECT e.b, e.n, e.m AS obs, sum(z.upto - coalesce(a.upto, 0e0)) / e.n AS mean
FROM ({ends}) e JOIN ({sums}) z ON z.i = e.last_ LEFT JOIN ({sums}) a ON a.i = e.before GROUP BY e.b, e.n, e.m"""


@relation("block_means", covers="MOD-12", oracle=_bootstrap_by_hand)
def block_bootstrap(d, direction="outperform"):
    """The share of resamples whose mean is at least the observed one (at most, for a thesis of underperformance), and one draw's share at least."""
    past = "mean >= obs" if direction == "outperform" else "mean <= obs"
    share = f"greatest(avg(CASE WHEN {past} THEN 1e0 ELSE 0e0 END), 1e0 / count(*))"
    return f"SELECT n, CAST(count(*) AS BIGINT) AS draws, {d.r('obs', 9)} AS observed, {d.r(share, 4)} AS p FROM block_means GROUP BY n, obs"


@relation("bars", "bench_close")
def trial_rows(d):
    """owner, seq, statement, t, sr, skew, kurt, extra: a ledger of trials, here each symbol against the market by daily relative log returns, for two owners.

    Below 60 days, or where nothing varies, the ratio is 0, the skewness 0 and the kurtosis 3. extra: trials
    that the owner tells of outside of the ledger.
    """
    w = "PARTITION BY b.symbol ORDER BY b.day"
    logs = f"SELECT b.symbol, ln(b.close / lag(b.close) OVER ({w})) - ln(m.close / lag(m.close) OVER ({w})) AS v FROM bars b JOIN bench_close m ON m.day = b.day"
    sums = f"SELECT symbol, count(v) AS t, avg(v) AS mean, stddev_samp(v) AS sd, {d.g1('v')} AS skew, {d.g2('v')} + 3 AS kurt FROM ({logs}) x WHERE v IS NOT NULL GROUP BY symbol"
    known = "t >= 60 AND sd > 0"
    return f"""SELECT owner, CAST(row_number() OVER (PARTITION BY owner ORDER BY symbol) AS BIGINT) AS seq, symbol AS statement, CAST(t AS BIGINT) AS t, CASE WHEN {known} THEN mean / sd ELSE 0e0 END AS sr,
  CASE WHEN {known} THEN skew ELSE 0e0 END AS skew, CASE WHEN {known} THEN kurt ELSE 3e0 END AS kurt, CAST(CASE owner WHEN 0 THEN 0 ELSE 3 END AS BIGINT) AS extra
FROM (SELECT *, CAST(length(symbol) % 2 AS BIGINT) AS owner FROM ({sums}) s) y"""


def _deflated_by_hand() -> str:
    """Each trial joined to those before it, the normal by its density summed in small steps."""
    return f"""{source("trial_rows")}, grid AS (SELECT x + 5e-5 AS x, exp(-(x + 5e-5) * (x + 5e-5) / 2) / sqrt(2 * pi()) AS f, sum(exp(-x * x / 2) / sqrt(2 * pi()) * 1e-4) OVER (ORDER BY x) AS p FROM (SELECT (k - 80000) * 1e-4 + 5e-5 AS x FROM range(0, 160000) q(k))),
e AS (SELECT a.owner, a.seq, a.statement, a.t, a.sr, a.skew, a.kurt, count(*) + a.extra AS n, CASE WHEN count(*) >= 2 THEN var_samp(round(b.sr, 4)) ELSE (1 + a.sr * a.sr / 2) / greatest(a.t, 2) END AS v
  FROM trial_rows a JOIN trial_rows b ON b.owner = a.owner AND b.seq BETWEEN a.seq - {CAP - 1} AND a.seq GROUP BY a.owner, a.seq, a.statement, a.t, a.sr, a.skew, a.kurt, a.extra),
z AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE sqrt(greatest(v, 1e-12)) * ((1 - {EULER}) * (SELECT arg_min(x - (p - (1 - 1.0 / n)) / f, x) FROM grid WHERE p >= 1 - 1.0 / n) + {EULER} * (SELECT arg_min(x - (p - (1 - 1 / (n * {math.e}))) / f, x) FROM grid WHERE p >= 1 - 1 / (n * {math.e}))) END AS star FROM e)
SELECT owner, seq, statement, t, n AS trials, round(sr, 4) AS sharpe, round(CASE WHEN t >= 30 THEN star END, 3) AS luckiest,
  CASE WHEN t >= 30 AND 1 - skew * sr + (kurt - 1) / 4 * sr * sr > 0 THEN round((SELECT arg_max(p + (y.v - x) * f, x) FROM grid, (SELECT (sr - star) * sqrt(t - 1) / sqrt(1 - skew * sr + (kurt - 1) / 4 * sr * sr) AS v) y WHERE x <= y.v), 3) END AS probability FROM z"""


@relation("trial_rows", covers="MOD-15, STR-17", oracle=_deflated_by_hand)
def deflated_sharpe(d, cap=CAP):
    """For each trial of an owner's ledger the best Sharpe ratio that luck alone would give as many trials, and the probability that its own is more.

    The trials are those of the ledger up to it, the last cap of them, and the owner's extra ones. Their
    ratios' variance, or that of an estimate where there is only one, sets how far luck goes. Null below 30
    days or where the higher moments leave no variance; a row a trial, none for an empty ledger.
    """
    w = f"PARTITION BY owner ORDER BY seq ROWS BETWEEN {cap - 1} PRECEDING AND CURRENT ROW"
    spread = f"CASE WHEN count(*) OVER ({w}) >= 2 THEN var_samp({d.r('sr', 4)}) OVER ({w}) ELSE (1 + sr * sr / 2) / greatest(t, 2) END"
    counted = f"SELECT *, CAST(count(*) OVER ({w}) AS BIGINT) + extra AS trials, sqrt(greatest({spread}, 1e-12)) AS far FROM trial_rows"
    luck = f"CASE WHEN trials <= 1 THEN 0e0 ELSE far * ({1 - EULER!r} * {d.normal_inv('(1 - 1e0 / trials)')} + {EULER!r} * {d.normal_inv(f'(1 - 1 / (trials * {math.e!r}))')}) END"
    left = "1 - skew * sr + (kurt - 1) / 4 * sr * sr"
    z = f"(sr - star) * sqrt(CAST(t - 1 AS DOUBLE)) / sqrt(nullif(greatest({left}, 0e0), 0e0))"
    parts = f"SELECT *, {z} AS z FROM (SELECT *, {luck} AS star FROM ({counted}) c WHERE t IS NOT NULL) e"
    return f"""SELECT owner, seq, statement, t, trials, {d.r('sr', 4)} AS sharpe, {d.r('CASE WHEN t >= 30 THEN star END', 3)} AS luckiest,
  {d.r(f"CASE WHEN t >= 30 AND z IS NOT NULL THEN {d.normal_cdf('z')} END", 3)} AS probability FROM ({parts}) f"""
