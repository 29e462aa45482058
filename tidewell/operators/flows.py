"""Options, insiders, holdings, flows, futures, shorts, analysts: cross-sections of filings and chains."""

from __future__ import annotations

from tidewell.plans.compose import relation


@relation("chain", covers="SRC-11, SRC-12")
def option_symbols(d):
    """Contracts by name: root, expiry, right, strike in thousandths on eight digits; the first three expiries of each symbol."""
    return f"SELECT symbol, name, CAST(substr(name, 10, 8) AS BIGINT) / 1000e0 AS strike, substr(name, 9, 1) AS cp, CAST(place AS BIGINT) AS place FROM (SELECT symbol, concat('RT', lpad(CAST(260000 + expiry AS VARCHAR(10)), 6, '0'), cp, lpad(CAST(CAST(strike * 1000 AS BIGINT) AS VARCHAR(10)), 8, '0')) AS name, dense_rank() OVER (PARTITION BY symbol ORDER BY expiry) AS place FROM chain) x WHERE place <= 3"


@relation("insider", covers="AGG-15 (recent), SRC-15, SRT-05")
def insider_recent(d, k=5):
    return f"SELECT symbol, side, day, owner, CAST(place AS BIGINT) AS place FROM (SELECT symbol, CASE WHEN code = 'P' THEN 'buy' ELSE 'sell' END AS side, day, owner, row_number() OVER (PARTITION BY symbol, code ORDER BY day DESC, owner, shares, price) AS place FROM insider WHERE code = 'P' AND ad = 'A' OR code = 'S' AND ad = 'D') x WHERE place <= {k}"


@relation("holdings")
def issuers(d):
    """Holdings by holder, quarter and issuer without options."""
    return "SELECT holder, quarter, issuer, sum(value) AS value, sum(shares) AS shares FROM holdings WHERE put_call IS NULL GROUP BY holder, quarter, issuer"


@relation("issuers", covers="AGG-16")
def holdings_by_issuer(d):
    return f"SELECT holder, quarter, issuer, {d.r('value', 2)} AS value, {d.r('shares', 2)} AS shares FROM issuers"


@relation("issuers", covers="JOI-12, SRT-04, SET-04")
def holdings_changes(d, k=5):
    """New, added (over 2 %), reduced (over 2 %) and exited positions, the k largest of each; none are new without a quarter before."""
    return f"""SELECT holder, change, issuer, {d.r('value', 2)} AS value, CAST(place AS BIGINT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY holder, change ORDER BY value DESC, issuer) AS place FROM (
  SELECT coalesce(a.holder, b.holder) AS holder, coalesce(a.issuer, b.issuer) AS issuer, coalesce(a.value, b.value) AS value, CASE WHEN b.issuer IS NULL THEN CASE WHEN h.holder IS NOT NULL THEN 'new' END WHEN a.issuer IS NULL THEN 'exited' WHEN a.shares > b.shares * 1.02 THEN 'added' WHEN a.shares < b.shares * 0.98 THEN 'reduced' END AS change
  FROM (SELECT * FROM issuers WHERE quarter = 0) a FULL OUTER JOIN (SELECT * FROM issuers WHERE quarter = 1) b ON b.holder = a.holder AND b.issuer = a.issuer LEFT JOIN (SELECT DISTINCT holder FROM issuers WHERE quarter = 1) h ON h.holder = a.holder) x WHERE change IS NOT NULL) y WHERE place <= {k}"""


@relation("issuers", covers="JOI-11, SET-03")
def holdings_overlap(d):
    """The sum of the smaller weights of what two holders both have."""
    w = "(SELECT holder, issuer, value / sum(value) OVER (PARTITION BY holder) AS w FROM issuers WHERE quarter = 0)"
    return f"SELECT a.holder AS h1, b.holder AS h2, CAST(count(*) AS BIGINT) AS common, {d.r('sum(least(a.w, b.w))')} AS overlap FROM {w} a JOIN {w} b ON b.issuer = a.issuer AND a.holder < b.holder GROUP BY a.holder, b.holder"


@relation("flows", covers="AGG-17, SRC-25, SRC-26")
def flow_streaks(d):
    """Net flows in lots of a thousand, and the rows since the last day that wasn't positive."""
    streak = lambda c: f"CAST(sum(CASE WHEN day > coalesce(last_{c}, DATE '1900-01-01') THEN 1 ELSE 0 END) AS BIGINT) AS streak_{c}"
    return f"""SELECT symbol, CAST(count(*) AS BIGINT) AS days, {d.r('sum(foreign_) / 1000', 4)} AS foreign_lots, {d.r('sum(trust) / 1000', 4)} AS trust_lots, {d.r('sum(dealer) / 1000', 4)} AS dealer_lots, {d.r('sum(total) / 1000', 4)} AS total_lots, {streak('foreign')}, {streak('trust')}
FROM (SELECT *, max(CASE WHEN foreign_ <= 0 THEN day END) OVER (PARTITION BY symbol) AS last_foreign, max(CASE WHEN trust <= 0 THEN day END) OVER (PARTITION BY symbol) AS last_trust FROM flows) x GROUP BY symbol"""


@relation("flows", covers="AGG-18, SRC-29, D12")
def futures_summary(d):
    """The latest net position by symbol and its change against five rows before, or the oldest."""
    return f"SELECT symbol, max(CASE WHEN k = 1 THEN day END) AS day, {d.r('max(CASE WHEN k = 1 THEN total END)', 2)} AS net, {d.r('max(CASE WHEN k = 1 THEN total END) - max(CASE WHEN k = least(6, n) THEN total END)', 2)} AS change FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY day DESC) AS k, count(*) OVER (PARTITION BY symbol) AS n FROM flows) x GROUP BY symbol"


@relation("chain", covers="SRC-30")
def put_call_rows(d):
    """The ratio as given, or from the volumes times 100 at two places."""
    return f"SELECT symbol, expiry, {d.r('coalesce(CASE WHEN expiry % 2 = 0 THEN NULL ELSE put_ / nullif(call_, 0) * 100 END, round(put_ / nullif(call_, 0) * 100, 4))', 4)} AS ratio FROM (SELECT symbol, expiry, sum(CASE WHEN cp = 'P' THEN volume ELSE 0 END) AS put_, sum(CASE WHEN cp = 'C' THEN volume ELSE 0 END) AS call_ FROM chain GROUP BY symbol, expiry) x"


@relation("lineitem", "part", covers="SRC-18, AGG-19")
def short_volume(d):
    """Short volume over all markets by symbol and day, its share, and a note; shares over 1 are percent."""
    return f"SELECT symbol, day, {d.r('short_ / total')} AS share, CASE WHEN short_ / total >= 0.6 THEN 'high' WHEN short_ / total <= 0.4 THEN 'low' ELSE 'normal' END AS note FROM (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, sum(CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END) AS short_, sum(l_quantity) AS total FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, CAST(l_shipdate AS DATE)) x WHERE total > 0"


@relation("lineitem", "part", covers="SRC-19, SRT-05")
def fails_to_deliver(d, k=10):
    """The last k rows of each symbol; a price that is none is null."""
    return f"SELECT symbol, day, qty, {d.number('price')} AS price FROM (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, CAST(sum(l_quantity) AS BIGINT) AS qty, CASE WHEN sum(l_quantity) > 60 THEN '.' ELSE CAST(CAST(sum(l_quantity) AS BIGINT) AS VARCHAR(20)) END AS price, row_number() OVER (PARTITION BY p_brand ORDER BY CAST(l_shipdate AS DATE) DESC) AS place FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, CAST(l_shipdate AS DATE)) x WHERE place <= {k}"


@relation("supplier", "nation", covers="AGG-20")
def ratings(d):
    """Consensus of ratings by nation on -2 to 2, upside of the mean target, share of surprises that beat, at most 300 % and without zero estimates."""
    s = "CASE WHEN s_acctbal > 8000 THEN 2 WHEN s_acctbal > 5000 THEN 1 WHEN s_acctbal > 2000 THEN 0 WHEN s_acctbal > 0 THEN -1 ELSE -2 END"
    surprise = "greatest(-3e0, least(3e0, (s_acctbal - s_suppkey) / nullif(abs(CAST(s_suppkey AS DOUBLE)), 0)))"
    return f"SELECT n_name AS name, CAST(count(*) AS BIGINT) AS n, {d.r(f'avg(CAST({s} AS DOUBLE))', 4)} AS consensus, {d.r('avg(s_acctbal) / 4000 - 1')} AS upside, {d.r(f'avg(CASE WHEN {surprise} > 0 THEN 1e0 WHEN {surprise} IS NOT NULL THEN 0e0 END)')} AS beat_rate, {d.r(f'avg({surprise})', 5)} AS surprise FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY n_name"


@relation("events", covers="AGG-42")
def health(d):
    """Runs, longest duration and longest gap in seconds by day and source; a gap over the turn of the day counts for the later day."""
    gap = d.seconds("ts", "lag(ts) OVER (PARTITION BY event_type ORDER BY ts, event_id)")
    return f"SELECT symbol, day, CAST(count(*) AS BIGINT) AS runs, {d.r('max(value)', 4)} AS longest, max(gap) AS most_gap FROM (SELECT event_type AS symbol, CAST(ts AS DATE) AS day, value, {gap} AS gap FROM events) x GROUP BY symbol, day"


def _latest_by_hand() -> str:
    return """SELECT event_type AS symbol, max(ts) AS ts, arg_max(value, event_id) FILTER (ts = newest) AS price FROM (SELECT *, max(ts) OVER (PARTITION BY event_type) AS newest, max(ts) OVER () AS now_ FROM events) e
WHERE epoch_us(now_) - epoch_us(newest) <= 600000000 GROUP BY event_type"""


@relation("events", covers="SRC-08, STR-15", oracle=_latest_by_hand)
def latest_prices(d, minutes=10):
    """Each symbol's newest trade, if it isn't more than so many minutes older than the newest of all: a symbol whose last trade is stale has no price. Of trades at one moment the last counts."""
    last = "SELECT event_type AS symbol, ts, value AS price, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE value IS NOT NULL AND ts IS NOT NULL"
    return f"SELECT symbol, ts, price FROM ({last}) x CROSS JOIN (SELECT max(ts) AS now_ FROM events) m WHERE k = 1 AND ts >= now_ - INTERVAL '{minutes}' MINUTE"


@relation("events", covers="FIL-02, STR-02")
def price_alerts(d):
    """For each alert on a type of event the first event at or past its level, or none yet; an alert without level is dropped."""
    alerts = "(VALUES ('click', 'ge', 90e0), ('view', 'le', 5e0), ('purchase', 'ge', 1e9), ('signup', 'ge', CAST(NULL AS DOUBLE))) AS a(symbol, op, level)"
    return f"SELECT a.symbol, op, level, min(CASE WHEN op = 'ge' AND value >= level OR op = 'le' AND value <= level THEN event_id END) AS fired_at FROM {alerts} LEFT JOIN events e ON e.event_type = a.symbol WHERE level IS NOT NULL GROUP BY a.symbol, op, level"


@relation("pages", covers="SRC-43")
def page_summaries(d):
    """Pages without tags, at most 400 characters."""
    return f"SELECT page_id, substr({d.replaced('html', '<[^>]+>', '')}, 1, 400) AS summary FROM pages"


@relation("conversations", covers="2.8 keyword counts")
def intents(d):
    """Turns by role with some words, and their share."""
    any_ = "lower(text) LIKE '%the %' OR lower(text) LIKE '% der %'"
    return f"SELECT role, CAST(count(*) AS BIGINT) AS turns, CAST(sum(CASE WHEN {any_} THEN 1 ELSE 0 END) AS BIGINT) AS found, {d.r(f'avg(CASE WHEN {any_} THEN 1e0 ELSE 0e0 END)')} AS share FROM conversations GROUP BY role"


@relation("labels", "documents", covers="AGG-41")
def mean_sentiment(d):
    """The mean sentiment of each source's scored texts (here 1 for good, -1 for toxic ones) and its label, from 0.15 on either side."""
    return f"SELECT source, n, mean, CASE WHEN mean > 0.15 THEN 'positive' WHEN mean < -0.15 THEN 'negative' ELSE 'neutral' END AS label FROM (SELECT d.source, CAST(count(*) AS BIGINT) AS n, {d.r('avg(CAST(l.quality - 2 * l.toxic AS DOUBLE))')} AS mean FROM labels l JOIN documents d ON d.doc_id = l.doc_id GROUP BY d.source) x"


@relation("events", covers="STR-12, STR-13, D3")
def hourly_windows(d):
    """Tumbling windows of an hour by type of event."""
    return f"SELECT event_type AS symbol, {d.hour('ts')} AS ts, CAST(count(*) AS BIGINT) AS n, {d.r('sum(value)', 4)} AS total FROM events GROUP BY event_type, {d.hour('ts')}"


@relation("events", covers="SRC-23, SRC-32 (JSON)")
def event_props(d):
    k = d.json("props", "k")
    return f"SELECT event_type AS symbol, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST({k} AS BIGINT)) AS BIGINT) AS k FROM events GROUP BY event_type"


@relation("universe", "metrics", covers="JOI-13, D15, SRC-46, SET-06")
def relevance(d):
    """Points of an industry: 3 for each chosen factor in its own list, 2 for a boost, 1 for a tag."""
    return f"""SELECT industry, CAST(sum(CASE WHEN strat = factor THEN 3 ELSE 0 END + CASE WHEN boost = factor THEN 2 ELSE 0 END + CASE WHEN tag = factor THEN 1 ELSE 0 END) AS BIGINT) AS points, CAST(count(DISTINCT symbol) AS BIGINT) AS symbols
FROM (SELECT symbol, industry, CASE WHEN size > 25 THEN 'growth' ELSE 'value' END AS strat, CASE WHEN price > 1450 THEN 'rates' ELSE 'oil' END AS boost, CASE WHEN length(industry) % 2 = 0 THEN 'growth' ELSE 'rates' END AS tag FROM universe) u CROSS JOIN (VALUES ('growth'), ('rates')) AS f(factor) GROUP BY industry"""
