"""Relations that the operators work on, derived from the tables of the test data.

bars and the others have the columns that any source of daily bars, orders or chains would give; apply()
puts a caller's own in their place.
"""

from __future__ import annotations

from tidewell.plans.compose import relation


@relation("lineitem", "part")
def bars(d):
    """symbol, day, open, high, low, close, volume: a walk by the mean discount of each brand and day."""
    return """
SELECT symbol, day, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY day), close) AS open,
       close * (1 + tx / 8) AS high, close * (1 - tx / 8) AS low, close, volume
FROM (SELECT symbol, day, tx, volume, round(100 * exp(sum(0.4e0 * (disc - 0.05e0)) OVER (PARTITION BY symbol ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 4) AS close
      FROM (SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, avg(l_discount) AS disc, max(l_tax) AS tx, sum(l_quantity) AS volume
            FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, CAST(l_shipdate AS DATE)) a) b"""


@relation("bars")
def numbered(d):
    """bars with i, the number of the row in its symbol from 0, and n, the rows of the symbol."""
    return """SELECT *, CAST(row_number() OVER (PARTITION BY symbol ORDER BY day) - 1 AS BIGINT) AS i, CAST(count(*) OVER (PARTITION BY symbol) AS BIGINT) AS n FROM bars"""


@relation("bars")
def returns(d):
    """symbol, day, r: simple returns."""
    return """SELECT symbol, day, r FROM (SELECT symbol, day, close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY day), 0) - 1 AS r FROM bars) x WHERE r IS NOT NULL"""


@relation("bars")
def bench_close(d):
    """day, close: the mean close of all symbols."""
    return "SELECT day, round(avg(close), 6) AS close FROM bars GROUP BY day"


@relation("bench_close")
def bench_returns(d):
    return "SELECT day, r FROM (SELECT day, close / lag(close) OVER (ORDER BY day) - 1 AS r FROM bench_close) x WHERE r IS NOT NULL"


@relation("returns", "bench_returns")
def paired(d):
    """symbol, day, r, b: returns with the benchmark's of the same day."""
    return "SELECT a.symbol, a.day, a.r, b.r AS b FROM returns a JOIN bench_returns b ON b.day = a.day"


@relation("orders", "bars")
def journal(d):
    """event, symbol, day, side, qty, mechanism, price: orders as trades in one of the symbols, at about its level."""
    return f"""
SELECT o.o_orderkey AS event, s.symbol, CAST(o.o_orderdate AS DATE) AS day, CASE WHEN o.o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side,
       1 + o.o_orderkey % 20 AS qty, CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_orderpriority END AS mechanism,
       CASE WHEN o.o_orderkey % 13 = 0 THEN NULL ELSE {d.r('90 + o.o_orderkey % 37 + o.o_totalprice / 100000', 2)} END AS price
FROM orders o JOIN (SELECT symbol, CAST(row_number() OVER (ORDER BY symbol) - 1 AS BIGINT) AS k FROM (SELECT DISTINCT symbol FROM bars) q) s ON s.k = o.o_custkey % 25"""


@relation("events")
def bars_1h(d):
    """symbol, session, ts, open, high, low, close, volume: hourly bars by type of event."""
    return f"""SELECT event_type AS symbol, CAST({d.hour('ts')} AS DATE) AS session, {d.hour('ts')} AS ts, min_by(value, event_id) AS open, max(value) AS high, min(value) AS low, max_by(value, event_id) AS close, CAST(count(*) AS DOUBLE) AS volume
FROM events GROUP BY event_type, {d.hour('ts')}, CAST({d.hour('ts')} AS DATE)"""


@relation("part")
def universe(d):
    """symbol, industry, size, price: one row a brand; its industry is the most frequent type."""
    return """SELECT symbol, industry, size, price FROM (
  SELECT p_brand AS symbol, p_type AS industry, avg(p_size) AS size, avg(p_retailprice) AS price, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) AS k FROM part GROUP BY p_brand, p_type) x WHERE k = 1"""


@relation("lineitem", "part")
def chain(d):
    """symbol, expiry, cp, strike, volume, oi, iv: an option chain from line items."""
    return """SELECT p_brand AS symbol, l_linenumber AS expiry, CASE WHEN l_returnflag = 'R' THEN 'P' ELSE 'C' END AS cp, round(80 + l_orderkey % 41, 0) AS strike,
       sum(l_quantity) AS volume, sum(l_quantity * (1 + l_partkey % 3)) AS oi, avg(l_discount) * 4 + 0.05e0 AS iv
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'P' ELSE 'C' END, round(80 + l_orderkey % 41, 0)"""


@relation("lineitem", "part", "supplier")
def holdings(d):
    """quarter (0 is the latest), holder, issuer, value, shares, put_call: positions of suppliers from two spans of line items."""
    return """SELECT CAST(CASE WHEN l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' THEN 0 ELSE 1 END AS BIGINT) AS quarter, s_nationkey AS holder, p_brand AS issuer, CASE WHEN l_linenumber = 7 THEN 'Put' END AS put_call,
       sum(l_extendedprice) AS value, sum(l_quantity) AS shares
FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
GROUP BY CASE WHEN l_shipdate >= TIMESTAMP '1996-01-01 00:00:00' THEN 0 ELSE 1 END, s_nationkey, p_brand, CASE WHEN l_linenumber = 7 THEN 'Put' END"""


@relation("orders")
def insider(d):
    """symbol, day, owner, code, ad, shares, price: filings' transactions from orders."""
    return """SELECT o_custkey % 25 AS symbol, CAST(o_orderdate AS DATE) AS day, o_custkey AS owner, CASE o_orderpriority WHEN '1-URGENT' THEN 'P' WHEN '2-HIGH' THEN 'S' WHEN '3-MEDIUM' THEN 'A' ELSE 'M' END AS code,
       CASE WHEN o_orderstatus = 'F' THEN 'D' ELSE 'A' END AS ad, CAST(1 + o_orderkey % 500 AS DOUBLE) AS shares, o_totalprice / 1000 AS price FROM orders"""


@relation("lineitem", "part")
def flows(d):
    """symbol, day, foreign_, trust, dealer, total: net flows in shares by kind of investor."""
    return """SELECT symbol, day, f AS foreign_, t AS trust, x AS dealer, f + t + x AS total FROM (
  SELECT p_brand AS symbol, CAST(l_shipdate AS DATE) AS day, sum(CASE l_returnflag WHEN 'N' THEN l_quantity * (CASE WHEN l_orderkey % 2 = 0 THEN 100 ELSE -100 END) ELSE 0 END) AS f,
         sum(CASE l_returnflag WHEN 'R' THEN l_quantity * (CASE WHEN l_partkey % 3 = 0 THEN -100 ELSE 100 END) ELSE 0 END) AS t, sum(CASE l_returnflag WHEN 'A' THEN l_quantity * (CASE WHEN l_suppkey % 2 = 0 THEN 50 ELSE -50 END) ELSE 0 END) AS x
  FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY p_brand, CAST(l_shipdate AS DATE)) q"""


@relation("supplier", "customer", "orders")
def fundamentals(d):
    """symbol and the ratios of a company, from customers' figures by segment and nation."""
    return """SELECT CAST(c_custkey % 200 AS BIGINT) AS symbol, avg(c_acctbal) / 20000 AS roe, avg(c_acctbal) / 40000 - 0.02e0 AS net_margin, avg(o_totalprice) / 1000000 - 0.05e0 AS revenue_growth,
       CASE WHEN c_custkey % 200 % 17 = 0 THEN NULL ELSE max(c_acctbal) / 30000 - 0.1e0 END AS earnings_growth, avg(c_nationkey) / 8e0 AS debt_to_equity, 0.5e0 + avg(c_nationkey) / 9 AS current_ratio,
       CASE WHEN c_custkey % 200 % 13 = 0 THEN NULL ELSE sum(c_acctbal) END AS fcf, avg(c_acctbal) / 50000 AS fcf_margin, 5 + avg(o_totalprice) / 6000 AS pe, CASE WHEN c_custkey % 200 % 11 = 0 THEN NULL ELSE avg(o_totalprice) / 80000 END AS peg, avg(c_acctbal) / 1500 AS pb, CASE WHEN c_custkey % 200 % 7 = 0 THEN NULL ELSE avg(o_totalprice) / 10000 END AS ev_ebitda
FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey % 200"""
