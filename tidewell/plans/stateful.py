"""Queries over the operators that are no SQL: folds, solvers, streams read to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell import registry
from tidewell.operators import budget, portfolio
from tidewell.plans import texts  # noqa: F401  its queries register themselves
from tidewell.plans.compose import DUCK, compose, run, source
from tidewell.streaming import alerts, books, engine, judgements, keyed, paper


@registry.query("trading_replay")
def trading_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-06, SRT-08: the engine's orders by account."""
    return engine.replay(engine.scored_rounds(run(spark, sf_dir, "bars")))


@registry.query(
    "signal_cooldown",
    lambda: """WITH RECURSIVE s AS (SELECT event_type AS symbol, CASE WHEN value >= 50 THEN 'high' ELSE 'low' END AS category, ts, row_number() OVER (PARTITION BY event_type, value >= 50 ORDER BY ts, event_id) AS k FROM events),
r AS (SELECT symbol, category, ts, k, ts AS last, true AS go FROM s WHERE k = 1 UNION ALL SELECT s.symbol, s.category, s.ts, s.k, CASE WHEN s.ts = r.last OR s.ts >= r.last + INTERVAL 24 HOUR THEN s.ts ELSE r.last END, s.ts = r.last OR s.ts >= r.last + INTERVAL 24 HOUR FROM r JOIN s ON s.symbol = r.symbol AND s.category = r.category AND s.k = r.k + 1)
SELECT symbol, category, ts FROM r WHERE go""",
)
def signal_cooldown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-01: signals by type and level, none within a day of the last one sent."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), F.when(F.col("value") >= 50, "high").otherwise("low").alias("category"), "ts")
    return alerts.cooldown(e).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@registry.query("portfolio_weights")
def portfolio_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-05, MOD-06, MOD-07: weights by method."""
    return portfolio.weights(run(spark, sf_dir, "returns"))


@registry.query("efficient_frontier")
def efficient_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-06: the long-only frontier."""
    return portfolio.efficient_frontier(run(spark, sf_dir, "returns"))


@registry.query("ledoit_wolf")
def ledoit_wolf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-31: covariance of monthly returns shrunk towards a multiple of the identity."""
    month = F.trunc("day", "MONTH").alias("day")
    last = run(spark, sf_dir, "bars").groupBy("symbol", month).agg(F.max_by("close", "day").alias("close"))
    returns = last.withColumn("r", F.col("close") / F.lag("close").over(W.partitionBy("symbol").orderBy("day")) - 1)
    return portfolio.shrinkage(returns.where("r is not null").select("symbol", "day", "r"))


@registry.query("monte_carlo")
def monte_carlo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-09."""
    return portfolio.monte_carlo(run(spark, sf_dir, "returns"))


@registry.query("money_weighted_return")
def money_weighted_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MOD-18: the rate of each symbol's flows and its value at the end."""
    days = run(spark, sf_dir, "equity_days")
    flows = days.select("symbol", "day", (-F.col("flow")).alias("amount")).where("amount <> 0")
    last = days.groupBy("symbol").agg(F.max("day").alias("day"), F.max_by(F.col("held") * F.col("close"), "day").alias("amount"))
    return portfolio.xirr_by_symbol(flows.unionByName(last))


@registry.query(
    "average_cost",
    lambda: """WITH RECURSIVE j AS (SELECT CAST(o_custkey % 25 AS BIGINT) AS symbol, o_orderkey AS event, CASE WHEN o_orderstatus = 'F' THEN 'sell' ELSE 'buy' END AS side, CAST(1 + o_orderkey % 20 AS DOUBLE) AS qty, o_totalprice / 100 AS price, row_number() OVER (PARTITION BY o_custkey % 25 ORDER BY o_orderkey) AS k FROM orders),
r AS (SELECT symbol, CAST(0 AS BIGINT) AS k, 0e0 AS held, 0e0 AS cost, 0e0 AS gain, CAST(0 AS BIGINT) AS rejected FROM (SELECT DISTINCT symbol FROM j)
UNION ALL SELECT j.symbol, j.k, CASE WHEN side = 'buy' THEN held + qty WHEN qty <= held THEN held - qty ELSE held END, CASE WHEN side = 'buy' THEN cost + qty * price WHEN qty < held THEN cost - qty * cost / held WHEN qty = held THEN 0e0 ELSE cost END,
  CASE WHEN side = 'sell' AND qty <= held THEN gain + qty * (price - cost / held) ELSE gain END, CASE WHEN side = 'sell' AND qty > held THEN rejected + 1 ELSE rejected END FROM r JOIN j ON j.symbol = r.symbol AND j.k = r.k + 1)
SELECT symbol, round(max_by(held, k), 4) AS held, round(max_by(cost, k) / nullif(max_by(held, k), 0), 2) AS avg_cost, round(max_by(gain, k), 1) AS realized, max(rejected) AS rejected FROM r GROUP BY symbol""",
)
def average_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN-39: positions at average cost by an ordered fold over each symbol's trades; a sell beyond what is held is rejected."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    side = F.when(F.col("o_orderstatus") == "F", "sell").otherwise("buy")
    rows = o.select((F.col("o_custkey") % 25).alias("symbol"), F.timestamp_micros("o_orderkey").alias("ts"), side.alias("side"), (1 + F.col("o_orderkey") % 20).cast("double").alias("qty"), (F.col("o_totalprice") / 100).alias("price"))
    folded = keyed.replay(rows, ["symbol"], books.AverageCost())  # an order's number is its moment
    return folded.select("symbol", F.round("held", 4).alias("held"), F.round(F.col("cost") / F.nullif(F.col("held"), F.lit(0.0)), 2).alias("avg_cost"), F.round("gain", 1).alias("realized"), "rejected")


@registry.query(
    "regime_hysteresis",
    lambda: """WITH RECURSIVE m AS (SELECT CAST(ts AS DATE) AS day, avg(value) AS v FROM events GROUP BY CAST(ts AS DATE)), c AS (SELECT day, greatest(0e0, least(100e0, 50 + (v - avg(v) OVER ()) * 4)) AS score, row_number() OVER (ORDER BY day) AS k FROM m),
r AS (SELECT day, k, score, CASE WHEN score >= 60 THEN 'risk_on' WHEN score <= 40 THEN 'risk_off' ELSE 'neutral' END AS regime FROM c WHERE k = 1
UNION ALL SELECT c.day, c.k, c.score, CASE WHEN c.score >= CASE WHEN regime = 'risk_on' THEN 55 ELSE 60 END THEN 'risk_on' WHEN c.score <= CASE WHEN regime = 'risk_off' THEN 45 ELSE 40 END THEN 'risk_off' ELSE 'neutral' END FROM r JOIN c ON c.k = r.k + 1)
SELECT day, regime FROM r""",
)
def regime_hysteresis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09: a regime by a score of 0 to 100, risk on from 60 and off from 40, that is left only five beyond its limit; one row a day, folded in order."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy(F.col("ts").cast("date").alias("day")).agg(F.avg("value").alias("v"))
    score = e.crossJoin(e.agg(F.avg("v").alias("m"))).select("day", F.greatest(F.lit(0.0), F.least(F.lit(100.0), 50 + (F.col("v") - F.col("m")) * 4)).alias("score"))
    rows = score.select(F.lit("market").alias("market"), keyed.moment("day").alias("ts"), "score")
    return keyed.replay(rows, ["market"], judgements.Regime()).select("day", "regime")


@registry.query(
    "weather_regime",
    lambda: f"""{source("weather")}, c AS (SELECT day, score, row_number() OVER (ORDER BY day) AS k FROM weather WHERE score IS NOT NULL),
r AS (SELECT day, k, score, CASE WHEN score >= 60 THEN 'risk_on' WHEN score <= 40 THEN 'risk_off' ELSE 'neutral' END AS regime FROM c WHERE k = 1
UNION ALL SELECT c.day, c.k, c.score, CASE WHEN c.score >= CASE WHEN regime = 'risk_on' THEN 55 ELSE 60 END THEN 'risk_on' WHEN c.score <= CASE WHEN regime = 'risk_off' THEN 45 ELSE 40 END THEN 'risk_off' ELSE 'neutral' END FROM r JOIN c ON c.k = r.k + 1)
SELECT 'market' AS market, day, score, regime FROM r""",
)
def weather_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-09: the regime of the market's weather, left only five beyond the limit it was entered by; the same fold follows a stream."""
    rows = run(spark, sf_dir, "weather").select(F.lit("market").alias("market"), keyed.moment("day").alias("ts"), "score")
    return keyed.replay(rows, ["market"], judgements.Regime())


@registry.query("thesis_store")
def thesis_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-04: the theses of each owner after their operations, here made up from orders."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kinds = F.array(*[F.lit(k) for k in ("long", "short", "pillar", "risk", "catalyst", "target", "stop", "conviction", "note", "close")])
    k = F.col("o_orderkey") % 10
    word = F.when(k == 7, F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("none")), (F.col("o_orderkey") % 3 + 1).cast("int"))).otherwise(F.col("o_orderpriority"))
    ops = o.select((F.col("o_custkey") % 200).alias("owner"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").cast("date").alias("day"), F.concat(F.lit("s"), F.col("o_custkey") % 37).alias("symbol"), F.element_at(kinds, (k + 1).cast("int")).alias("op"), word.alias("word"), (F.col("o_totalprice") / 1000).alias("value"))
    return books.theses(ops)


def _account(symbol: str) -> str:
    """Which of five accounts a brand belongs to, in either engine's SQL."""
    return f"concat('A', CAST(CAST(right({symbol}, 1) AS INT) % 5 AS STRING))"


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book, ts, kind, symbol, price, score, unit, barred, scale, qty, regime: each bar as a quote of its brand's book, scored by the month's return."""
    rows = engine.scored_rounds(run(spark, sf_dir, "bars"))
    return rows.select(
        F.expr(_account("symbol")).alias("book"), keyed.moment("day").alias("ts"), F.lit("quote").alias("kind"), "symbol", "price", "score", "unit",
        (F.dayofmonth("day") == 13).alias("barred"), F.when(F.dayofmonth("day") > 20, 0.5).alias("scale"), F.lit(None).cast("double").alias("qty"), "regime",
    )


def _newest(rows: DataFrame) -> int:
    """The latest moment of a table, in microseconds."""
    return rows.agg(F.max(F.unix_micros("ts"))).first()[0] or 0


@registry.query("shadow_books")
def shadow_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08: the same quotes run by the plain rule and by the layered engine: a round's cash, equity and orders of each book and rule."""
    rows = quotes(spark, sf_dir)
    upto = _newest(rows)
    books_ = [keyed.replay(rows, ["book"], paper.PaperBook(rule), upto) for rule in ("plain", "engine")]
    return books_[0].unionByName(books_[1]).select("book", "rule", "day", "cash", "equity", "positions", "forced", F.to_json("orders").alias("orders"))


@registry.query("mirror_books")
def mirror_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-08: books that begin with what a person holds, here each brand's first two buys, and are run by the engine from there."""
    rows = quotes(spark, sf_dir)
    began = rows.groupBy("book").agg(F.min("ts").alias("ts"))
    rank = F.row_number().over(W.partitionBy("symbol").orderBy("day", "event"))
    buys = run(spark, sf_dir, "journal").where("side = 'buy' and price > 0").withColumn("k", rank).where("k <= 2")
    none = {c: F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns}
    held = buys.withColumn("book", F.expr(_account("symbol"))).join(began, "book").select(*[{"book": F.col("book"), "ts": F.col("ts"), "kind": F.lit("holding").alias("kind"), "symbol": F.col("symbol"), "price": F.col("price"), "qty": F.col("qty").cast("double").alias("qty")}.get(c, none[c]) for c in rows.columns])
    cash = began.select(*[{"book": F.col("book"), "ts": F.col("ts"), "kind": F.lit("cash").alias("kind"), "price": F.lit(25_000.0).alias("price")}.get(c, none[c]) for c in rows.columns])
    out = keyed.replay(rows.unionByName(held).unionByName(cash), ["book"], paper.PaperBook("engine"), _newest(rows))
    return out.select("book", "day", "cash", "equity", "positions", "forced", F.to_json("orders").alias("orders"))


@registry.query("rearmed_triggers")
def rearmed_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-03: the levels of theses that fire over all prices, armed again by each edit; edits are made up from orders, four owners."""
    o = run(spark, sf_dir, "journal").where("price is not null")
    kinds = F.array(*[F.lit(k) for k in ("long", "stop", "target", "short", "stop", "target", "close", "long", "note")])
    near = F.when(F.col("event") % 2 == 0, F.col("price") * 0.9).otherwise(F.col("price") * 1.15)
    edits = o.select(F.concat(F.lit("o"), F.col("event") % 4).alias("owner"), keyed.moment("day").alias("ts"), "symbol", F.element_at(kinds, (F.col("event") % 9 + 1).cast("int")).alias("op"), F.col("event").cast("long").alias("seq"), F.col("mechanism").alias("word"), F.round(near, 2).alias("value"))
    watched = edits.select("owner", "symbol").distinct()
    # a day's prices come after its edits: they have no place among them
    prices = run(spark, sf_dir, "bars").join(watched, "symbol").select("owner", keyed.moment("day", 16).alias("ts"), "symbol", F.lit("price").alias("op"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("string").alias("word"), F.col("close").alias("value"))
    out = keyed.replay(edits.unionByName(prices), ["owner", "symbol"], judgements.Triggers())
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@registry.query("pick_outcomes")
def pick_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-05: picks made up from orders, settled by the bars of their symbols after their horizon, dropped where no price came, crowded out where there are too many."""
    o = run(spark, sf_dir, "journal").where("price is not null")
    source = F.when(F.col("event") % 3 == 0, "committee").when(F.col("event") % 3 == 1, "day_plan").otherwise("quant")
    name = F.when(F.col("event") % 29 == 0, F.concat(F.lit("gone "), "symbol")).otherwise(F.col("symbol"))
    picks = o.select(F.concat(F.lit("o"), F.col("event") % 5).alias("owner"), keyed.moment("day").alias("ts"), F.lit("pick").alias("op"), name.alias("symbol"), ((F.col("event") % 21 - 10) / 10).alias("score"), "price", source.alias("source"), F.when(F.col("event") % 3 == 1, 1).cast("int").alias("horizon"))
    watched = picks.select("owner", "symbol").distinct()
    prices = run(spark, sf_dir, "bars").join(watched, "symbol").select("owner", keyed.moment("day").alias("ts"), F.lit("price").alias("op"), "symbol", F.lit(None).cast("double").alias("score"), F.col("close").alias("price"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("int").alias("horizon"))
    rows = picks.unionByName(prices)
    return keyed.replay(rows, ["owner"], judgements.Picks(), _newest(rows))


@registry.query(
    "budgeted_orders",
    lambda: f"""WITH RECURSIVE bars AS ({compose("bars", DUCK)}),
b AS (SELECT symbol, day, close, lag(close, 20) OVER w AS before FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY day)),
s AS (SELECT 'A' || CAST(CAST(right(symbol, 1) AS INT) % 5 AS VARCHAR) AS account, day, symbol, close AS price, round(greatest(-1e0, least(1e0, (close / before - 1) * 12)), 6) AS score, round(close * 0.03e0, 6) AS unit,
  day(day) = 13 AS barred, CASE WHEN day(day) > 20 THEN 0.5e0 ELSE 1e0 END AS scale FROM b WHERE before IS NOT NULL),
h AS (SELECT *, CASE WHEN lag(score, 5) OVER (PARTITION BY symbol ORDER BY day) >= 0.5 THEN 10e0 + day(day) % 7 END AS held FROM s),
f AS (SELECT account, day, count(*) FILTER (held IS NOT NULL AND score > -0.2) AS stay FROM h GROUP BY account, day),
c AS (SELECT *, row_number() OVER (PARTITION BY account, day ORDER BY score DESC, symbol) AS k FROM h WHERE (held IS NULL OR score <= -0.2) AND NOT barred AND score >= 0.5),
r AS (SELECT account, day, CAST(0 AS BIGINT) AS k, 15000e0 + 1000 * (dayofyear(day) % 20) AS cash, 3 - stay AS room, CAST(NULL AS VARCHAR) AS symbol, CAST(0 AS BIGINT) AS qty, CAST(-1 AS BIGINT) AS place FROM f
  UNION ALL SELECT account, day, k, cash - q * price, room - CASE WHEN q >= 1 THEN 1 ELSE 0 END, sym, q, place + CASE WHEN q >= 1 THEN 1 ELSE 0 END
  FROM (SELECT r.account, r.day, c.k, r.cash, r.room, r.place, c.symbol AS sym, c.price, CASE WHEN r.room > 0 THEN CAST(floor(least(1000e0 / c.unit, 15000e0 / c.price, r.cash / c.price) * c.scale) AS BIGINT) ELSE 0 END AS q FROM r JOIN c ON c.account = r.account AND c.day = r.day AND c.k = r.k + 1) z)
SELECT account, day, CAST(place AS INT) AS place, symbol, 'buy' AS side, CAST(qty AS DOUBLE) AS qty FROM r WHERE qty >= 1
UNION ALL SELECT account, day, NULL, symbol, 'sell', held FROM h WHERE held IS NOT NULL AND score <= -0.2""",
)
def budgeted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR-07: the plain rule's orders with slots, cap and buying power, for each account and day; what was strong five bars ago is held."""
    q = quotes(spark, sf_dir)
    scored = q.select(F.col("book").alias("account"), F.date_from_unix_date(F.floor(F.unix_micros("ts") / keyed.DAY).cast("int")).alias("round"), "symbol", "score", "price", "unit", "barred", "scale")
    held = scored.withColumn("before", F.lag("score", 5).over(W.partitionBy("symbol").orderBy("round"))).where("before >= 0.5").select("account", "round", "symbol", (10.0 + F.dayofmonth("round") % 7).alias("qty"))
    accounts = scored.select("account", "round").distinct().select("account", "round", F.lit(100_000.0).alias("equity"), (15_000.0 + 1000 * (F.dayofyear("round") % 20)).alias("cash"))
    return budget.orders(scored, held, accounts, paper.Limits(slots=3)).withColumnRenamed("round", "day")
