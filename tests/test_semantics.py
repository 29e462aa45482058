"""Operators against plain Python and pandas, on made-up panels."""

from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewell import operators  # noqa: F401
from tidewell.operators import portfolio
from tidewell.plans.compose import apply, run
from tidewell.plans.suite import thesis
from tidewell.sources import parsers
from tidewell.sources.sinks import push
from tidewell.streaming import alerts, engine


def panel(n=420, symbols=("A", "B"), seed=42) -> pd.DataFrame:
    rng = np.random.default_rng(seed)
    out = []
    for s in symbols:
        close = 100 * np.exp(np.cumsum(rng.normal(0.0005, 0.015, n)))
        day = pd.date_range("2020-01-01", periods=n).date
        out.append(pd.DataFrame({"symbol": s, "day": day, "open": close, "high": close * 1.01, "low": close * 0.99, "close": close, "volume": rng.integers(1, 1000, n).astype(float)}))
    return pd.concat(out)


@pytest.fixture(scope="module")
def bars(spark):
    return spark.createDataFrame(panel())


def test_indicators_equal_pandas(spark, bars):
    c = panel().query("symbol == 'A'").set_index("day")["close"]
    rsi = apply(spark, "rsi", {"bars": bars}).where("symbol = 'A'").toPandas().set_index("day")
    d = c.diff()
    gain, loss = (x.clip(lower=0).ewm(alpha=1 / 14, min_periods=14).mean() for x in (d, -d))
    want = (100 - 100 / (1 + gain / loss)).fillna(50)
    assert np.allclose(rsi["rsi_rules"].astype(float), want.loc[rsi.index], atol=1e-5)
    macd = apply(spark, "macd", {"bars": bars}).where("symbol = 'A'").toPandas().set_index("day")
    line = c.ewm(span=12, adjust=False).mean() - c.ewm(span=26, adjust=False).mean()
    assert np.allclose(macd["macd_line"].astype(float), line.loc[macd.index], atol=1e-5)
    assert np.allclose(macd["signal"].astype(float), line.ewm(span=9, adjust=False).mean().loc[macd.index], atol=1e-5)
    band = apply(spark, "bollinger", {"bars": bars}).where("symbol = 'A'").toPandas().set_index("day")
    assert np.allclose(band["upper_band"].astype(float), (c.rolling(20).mean() + 2 * c.rolling(20).std()).loc[band.index], atol=1e-5)


def test_exponential_means_over_long_histories(spark):
    """20,000 rows of 5 symbols: every indicator with an exponential mean equals pandas to the last row."""
    frame = panel(20_000, tuple("ABCDE"), 7)
    noise = np.random.default_rng(9).normal(0, 0.02, len(frame))
    frame["close"] = 100 * np.exp(0.4 * np.sin(np.arange(len(frame)) / 300) + noise)
    bars = spark.createDataFrame(frame)
    got = {}
    for name in ("rsi", "macd", "levels", "weekly_bias"):
        got[name] = apply(spark, name, {"bars": bars}).toPandas()
    for symbol, g in frame.groupby("symbol"):
        c = g.set_index("day")["close"]
        of = {name: df[df["symbol"] == symbol].set_index("week" if name == "weekly_bias" else "day").sort_index() for name, df in got.items()}
        ema = lambda x, n, adjust: x.ewm(span=n, adjust=adjust).mean()
        d = c.diff()
        gain, loss = (x.clip(lower=0).ewm(alpha=1 / 14, min_periods=14).mean() for x in (d, -d))
        rsi = (100 - 100 / (1 + gain / loss)).fillna(50)
        assert len(of["rsi"]) == 19_999 and np.allclose(of["rsi"]["rsi_rules"].astype(float), rsi.loc[of["rsi"].index], atol=2e-6)
        line = ema(c, 12, False) - ema(c, 26, False)
        assert np.allclose(of["macd"]["macd_line"].astype(float), line, atol=2e-6) and np.allclose(of["macd"]["signal"].astype(float), ema(line, 9, False), atol=2e-6)
        line = ema(c, 12, True) - ema(c, 26, True)
        assert np.allclose(of["levels"]["ema10"].astype(float), ema(c, 10, True), atol=2e-6) and np.allclose(of["levels"]["signal"].astype(float), ema(line, 9, True), atol=2e-6)
        w = c.set_axis(pd.to_datetime(c.index)).resample("W").last()
        hist = (line := ema(w, 12, False) - ema(w, 26, False)) - ema(line, 9, False)
        ma = w.rolling(10).mean()
        want = np.where(ma.isna(), 0, np.where(w > ma, 1, -1)) + np.where(hist > 0, 1, -1)
        assert of["weekly_bias"]["bias"].astype(int).tolist() == want.tolist()


def test_no_look_ahead(spark, bars):
    """What the first rows give doesn't change when later rows come."""
    last = date(2020, 12, 1)
    for name in ("rsi", "macd", "entry_rules", "weekly_bias_daily", "regimes"):
        full = apply(spark, name, {"bars": bars}).where(F.col("day") <= last)
        cut = apply(spark, name, {"bars": bars.where(F.col("day") <= last)})
        assert sorted(map(str, full.collect())) == sorted(map(str, cut.collect()))


def test_barrier_equals_a_loop(spark, bars):
    got = apply(spark, "trades", {"bars": bars}).toPandas()
    entries = apply(spark, "entries", {"bars": bars}).toPandas()
    closes = {s: g["close"].to_numpy() for s, g in panel().groupby("symbol")}
    want = {}
    for e in entries.itertuples():
        px = closes[e.symbol]
        at = e.i + 1
        if at + 1 >= len(px):
            continue
        sign = -1 if e.short else 1
        for held in range(1, min(10, len(px) - 1 - at) + 1):
            move = sign * (px[at + held] / px[at] - 1)
            if move >= 0.05 - 1e-15 or move <= -0.03 + 1e-15:
                ret = 0.05 if move > 0 else -0.03
                break
        else:
            ret = move
        want[e.symbol, e.rule, e.i] = (ret - 0.001, held)
    have = {(r.symbol, r.rule, r.i): (r.ret, r.held) for r in got.itertuples()}
    assert have.keys() == want.keys() and len(have) > 50
    assert all(have[k] == pytest.approx(want[k]) for k in want)


def test_fifo_equals_a_queue(spark):
    rng = random.Random(3)
    rows, day = [], date(2021, 1, 1)
    for k in range(300):
        rows.append((k, rng.choice("AB"), day + timedelta(days=k), rng.choice(["buy", "sell"]), rng.randint(1, 9), None, 10.0 + k))
    journal = spark.createDataFrame(rows, "event long, symbol string, day date, side string, qty long, mechanism string, price double")
    bars = spark.createDataFrame([(s, day + timedelta(days=k), 1.0, 1.0, 1.0, 1.0 + k, 1.0) for s in "AB" for k in range(300)], "symbol string, day date, open double, high double, low double, close double, volume double")
    got = sorted((r.buy_event, r.sell_event, r.qty) for r in apply(spark, "fifo_pairs", {"journal": journal, "bars": bars}).collect())
    want = []
    for s in "AB":
        lots = []
        for k, sym, _, side, qty, _, _ in rows:
            if sym != s:
                continue
            if side == "buy":
                lots.append([k, qty])
            while side == "sell" and qty and lots:
                take = min(qty, lots[0][1])
                want.append((lots[0][0], k, take))
                qty, lots[0][1] = qty - take, lots[0][1] - take
                if not lots[0][1]:
                    lots.pop(0)
    assert got == sorted(want)


def test_empty_and_short_bars(spark, bars):
    for name in ("rsi", "backtest_all", "composite_score", "drawdown_periods", "walk_forward"):
        assert apply(spark, name, {"bars": bars.where("false")}).count() == 0
    one = bars.where("day = date'2020-01-01'")
    assert apply(spark, "rsi", {"bars": one}).count() == 0
    assert [r.score for r in apply(spark, "composite_score", {"bars": one}).collect()] == [0.0, 0.0]


def test_portfolio_solvers():
    rng = np.random.default_rng(7)
    x = rng.normal(0.0005, 0.01, (750, 5)) @ (np.eye(5) + 0.3 * rng.random((5, 5)))
    mean, cov = x.mean(0), np.cov(x.T)
    equal = np.full(5, 0.2)
    w = portfolio.least_variance(cov)
    assert w.sum() == pytest.approx(1) and (w >= 0).all() and w @ cov @ w <= equal @ cov @ equal
    grad = cov @ w
    assert all(grad[k] >= grad[w > 1e-6].min() - 1e-7 for k in range(5))
    s = portfolio.best_sharpe(mean, cov)
    assert mean @ s / np.sqrt(s @ cov @ s) >= mean @ equal / np.sqrt(equal @ cov @ equal) - 1e-9
    for _ in range(300):  # no random long-only portfolio does better
        v = rng.dirichlet(np.full(5, 0.5))
        assert mean @ s / np.sqrt(s @ cov @ s) >= mean @ v / np.sqrt(v @ cov @ v) - 1e-9
    e = portfolio.equal_risk(cov)
    share = e * (cov @ e)
    assert share / share.sum() == pytest.approx(equal, abs=1e-6)
    assert portfolio.hierarchical(cov).sum() == pytest.approx(1)
    assert np.linalg.eigvalsh(portfolio.shrunk(x))[0] > 0
    assert portfolio.equal_risk(np.zeros((3, 3))) == pytest.approx(np.full(3, 1 / 3))


def test_xirr():
    assert portfolio.xirr([0, 365], [-100, 110]) == pytest.approx(0.1, abs=1e-3)
    assert portfolio.xirr([0, 10], [1, 2]) is None


ROUND = "account string, day date, symbol string, score double, price double, unit double, regime string"


def test_engine_mechanisms():
    """One mechanism a case: stop, trailing stop above the entry, half at 1.5 units, held loss, dead money."""
    p = lambda **x: engine.Position(**{"entry": 100.0, "unit": 5.0, "peak": 100.0, "opened": "2024-01-01", "first_qty": 10, "qty": 10} | x)
    rules = engine.Rules()
    assert engine.way_out(p(), 95, 0, "2024-01-02", False, rules) == ("stop_loss", 10)
    assert engine.way_out(p(peak=106.0), 100, 0, "2024-01-02", False, rules) == ("trailing_stop", 10)
    assert engine.way_out(p(peak=108.0), 107.5, 0, "2024-01-02", False, rules) == ("scale_out", 5)
    assert engine.way_out(p(), 99, -0.5, "2024-01-02", False, rules) == ("hold", 0)
    assert engine.way_out(p(), 101, -0.5, "2024-01-02", False, rules) == ("signal_exit", 10)
    assert engine.way_out(p(), 101, 0, "2024-02-02", False, rules) == ("dead_money", 10)
    a = engine.Account(positions={s: p() for s in "abc"})
    orders = engine.play(a, "2024-01-05", [{"symbol": s, "score": 0.9, "price": 90.0, "unit": 5.0} for s in "abcd"], None)
    assert [o["mechanism"] for o in orders] == ["stop_loss"] * 3 and a.halted == "2024-01-08" and set(a.resting) == set("abc")
    assert engine.Account.load(a.dump()) == a


def test_stream_equals_batch(spark, bars, tmp_path):
    scored = engine.scored_rounds(apply(spark, "composite_score", {"bars": bars}).sparkSession.createDataFrame(panel(120)))
    want = sorted(map(str, engine.replay(scored).collect()))
    days = [r[0] for r in scored.select("day").distinct().orderBy("day").collect()]
    src = tmp_path / "in"
    for k, (a, b) in enumerate([(0, 40), (40, 100)]):
        scored.where(F.col("day").between(days[a], days[b - 1])).coalesce(1).write.mode("append").parquet(str(src / f"part={k}"))
    stream = spark.readStream.schema(ROUND).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{src}/part=*")
    q = engine.replay_stream(stream.select(*scored.columns)).writeStream.format("memory").queryName("orders_").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(map(str, spark.table("orders_").collect())) == want and want


def test_cooldown_stream_and_windows(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("A", "x", t0 + timedelta(hours=h)) for h in (0, 0, 5, 24, 30, 47, 48, 100)]
    df = spark.createDataFrame(rows, "symbol string, category string, ts timestamp").coalesce(1)
    want = [0, 0, 24, 48, 100]
    assert sorted((r.ts - t0).total_seconds() / 3600 for r in alerts.cooldown(df).collect()) == want
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = alerts.cooldown_stream(stream).writeStream.format("memory").queryName("sent_").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.ts - t0).total_seconds() / 3600 for r in spark.table("sent_").collect()) == want


def test_hourly_stream_equals_batch_on_closed_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    want = {(r.symbol, r.ts): r.n for r in alerts.hourly(events).collect()}
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/event*.parquet")
    q = alerts.hourly(stream).writeStream.format("memory").queryName("hours_").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.symbol, r.ts): r.n for r in spark.table("hours_").collect()}
    assert got and all(want[k] == n for k, n in got.items()) and len(want) - len(got) <= 20


def test_parsers(spark):
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    got = parsers.short_volume(lines("Date|Symbol|S|E|T|M", "20240102|ab|10|0|40|N", "20240102|AB|5|0|10|Q", "bad", "20240102|C|x|0|1|N")).collect()
    assert [(r.symbol, r.short, r.total, r.share) for r in got] == [("AB", 15.0, 50.0, 0.3)]
    f = parsers.fails(lines(*[f"202401{d:02d}|c|AB|1,000|n|{'.' if d == 12 else '1.5'}" for d in range(1, 13)])).collect()
    assert len(f) == 10 and [r.price for r in f if r.day.day == 12] == [None] and f[0].qty == 1000
    xml = "<doc><rptOwnerName>Doe</rptOwnerName><nonDerivativeTransaction><transactionDate><value>2024-01-02</value></transactionDate><transactionCoding><transactionCode>P</transactionCode></transactionCoding><transactionShares><value>100</value></transactionShares><transactionPricePerShare><value>2.5</value></transactionPricePerShare><transactionAcquiredDisposedCode><value>A</value></transactionAcquiredDisposedCode></nonDerivativeTransaction><derivativeTransaction/></doc>"
    r = parsers.form4(spark.createDataFrame([(xml,)], "xml string")).collect()[0]
    assert (r.owner, r.derivatives, str(r.day), r.code, r.ad, r.shares, r.price) == ("Doe", 1, "2024-01-02", "P", "A", 100.0, 2.5)
    t = "<n1:informationTable><n1:infoTable><n1:nameOfIssuer>X</n1:nameOfIssuer><n1:cusip>1</n1:cusip><n1:value>5</n1:value><n1:shrsOrPrnAmt><n1:sshPrnamt>7</n1:sshPrnamt></n1:shrsOrPrnAmt><n1:putCall>Put</n1:putCall></n1:infoTable><n1:infoTable><n1:nameOfIssuer>Y</n1:nameOfIssuer></n1:infoTable></n1:informationTable>"
    r = parsers.form13f(spark.createDataFrame([(t,)], "xml string")).orderBy("issuer").collect()
    assert [(x.issuer, x.value, x.shares, x.put_call) for x in r] == [("X", 5.0, 7.0, "Put"), ("Y", None, None, None)]
    o = parsers.observations(lines('{"series": "S", "observations": [{"date": "2024-01-01", "value": "1.5"}, {"date": "2024-02-01", "value": "."}]}')).collect()
    assert [(x.series, x.value) for x in o] == [("S", 1.5)]
    h = ["date", "product", "identity", "long_oi(lots)", "short_oi(lots)", "net_oi"]
    r = parsers.futures(lines('2024/01/02,TX,Foreign,"1,500",500,', "2024/01/02,MX,Dealer,1,1,0"), h, "TX").collect()[0]
    assert (r.identity, r.net_oi) == ("foreign", 1000.0)
    r = parsers.holdings_text(lines("ab:10:5", "AB:10:7", "c:0.5:1", "bad", "d:x:1")).collect()
    assert [(x.symbol, x.qty, x.cost) for x in r] == [("AB", 20.0, 6.0)]
    r = spark.createDataFrame([("AAPL240119C00150500",), ("bad",)], "s string").select(parsers.option_symbol("s").alias("o")).collect()
    assert (r[0].o.root, str(r[0].o.expiry), r[0].o.cp, r[0].o.strike) == ("AAPL", "2024-01-19", "C", 150.5) and r[1].o is None
    r = parsers.statement_row(spark.createDataFrame([("Total Revenue", 1.0), ("Other total revenue x", 2.0)], "label string, v double"), ["TotalRevenue"]).collect()
    assert [x.v for x in r] == [1.0]
    assert spark.createDataFrame([("verdict: buy ... Verdict: SELL",), ("none",)], "t string").select(parsers.last_verdict("t").alias("v")).collect()[0].v == "SELL"
    assert parsers.tickers(spark.createDataFrame([("看AAPL和TSLA abcDEF",)], "text string")).collect()[0].symbols == ["AAPL", "TSLA"]
    assert [r.t is None for r in spark.createDataFrame([("2024-01-02T03:04:05.678Z",), ("x",)], "s string").select(parsers.rfc3339("s").alias("t")).collect()] == [False, True]


def test_bracket_needs_a_cent_between_its_prices(spark):
    rows = [(1, "A", "buy", 5, 100.0), (2, "A", "buy", 0, 100.0), (3, "A", "buy", 5, None), (4, "A", "buy", 5, 0.1), (5, "A", "sell", 5, 9.0)]
    journal = spark.createDataFrame(rows, "event long, symbol string, side string, qty long, price double")
    got = {r.event: (r.limit_, r.stop, r.target, r.reject) for r in apply(spark, "brackets", {"journal": journal}).collect()}
    assert got == {1: (100.0, 98.0, 104.0, None), 2: (100.0, 98.0, 104.0, "qty"), 3: (None, None, None, "price"), 4: (0.1, 0.098, 0.104, "stop")}


def test_thesis_with_another_basket(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")  # the smallest tables have too few days that many symbols share
    bars, orders = run(spark, sf, "bars").cache(), spark.read.parquet(f"{sf}/orders.parquet")
    got = {r.test: (r.n, r.survived) for r in thesis(spark, {"bars": bars, "orders": orders}, {"same": {"bars": bars}}, least=60).collect()}
    assert sorted(k[:2] for k in got) == [f"T{k}" for k in range(1, 9)]
    assert got["T8 same"] == got["T1 drift"] and got["T1 drift"][0] > 0


def test_alerts_are_pushed_by_batch(spark, sf, tmp_path):
    events, sent = spark.read.parquet(f"{sf}/events.parquet"), []
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/event*.parquet").where("value > 0")
    q = push(stream, lambda df, number: sent.append((number, df.count())), str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120) and sum(n for _, n in sent) == events.where("value > 0").count()


def test_shrinkage_equals_the_formula_and_frontier_rises(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.01, (120, 4)) @ (np.eye(4) + 0.4)
    rows = [(f"S{j}", date(2024, 1, 1) + timedelta(days=i), float(x[i, j])) for i in range(120) for j in range(4) if (i, j) != (7, 2)]
    table = spark.createDataFrame(rows, "symbol string, day date, r double")
    got = {(r.s, r.t): r["cov"] for r in portfolio.shrinkage(table).collect()}
    want = portfolio.shrunk(np.delete(x, 7, axis=0))
    assert all(got[f"S{i}", f"S{j}"] == pytest.approx(want[i, j], abs=1e-9) for i in range(4) for j in range(4))
    line = portfolio.efficient_frontier(table).orderBy("point").collect()
    assert all(b.deviation >= a.deviation - 1e-6 and b.expected >= a.expected - 1e-6 for a, b in zip(line, line[1:]))


def test_grid_equals_the_barrier_of_each_set(spark, bars):
    """The shared paths give what a loop over closes gives for each of the 27 sets."""
    got = {(r.symbol, r.rule, round(float(r.tp), 3), round(float(r.sl), 3), r.h): r for r in apply(spark, "grid", {"bars": bars}).collect()}
    entries = apply(spark, "entries", {"bars": bars}).collect()
    closes = {s: g["close"].to_numpy() for s, g in panel().groupby("symbol")}
    for tp in (0.03, 0.05, 0.08):
        for sl in (0.02, 0.03, 0.05):
            for h in (5, 10, 20):
                rets = {}
                for e in entries:
                    px, at, sign = closes[e.symbol], e.i + 1, -1 if e.short else 1
                    if at + 1 >= len(px):
                        continue
                    for held in range(1, min(h, len(px) - 1 - at) + 1):
                        move = sign * (px[at + held] / px[at] - 1)
                        if move >= tp - 1e-15 or move <= -sl + 1e-15:
                            move = tp if move > 0 else -sl
                            break
                    rets.setdefault((e.symbol, e.rule), []).append((move - 0.001, held))
                for (s, rule), of in rets.items():
                    r = got[s, rule, tp, sl, h]
                    assert (r.trades, r.expectancy, r.avg_held) == pytest.approx((len(of), np.mean([x for x, _ in of]), np.mean([k for _, k in of])))


def test_cooldown_holds_a_batch_of_a_key_at_most(spark):
    """A key's rows came to Python as one group. Batches of 7 rows, times that repeat, a row without a time, a key that is null."""
    t0 = datetime(2024, 1, 1)
    hours = [(11 * k * k) % 400 // 2 for k in range(120)]
    rows = [(s, "c", t0 + timedelta(hours=h)) for s in ("A", None) for h in hours] + [("A", "c", None), ("B", "c", None), ("B", "c", None)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        out = alerts.cooldown(spark.createDataFrame(rows, "symbol string, category string, ts timestamp").repartition(3))
        got = out.collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = [h for h, go in zip(sorted(hours), alerts.passed([t0 + timedelta(hours=h) for h in sorted(hours)], None, 24)[0]) if go]
    for s in ("A", None):
        assert sorted((r.ts - t0).total_seconds() / 3600 for r in got if r.symbol == s) == want
    assert [r.ts for r in got if r.symbol == "B"] == [None]
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
