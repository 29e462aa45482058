"""Folds by key: a table and a stream give the same rows, and both are what a loop over the cases says."""

from __future__ import annotations

import random
import tempfile
from datetime import UTC, date, datetime, timedelta

import pytest

from tidewell.streaming import judgements, keyed, paper

T0 = datetime(2024, 3, 1, 15, tzinfo=UTC)
DAY0 = T0.date()


def at(days: float) -> datetime:
    return T0 + timedelta(days=days)


def micros(t: datetime) -> int:
    return int(t.timestamp()) * 1_000_000


def streamed(spark, rows, schema, keys, fold, files):
    """The rows dealt to files in order of time, followed as a stream; a last file far ahead lets the watermark pass them all."""
    rows = sorted(rows, key=lambda r: r[1])
    folder, n = tempfile.mkdtemp(), -(-len(rows) // files)
    last = [(*("far away",), rows[-1][1] + timedelta(days=400), *([None] * (len(rows[0]) - 2)))]
    for k in range(files + 1):
        part = last if k == files else rows[k * n : (k + 1) * n]
        if part:
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    name = f"t{random.randrange(10**9)}"
    query = keyed.follow(stream, keys, fold).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", tempfile.mkdtemp()).trigger(availableNow=True).start()
    assert query.awaitTermination(300) and query.exception() is None
    return [tuple(r) for r in spark.table(name).collect()]


def replayed(spark, rows, schema, keys, fold):
    upto = max(micros(r[1]) for r in rows) + 399 * keyed.DAY
    shuffled = random.Random(1).sample(rows, len(rows))
    return [tuple(r) for r in keyed.replay(spark.createDataFrame(shuffled, schema).repartition(3), keys, fold, upto).collect()]


BOOK = "book string, ts timestamp, kind string, symbol string, price double, score double, unit double, barred boolean, scale double, qty double, regime string"


def quote(book, day, symbol, price, score, unit=None, barred=None, scale=None):
    return (book, at(day), "quote", symbol, price, score, unit, barred, scale, None, "risk_on")


def test_plain_rule_equals_a_loop():
    """Slots, cap, buying power and scale against a loop that spends share by share."""
    rng = random.Random(7)
    lim = paper.Limits(slots=4)
    for _ in range(400):
        quotes = {s: {"symbol": s, "price": rng.choice([0.0, None, 5.0, 40.0, 333.0, 7000.0]), "score": rng.choice([-0.9, -0.2, 0.1, 0.5, 0.6, 0.9, None]), "unit": rng.choice([None, 0.0, 1.0, 12.5]), "barred": rng.random() < 0.1, "scale": rng.choice([None, 0.0, 0.4, 2.0, -1.0, float("nan")])} for s in rng.sample("ABCDEFGHIJ", rng.randint(0, 10))}
        held = {s: rng.choice([0.0, 3.0, 20.0]) for s in rng.sample("ABCDEFGHIJ", rng.randint(0, 5))}
        equity, cash = rng.choice([0.0, 10_000.0, 100_000.0]), rng.choice([500.0, 20_000.0])
        left, free, want = cash, lim.slots - len(held), []
        for s, q in held.items():
            if s in quotes and (quotes[s]["score"] or 0) <= -0.2 and q:
                want.append((s, "sell", q))
                free += 1
        sold = {s for s, *_ in want}
        for q in sorted(quotes.values(), key=lambda q: (-(q["score"] or 0), q["symbol"])):
            if free < 1 or equity <= 0 or (q["score"] or 0) < 0.5 or not q["price"] or q["barred"] or q["symbol"] in held and q["symbol"] not in sold:
                continue
            most = 0
            while (most + 1) * (q["unit"] or q["price"] * 0.05) <= equity * 0.01 and (most + 1) * q["price"] <= min(equity * 0.15, left):
                most += 1
            exact = min(equity * 0.01 / (q["unit"] or q["price"] * 0.05), equity * 0.15 / q["price"], left / q["price"])
            assert abs(most - int(exact)) <= 1e-9
            scale = {None: 1.0, 0.0: 0.0, 0.4: 0.4, 2.0: 1.0, -1.0: 0.0}.get(q["scale"], 1.0)
            n = int(exact * scale)
            if n:
                want.append((q["symbol"], "buy", float(n)))
                left -= n * q["price"]
                free -= 1
        assert [(o["symbol"], o["side"], o["qty"]) for o in paper.plain(quotes, held, equity, cash, lim)] == want


def test_budgeted_orders_of_many_rounds_equal_the_rule(spark):
    """The fold over tables against the rule, round by round."""
    from tidewell.operators import budget

    rng, lim, scored, held, accounts, want = random.Random(11), paper.Limits(slots=4), [], [], [], []
    for r in range(120):
        account, equity, cash = f"a{r % 3}", rng.choice([0.0, 10_000.0, 100_000.0]), rng.choice([500.0, 20_000.0])
        quotes = {s: {"symbol": s, "price": rng.choice([0.0, None, 5.0, 40.0, 333.0]), "score": rng.choice([-0.9, -0.2, 0.1, 0.5, 0.6, 0.9, None]), "unit": rng.choice([None, 0.0, 1.0, 12.5]), "barred": rng.choice([None, False, False, True]), "scale": rng.choice([None, 0.0, 0.4, 2.0, -1.0, float("nan")])} for s in rng.sample("ABCDEFGHIJ", rng.randint(1, 10))}
        book = {s: rng.choice([0.0, 3.0, 20.0]) for s in rng.sample("ABCDEFGHIJ", rng.randint(0, 5))}
        scored += [(account, r, s, q["score"], q["price"], q["unit"], q["barred"], q["scale"]) for s, q in quotes.items()]
        held += [(account, r, s, q) for s, q in book.items()]
        accounts.append((account, r, equity, cash))
        want += [(account, r, o["symbol"], o["side"], o["qty"]) for o in paper.plain(quotes, book, equity, cash, lim)]
    got = budget.orders(
        spark.createDataFrame(scored, "account string, round int, symbol string, score double, price double, unit double, barred boolean, scale double"),
        spark.createDataFrame(held, "account string, round int, symbol string, qty double"),
        spark.createDataFrame(accounts, "account string, round int, equity double, cash double"), lim,
    ).collect()
    assert sorted((r.account, r.round, r.symbol, r.side, r.qty) for r in got) == sorted(want) and len(want) > 50
    places = {}
    for r in sorted((r for r in got if r.side == "buy"), key=lambda r: (r.account, r.round, r.place)):
        places.setdefault((r.account, r.round), []).append(r.place)
    assert all(p == list(range(len(p))) for p in places.values())


def book_rows():
    rng, rows = random.Random(3), []
    for book in "XYZ":
        level = {s: rng.uniform(20, 200) for s in "ABCDEFG"}
        for day in range(60):
            for s in "ABCDEFG":
                level[s] *= 1 + rng.uniform(-0.06, 0.065)
                if rng.random() < 0.9 and not (s == "C" and 20 <= day < 33) and not (book == "Z" and 30 <= day < 44):
                    rows.append(quote(book, day, s, round(level[s], 2), round(rng.uniform(-0.6, 1), 3), round(level[s] * 0.03, 3), rng.random() < 0.05, rng.choice([None, 0.5])))
    return rows


@pytest.mark.parametrize("rule", ["plain", "engine"])
def test_books_of_a_table_and_a_stream(spark, rule):
    rows = book_rows()
    batch = replayed(spark, rows, BOOK, ["book"], paper.PaperBook(rule))
    stream = streamed(spark, rows, BOOK, ["book"], paper.PaperBook(rule), 6)
    assert sorted(batch, key=str) == sorted(stream, key=str) and len(batch) > 150
    assert any(o.mechanism == "stale" for r in batch for o in r[-1]) and all(r[3] >= -1e-6 for r in batch)
    if rule == "engine":
        plain = replayed(spark, rows, BOOK, ["book"], paper.PaperBook("plain"))
        assert {(r[0], r[2]): r[4] for r in plain} != {(r[0], r[2]): r[4] for r in batch}


def test_a_mirror_book_begins_with_holdings(spark):
    rows = [
        ("m", at(0), "cash", None, 1000.0, None, None, None, None, None, None),
        ("m", at(0), "holding", "A", 100.0, None, None, None, None, 10.0, None), ("m", at(0), "holding", "A", 200.0, None, None, None, None, 10.0, None),
        ("m", at(0), "holding", "B", 10.0, None, None, None, None, 0.5, None), ("m", at(0), "holding", "D", 50.0, None, None, None, None, 4.0, None),
        quote("m", 0, "A", 155.0, 0.1), quote("m", 1, "A", 149.0, 0.1), quote("m", 2, "A", 142.0, 0.1), quote("m", 3, "A", 142.0, 0.1),
    ]
    got = {r[2]: r for r in replayed(spark, rows, BOOK, ["book"], paper.PaperBook("engine"))}
    assert got[DAY0][3:6] == (1000.0, 1000 + 20 * 155 + 4 * 50, 2)  # the half share is refused, A is held at 150
    assert got[DAY0 + timedelta(days=1)][-1] == [] and got[DAY0 + timedelta(days=2)][-1][0].mechanism == "stop_loss"  # five percent below cost
    closed = got[DAY0 + timedelta(days=5)]  # D was never quoted: closed by itself on the fifth day, at its cost
    assert closed[3:7] == (1000 + 20 * 142 + 200.0, 1000 + 20 * 142 + 200.0, 0, 1) and tuple(closed[-1][0]) == ("D", "sell", 4.0, 50.0, "stale")


def test_stale_close_and_its_reset(spark):
    rows = [quote("s", 0, "A", 100.0, 0.9, 5.0), quote("s", 0, "B", 50.0, 0.9, 5.0)] + [quote("s", d, "Q", 1.0, 0.0) for d in (1, 2, 3, 4)] + [quote("s", 4.1, "A", 90.0, 0.0), quote("s", 5, "Q", 1.0, 0.0), quote("s", 6, "Q", 1.0, 0.0), quote("s", 9, "Q", 1.0, 0.0), quote("s", 10, "A", 80.0, 0.0), quote("s", 30, "Q", 1.0, 0.0)]
    out = replayed(spark, rows, BOOK, ["book"], paper.PaperBook("plain"))
    forced = [(r[2], o.symbol, o.price) for r in out for o in r[-1] if o.mechanism == "stale"]
    # B is unquoted since day 1 and goes on day 6; A comes back on days 4 and 10, is unquoted since day 30 and goes on day 35
    assert sorted(forced) == [(DAY0 + timedelta(days=6), "B", 50.0), (DAY0 + timedelta(days=35), "A", 80.0)]


TRIGGERS = "owner string, ts timestamp, symbol string, op string, seq long, word string, value double"


def test_levels_fire_once_and_again_when_set(spark):
    edits = [
        ("o", at(0), "A", "stop", 1, None, 90.0), ("o", at(0), "A", "long", 2, "it grows", None), ("o", at(0), "A", "stop", 3, None, 80.0), ("o", at(0), "A", "target", 4, None, 120.0), ("o", at(0), "A", "target", 5, None, -1.0),
        ("o", at(4.5), "A", "stop", 6, None, 75.0), ("o", at(8.5), "A", "short", 7, "it shrinks", None), ("o", at(10.5), "A", "close", 8, None, None),
        ("p", at(0), "A", "short", 1, "no", None), ("p", at(0), "A", "stop", 2, None, 110.0), ("p", at(3.5), "A", "target", 3, None, 78.0), ("q", at(0), "A", "long", 1, " ", None), ("q", at(0), "A", "stop", 2, None, 500.0),
    ]
    prices = [100, 95, 80, 79, 78, 75, 70, 121, 130, 119, 60, 50]
    rows = edits + [(o, at(d + 0.1), "A", "price", None, None, float(p)) for o in "opq" for d, p in enumerate(prices)] + [("o", at(1.2), "A", "price", None, None, None)]
    want = {
        ("o", 2, "stop", 80.0, 80.0, "damaged"), ("o", 5, "stop", 75.0, 75.0, "damaged"), ("o", 7, "target", 120.0, 121.0, "damaged"),
        ("o", 9, "stop", 75.0, 119.0, "damaged"), ("o", 9, "target", 120.0, 119.0, "damaged"),
        ("p", 7, "stop", 110.0, 121.0, "damaged"), ("p", 4, "target", 78.0, 78.0, "active"),
    }
    batch = replayed(spark, rows, TRIGGERS, ["owner", "symbol"], judgements.Triggers())
    name = lambda r: (r[0], (r[2].replace(tzinfo=UTC) - T0).days, *r[3:7])
    assert {name(r) for r in batch} == want and len(batch) == len(want)
    stream = streamed(spark, rows, TRIGGERS, ["owner", "symbol"], judgements.Triggers(), 5)
    assert sorted(stream, key=str) == sorted(batch, key=str)


PICKS = "owner string, ts timestamp, op string, symbol string, score double, price double, source string, horizon int"


def test_picks_settle_drop_and_crowd(spark):
    d = lambda n: DAY0 + timedelta(days=n)
    rows = [
        ("o", at(0), "pick", "a", 0.7, 100.0, None, None), ("o", at(0), "pick", "A", 0.9, 100.0, "quant", None), ("o", at(0), "pick", "B", -0.5, 50.0, "day", 1), ("o", at(0), "pick", "C", 0.0, 10.0, "quant", None),
        ("o", at(0), "pick", "N", 0.4, 10.0, "quant", None), ("o", at(0), "pick", "M", 0.4, 10.0, "quant", 1), ("o", at(0), "pick", None, 1.0, 1.0, "x", None), ("o", at(0), "pick", "Z", 1.0, 0.0, "x", None),
        ("o", at(1), "price", "B", None, 45.0, None, None), ("o", at(4), "price", "A", None, 150.0, None, None), ("o", at(5), "price", "A", None, 90.0, None, None), ("o", at(6), "price", "C", None, 11.0, None, None),
    ]
    rows += [("p", at(0), "pick", f"S{k}", 0.5, 10.0, "quant", None) for k in range(32)] + [("p", at(31), "price", "S9", None, 12.0, None, None), ("p", at(31), "price", "S8", None, None, None, None)]
    rows += [("r", at(k), "pick", "L", 0.5, 10.0, "day", 1) for k in range(70)] + [("r", at(k + 0.1), "price", "L", None, 11.0, None, None) for k in range(71)]
    batch = replayed(spark, rows, PICKS, ["owner"], judgements.Picks())
    of = {(r[0], r[1], r[3]): r for r in batch}
    assert of["o", "B", d(0)][4:] == (-0.5, 50.0, 1, "settled", d(1), -0.1, True, 1, 1)
    assert of["o", "A", d(0)][4:] == (0.9, 100.0, 5, "settled", d(5), -0.1, False, 1, 2) or of["o", "A", d(0)][4] == 0.7
    assert of["o", "C", d(0)][7:11] == ("settled", d(6), 0.1, None)
    assert of["o", "M", d(0)][7:9] == ("dropped", d(11)) and of["o", "N", d(0)][7:9] == ("dropped", d(31))  # by themselves
    assert len([r for r in batch if r[0] == "o"]) == 5
    p = [r[7] for r in batch if r[0] == "p"]
    assert p.count("crowded") == 2 and of["p", "S9", d(0)][7:10] == ("settled", d(31), 0.2) and p.count("dropped") == 29
    assert all(r[7] == "settled" for r in batch if r[0] == "r") and max(r[12] for r in batch if r[0] == "r") == judgements.MOST_HISTORY
    stream = streamed(spark, rows, PICKS, ["owner"], judgements.Picks(), 7)
    assert sorted(stream, key=str) == sorted(batch, key=str)


def test_replay_takes_empty_tables_and_null_keys(spark):
    none = keyed.replay(spark.createDataFrame([], PICKS), ["owner"], judgements.Picks())
    assert none.count() == 0 and none.columns[:2] == ["owner", "symbol"]
    rows = [(None, at(0), "pick", "A", 1.0, 1.0, None, None), ("o", None, "pick", "A", 1.0, 1.0, None, None)]
    assert keyed.replay(spark.createDataFrame(rows, PICKS), ["owner"], judgements.Picks(), 10**18).count() == 0
    assert keyed.day_of(micros(T0)) == date(2024, 3, 1)


@pytest.mark.parametrize("zone", ["UTC", "Asia/Taipei", "America/New_York"])
def test_days_do_not_depend_on_the_zone_of_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        day = date(2024, 3, 10)
        rows = spark.sql("SELECT DATE '2024-03-10' AS day, 'm' AS market, 70D AS score")
        at = rows.select(keyed.moment("day").alias("a"), keyed.moment("day", 16).alias("b")).selectExpr("unix_micros(a) AS a", "unix_micros(b) AS b").first()
        assert (at.a, at.b) == (keyed.midnight(day), keyed.midnight(day) + 16 * 3_600_000_000)
        assert keyed.replay(rows.withColumn("ts", keyed.moment("day")).drop("day"), ["market"], judgements.Regime()).first().day == day
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
