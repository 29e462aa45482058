"""Written answers and questions against plain Python."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tidewell.sources import answers as a

TEXT = """If it breaks, 方向: 觀望. 結論：觀望 at first.
立場: +0.75 and later 立場: -1
結論: 買進
信心：中
時間框架: 3-6月 "rest of line is cut after twenty characters"
風控意見: 有條件放行 評級:加碼
AAPL: 買進
BRK-B：迴避
aapl : 觀望
首選: BRK-B"""
ENGLISH = "Verdict: avoid\nStance: 2.5\nconfidence: High\nRisk opinion: veto\nrating: reduce\nVerdict: Buy\ntop pick: none\nHorizon: weeks"


def test_fields(spark):
    df = spark.createDataFrame([("zh", TEXT), ("en", ENGLISH), ("none", None), ("empty", "結論: ?")], "k string, t string")
    t = F.col("t")
    got = {r.k: tuple(r)[1:] for r in df.select("k", *[a.field(t, n) for n in a.FIELDS], a.horizon(t), a.stance(t), a.top_pick(t)).collect()}
    assert got["zh"] == ("buy", "medium", "wait", "conditional", "add", '3-6月 "rest of line i', 0.75, "BRK-B")
    assert got["en"] == ("buy", "high", None, "veto", "reduce", "weeks", 1.0, None)
    assert got["none"] == got["empty"] == (None,) * 8


def test_verdicts_by_symbol(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None)], "k int, t string")
    symbols = spark.createDataFrame([(1, "AAPL"), (1, "BRK-B"), (1, "MSFT"), (2, "AAPL"), (3, "AAPL")], "k int, symbol string")
    got = {(r.k, r.symbol): r.verdict for r in a.verdicts(df, "k", "t", symbols).collect()}
    assert got == {(1, "AAPL"): "wait", (1, "BRK-B"): "avoid", (1, "MSFT"): None, (2, "AAPL"): None, (3, "AAPL"): None}


def test_tagged_news(spark):
    t = "1. [利多] strong orders\n2、【利空】" + "x" * 60 + "\nnoise\n3. 中性\n4. [good] beyond\n0. [bad] none\n2. (neutral) again"
    df = spark.createDataFrame([("a", t, 3), ("b", None, 5)], "k string, t string, n int")
    got = sorted((r.k, r.i, r.tag, r.reason) for r in a.tagged_news(df, "k", "t", "n").collect())
    assert got == sorted([("a", 0, "good", "strong orders"), ("a", 1, "bad", "x" * 40), ("a", 2, "neutral", ""), ("a", 1, "neutral", "again")])


def test_agreement_of_verdict_and_score(spark):
    cases = [(v, s) for v in ("buy", "wait", "avoid", None) for s in (-0.9, -0.2, 0.0, 0.2, 0.21, None)]
    got = {(r.v, r.s): r.g for r in spark.createDataFrame(cases, "v string, s double").select("v", "s", a.agreement(F.col("v"), F.col("s")).alias("g")).collect()}
    for v, s in cases:
        if v is None or s is None:
            assert got[v, s] is None
            continue
        x, y = {"buy": 1, "wait": 0, "avoid": -1}[v], (s > 0.2) - (s < -0.2)
        assert got[v, s] == ("same" if x == y else "opposite" if x * y < 0 else "partly")


def test_intents_equal_a_loop(spark):
    rng, words = random.Random(2), [*a.INTENTS, "hello", "stocks", "財"]
    own = {"rsi": "risk", "moat": "fundamental"}
    rows = [(k, " ".join(rng.choice([*words, "moat"]).upper() for _ in range(rng.randint(0, 4))), rng.random() < 0.5, own if k % 2 else None) for k in range(200)] + [(900, None, True, None), (901, "", False, None)]
    df = spark.createDataFrame(rows, "k int, q string, has boolean, own map<string,string>")
    got = {}
    for r in a.intents(df, "k", "q", F.col("has"), F.col("own")).collect():
        got.setdefault(r.k, {})[r.intent] = r.hits
    for k, q, has, mine in rows:
        table = a.INTENTS | (mine or {})
        said = [i for w, i in table.items() if w in (q or "").lower()]
        want = set(said)
        if "outlook" in want:
            want |= {"technical", "fundamental", "macro"} if has else {"market", "macro"}
        if has and not want & {"technical", "fundamental"}:
            want |= {"technical", "fundamental"}
        if not has and not want:
            want = {"market"}
        assert got[k] == {i: said.count(i) for i in want}, (k, q)
