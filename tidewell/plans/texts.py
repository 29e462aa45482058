"""Queries over documents of state and over written answers, made up from the tables where these have none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell import registry
from tidewell.sources import answers, state


def _raw_state(concat: str) -> str:
    """SQL of a user's document as text from n (events) and top (latest type): fine, cut, and wrong in several ways by user."""
    fine = f"""'{{"watchlist": ["' || top || '", "SPY"], "thresholds": {{"rsi_oversold": ' || n || '}}, "signal_history": {{"' || top || '": "seen"}}, "last_update_id": ' || last_ || '}}'"""
    return f"""CASE user_id % 9 WHEN 0 THEN {fine} WHEN 1 THEN substr({fine}, 1, 30) WHEN 2 THEN '{{"watchlist": null, "last_update_id": ' || last_ || '}}'
    WHEN 3 THEN '{{"thresholds": [1], "last_update_id": "' || last_ || '"}}' WHEN 4 THEN '{{"last_update_id": "' || last_ || 'x"}}' WHEN 5 THEN '[{{"last_update_id": ' || last_ || '}}, '
    WHEN 6 THEN '{{"watchlist": [], "signal_history": "x", "last_update_id": null}}' WHEN 7 THEN '' END"""


@registry.query(
    "state_repair",
    lambda: f"""WITH e AS (SELECT user_id, count(*) AS n, max(event_id) AS last_, arg_max(event_type, event_id) AS top FROM events GROUP BY user_id),
d AS (SELECT user_id, n, last_, top, {_raw_state('||')} AS raw FROM e), k AS (SELECT *, user_id % 9 AS w FROM d)
SELECT user_id, CASE WHEN w = 0 THEN top || ',SPY' WHEN w = 6 THEN '' ELSE 'SPY,QQQ' END AS watchlist, CASE WHEN w = 0 THEN CAST(n AS VARCHAR) ELSE '35.0' END AS rsi_oversold, 6 AS thresholds,
  CASE WHEN w = 0 THEN 1 ELSE 0 END AS seen, CASE WHEN w IN (0, 2, 3, 5) THEN last_ WHEN w = 4 THEN 0 ELSE 0 END AS last_update_id, CASE WHEN w IN (1, 5, 7) THEN 'broken' WHEN w = 8 THEN 'missing' END AS problem, CASE WHEN w IN (1, 5, 7) THEN raw END AS corrupt FROM k""",
)
def state_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-47: each user's document of state as it comes back, whatever was written."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_"), F.max_by("event_type", "event_id").alias("top"))
    docs = state.repaired(e.select("user_id", F.expr(_raw_state("||")).alias("raw")), "user_id", "raw")
    return docs.select(
        "user_id", F.array_join("watchlist", ",").alias("watchlist"), F.element_at("thresholds", "rsi_oversold").alias("rsi_oversold"), F.size("thresholds").alias("thresholds"),
        F.size("signal_history").alias("seen"), "last_update_id", "problem", "corrupt",
    )


def _lexicon() -> str:
    return ", ".join(f"('{w}', '{i}')" for w, i in answers.INTENTS.items())


@registry.query(
    "question_intents",
    lambda: f"""WITH q AS (SELECT conv_id, turn, lower(coalesce(text, '')) AS t, regexp_matches(coalesce(text, ''), '(^|[^A-Za-z])[A-Z]{{2,5}}($|[^A-Za-z])') AS has FROM conversations),
s AS (SELECT conv_id, turn, intent, count(*) AS hits FROM q JOIN (VALUES {_lexicon()}) AS l(word, intent) ON contains(t, word) GROUP BY conv_id, turn, intent),
o AS (SELECT q.conv_id, q.turn, has, unnest(CASE WHEN has THEN ['technical', 'fundamental', 'macro'] ELSE ['market', 'macro'] END) AS intent FROM q JOIN s ON s.conv_id = q.conv_id AND s.turn = q.turn AND s.intent = 'outlook'),
b AS (SELECT conv_id, turn, intent FROM s UNION SELECT conv_id, turn, intent FROM o),
f AS (SELECT conv_id, turn, unnest(CASE WHEN has AND NOT EXISTS (SELECT 1 FROM b WHERE b.conv_id = q.conv_id AND b.turn = q.turn AND b.intent IN ('technical', 'fundamental')) THEN ['technical', 'fundamental'] WHEN NOT has AND NOT EXISTS (SELECT 1 FROM b WHERE b.conv_id = q.conv_id AND b.turn = q.turn) THEN ['market'] ELSE [] END) AS intent FROM q),
a AS (SELECT * FROM b UNION SELECT * FROM f)
SELECT a.intent, count(*) AS texts, CAST(sum(coalesce(s.hits, 0)) AS BIGINT) AS hits FROM a LEFT JOIN s ON s.conv_id = a.conv_id AND s.turn = a.turn AND s.intent = a.intent GROUP BY a.intent""",
)
def question_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.8 keyword counts: what the texts of all conversations ask for, and how many words say so."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.struct("conv_id", "turn").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = answers.intents(c, "id", "text", F.col("text").rlike("(^|[^A-Za-z])[A-Z]{2,5}($|[^A-Za-z])"))
    return found.groupBy("intent").agg(F.count("*").alias("texts"), F.sum("hits").cast("long").alias("hits"))


@registry.query(
    "committee_votes",
    lambda: """WITH v AS (SELECT CAST(o_custkey % 25 AS BIGINT) AS symbol, CASE o_orderstatus WHEN 'F' THEN 'avoid' WHEN 'O' THEN 'buy' ELSE 'wait' END AS verdict, CASE WHEN o_orderkey % 4 = 0 THEN NULL WHEN o_orderkey % 2 = 0 THEN 'high' ELSE 'low' END AS confidence, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE least(1e0, greatest(-1e0, (o_orderkey % 31 - 15) / 10e0)) END AS stance FROM orders)
SELECT symbol, verdict, count(*) AS n, count(confidence) FILTER (confidence = 'high') AS high, round(avg(stance), 6) AS stance, count(*) FILTER (CASE verdict WHEN 'buy' THEN 1 WHEN 'avoid' THEN -1 ELSE 0 END = CASE WHEN stance > 0.2 THEN 1 WHEN stance < -0.2 THEN -1 WHEN stance IS NOT NULL THEN 0 END) AS same FROM v GROUP BY symbol, verdict""",
)
def committee_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """2.8 regex and conditional: verdict, confidence and stance read from answers that are made up from orders, and how often verdict and stance agree."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    word = F.when(F.col("o_orderstatus") == "F", "迴避").when(F.col("o_orderstatus") == "O", "買進").otherwise("觀望")
    stance = F.when(F.col("o_orderkey") % 5 == 0, "none").otherwise(F.concat(F.lit("立場: "), F.format_string("%.1f", (F.col("o_orderkey") % 31 - 15) / F.lit(10.0))))
    sure = F.when(F.col("o_orderkey") % 4 == 0, "").when(F.col("o_orderkey") % 2 == 0, "信心：高").otherwise("Confidence: low")
    t = o.select((F.col("o_custkey") % 25).cast("long").alias("symbol"), F.concat_ws("\n", F.lit("If it falls, 結論: 觀望."), F.col("o_orderpriority"), stance, F.concat(F.lit("結論："), word), sure).alias("t"))
    text = F.col("t")
    read = t.select("symbol", answers.field(text, "verdict").alias("verdict"), answers.field(text, "confidence").alias("confidence"), answers.stance(text).alias("stance"))
    same = answers.agreement(F.col("verdict"), F.col("stance")) == "same"
    return read.groupBy("symbol", "verdict").agg(F.count("*").alias("n"), F.count_if(F.col("confidence") == "high").alias("high"), F.round(F.avg("stance"), 6).alias("stance"), F.count_if(same).alias("same"))
