"""What written answers say: tagged lines, votes, confidence, news tags, what a question asks for.

Answers come in English or in Chinese; each field has its words in both, and one name. Where a text names a
field more than once the last one counts, as answers discuss before they conclude.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.sources.state import overridden

# The words of each field, and what each stands for.
FIELDS = {"verdict": ("結論", "verdict"), "confidence": ("信心", "confidence"), "direction": ("方向", "direction"), "risk": ("風控意見", "risk opinion"), "rating": ("評級", "rating")}
WORDS = {
    "verdict": {"買進": "buy", "觀望": "wait", "迴避": "avoid", "buy": "buy", "wait": "wait", "avoid": "avoid"},
    "confidence": {"低": "low", "中": "medium", "高": "high", "low": "low", "medium": "medium", "high": "high"},
    "direction": {"做多": "long", "觀望": "wait", "迴避": "avoid", "long": "long", "wait": "wait", "avoid": "avoid"},
    "risk": {"有條件放行": "conditional", "放行": "pass", "否決": "veto", "conditional": "conditional", "pass": "pass", "veto": "veto"},
    "rating": {"加碼": "add", "中性": "neutral", "減碼": "reduce", "add": "add", "neutral": "neutral", "reduce": "reduce"},
}
TAGS = {"利多": "good", "利空": "bad", "中性": "neutral", "good": "good", "bad": "bad", "neutral": "neutral"}
DEADBAND, REASON = 0.2, 40
#: What a question may ask for, and how much each word says of it.
INTENTS = {
    "chart": "technical", "rsi": "technical", "macd": "technical", "trend": "technical", "技術": "technical", "均線": "technical",
    "earnings": "fundamental", "valuation": "fundamental", "margin": "fundamental", "財報": "fundamental", "本益比": "fundamental",
    "inflation": "macro", "rates": "macro", "gdp": "macro", "總經": "macro", "利率": "macro",
    "market": "market", "index": "market", "大盤": "market",
    "risk": "risk", "volatility": "risk", "drawdown": "risk", "風險": "risk",
    "outlook": "outlook", "prospect": "outlook", "future": "outlook", "看多": "outlook", "看空": "outlook",
}


def _longest_first(words: dict[str, str]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


def _named(word: Column, words: dict[str, str]) -> Column:
    """What a word stands for."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), F.lower(word))


def _last(text: Column, pattern: str, group: int = 1) -> Column:
    return F.try_element_at(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(group)), F.lit(-1))


def field(text: Column, name: str) -> Column:
    """The last value of a field (verdict, confidence, direction, risk, rating) in a text; null if there is none."""
    return _named(_last(text, rf"(?i)(?:{'|'.join(FIELDS[name])})\s*[:：]\s*({_longest_first(WORDS[name])})"), WORDS[name])


def horizon(text: Column) -> Column:
    """The last time frame, up to 20 characters of its line."""
    return F.trim(_last(text, r"(?i)(?:時間框架|horizon)\s*[:：]\s*([^\n」]{1,20})"))


def stance(text: Column) -> Column:
    """The first stance, a number, held between -1 and 1."""
    n = F.nullif(F.regexp_extract(F.coalesce(text, F.lit("")), r"(?i)(?:立場|stance)\s*[:：]\s*([+-]?[0-9]+(?:\.[0-9]+)?)", 1), F.lit("")).try_cast("double")
    return F.when(n.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), n)))


def verdicts(answers: DataFrame, key: str, text: str, symbols: DataFrame) -> DataFrame:
    """key, symbol, verdict: the last verdict of each symbol of symbols (key, symbol) in the text of its key, null if it has none.

    A line's tag is the symbol itself: the lines of a text are found once and joined to the symbols by name.
    """
    line = r"(?i)([A-Z0-9.\-]+)\s*[:：]\s*(" + _longest_first(WORDS["verdict"]) + ")"
    t = F.coalesce(F.col(text), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all(t, F.lit(line), F.lit(1)).alias("s"), F.regexp_extract_all(t, F.lit(line), F.lit(2)).alias("v"))
    lines = answers.select(F.col(key).alias("_key"), F.posexplode(pairs).alias("_at", "p")).groupBy("_key", F.upper("p.s").alias("_symbol")).agg(F.max_by("p.v", "_at").alias("_v"))
    joined = symbols.join(lines, (F.col(key) == F.col("_key")) & (F.upper("symbol") == F.col("_symbol")), "left")
    return joined.select(key, "symbol", _named(F.col("_v"), WORDS["verdict"]).alias("verdict"))


def top_pick(text: Column) -> Column:
    """The last pick that a text names; null for none."""
    p = _last(text, r"(?i)(?:首選|top pick)\s*[:：]\s*([A-Z0-9.\-]+|無)")
    return F.when(~F.lower(p).isin("無", "none"), F.upper(p))


def tagged_news(answers: DataFrame, key: str, text: str, n: str) -> DataFrame:
    """key, i (from 0), tag, reason (40 characters) of each line 'number. [tag] reason' whose number is one of the n headlines; others are skipped."""
    line = r"(?i)([0-9]+)\s*[.、]\s*[\[【（(]?(" + "|".join(TAGS) + r")[\]】）)]?[^\S\n]*([^\n]*)"
    t = F.coalesce(F.col(text), F.lit(""))
    parts = F.arrays_zip(*[F.regexp_extract_all(t, F.lit(line), F.lit(g)).alias(a) for g, a in ((1, "i"), (2, "tag"), (3, "reason"))])
    each = answers.select(key, F.col(n).alias("_n"), F.posexplode(parts).alias("_at", "p")).withColumn("i", F.col("p.i").try_cast("long") - 1)
    return each.where("i >= 0 and i < _n").select(key, "i", _named(F.col("p.tag"), TAGS).alias("tag"), F.substring(F.trim("p.reason"), 1, REASON).alias("reason"))


def agreement(verdict: Column, score: Column, deadband: float = DEADBAND) -> Column:
    """same, opposite or partly: a verdict's direction against that of a score, which is none within the deadband; null if one is missing."""
    v = _named(verdict, {"buy": "1", "wait": "0", "avoid": "-1"}).cast("int")
    q = F.when(score > deadband, 1).when(score < -deadband, -1).when(score.isNotNull(), 0)
    return F.when(v == q, "same").when(v * q < 0, "opposite").when(v.isNotNull() & q.isNotNull(), "partly")


def intents(questions: DataFrame, key: str, text: str, has_symbol: Column, own: Column | None = None) -> DataFrame:
    """key, intent, hits: what each question asks for. own: a map of words to intents in place of known ones, or added.

    A word counts wherever it stands in the text. An outlook asks for the technical, fundamental and macro
    side of a symbol, or else for the market and macro; a symbol without either of the first two for both; a
    question without anything for the market. hits is 0 for what is only implied.
    """
    table = overridden(INTENTS, own if own is not None else F.lit(None).cast("map<string,string>"))
    said = F.filter(F.map_entries(table), lambda e: F.contains(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lower(e["key"])))
    found = questions.select(key, has_symbol.alias("_has"), F.transform(said, lambda e: e["value"]).alias("_said"))
    names = F.array_distinct("_said")
    out = F.when(F.array_contains(names, "outlook"), F.when(F.col("_has"), F.array(*map(F.lit, ("technical", "fundamental", "macro")))).otherwise(F.array(F.lit("market"), F.lit("macro")))).otherwise(F.array().cast("array<string>"))
    both = F.array_union(names, out)
    side = F.array(F.lit("technical"), F.lit("fundamental"))
    more = F.when(F.col("_has") & ~F.arrays_overlap(both, side), F.array_union(both, side)).when(~F.col("_has") & (F.size(both) == 0), F.array(F.lit("market"))).otherwise(both)
    each = found.select(key, "_said", F.explode(more).alias("intent"))
    return each.select(key, "intent", F.size(F.filter("_said", lambda x: x == F.col("intent"))).alias("hits"))
