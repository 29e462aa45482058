"""Parsers of filings, tables and feeds: text columns in, typed columns out, all of them DataFrame expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewell import operators  # noqa: F401  apply() needs them
from tidewell.plans.compose import apply

LEDGER = T.StructType([T.StructField("day", T.DateType()), T.StructField("symbol", T.StringType()), T.StructField("side", T.StringType()), T.StructField("qty", T.DoubleType()), T.StructField("price", T.DoubleType()), T.StructField("fee", T.DoubleType())])


def number(c: Column | str) -> Column:
    """A number with thousands separators or a percent sign; null where it is none."""
    return F.regexp_replace(F.trim(c), "[,%\"]", "").try_cast("double")


def rfc3339(c: Column | str) -> Column:
    return F.try_to_timestamp(F.regexp_replace(F.substring(c, 1, 19), "T", " "))


def option_symbol(c: Column | str) -> Column:
    """root, expiry, right and strike of ROOTyymmddC00012345; null where the name is none."""
    part = lambda k: F.regexp_extract(c, r"^([A-Z]+)(\d{6})([CP])(\d{8})$", k)
    ok = F.col(c) if isinstance(c, str) else c
    return F.when(ok.rlike(r"^[A-Z]+\d{6}[CP]\d{8}$"), F.struct(part(1).alias("root"), F.try_to_date(part(2), "yyMMdd").alias("expiry"), part(3).alias("cp"), (part(4).cast("double") / 1000).alias("strike")))


def short_volume(lines: DataFrame) -> DataFrame:
    """symbol, day, short, total over all markets from lines `value`: Date|Symbol|Short|Exempt|Total|Market; other lines are skipped."""
    p = F.split("value", r"\|")
    rows = lines.where(F.size(p) >= 6).select(F.try_to_date(p[0], "yyyyMMdd").alias("day"), F.upper(F.trim(p[1])).alias("symbol"), number(p[2]).alias("short"), number(p[4]).alias("total"))
    return rows.where("day is not null and short is not null and total > 0").groupBy("symbol", "day").agg(F.sum("short").alias("short"), F.sum("total").alias("total")).withColumn("share", F.col("short") / F.col("total"))


def fails(lines: DataFrame, last: int = 10) -> DataFrame:
    """symbol, day, qty, price of the last rows of each symbol from Date|CUSIP|Symbol|Qty|Name|Price."""
    from pyspark.sql import Window as W

    p = F.split("value", r"\|")
    rows = lines.where(F.size(p) >= 6).select(F.try_to_date(p[0], "yyyyMMdd").alias("day"), F.trim(p[2]).alias("symbol"), number(p[3]).alias("qty"), number(p[5]).alias("price")).where("day is not null and qty is not null")
    return rows.withColumn("k", F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("day")))).where(F.col("k") <= last).drop("k")


def form4(docs: DataFrame) -> DataFrame:
    """owner, day, code, ad, shares, price of the transactions in `xml`; a document without any has none."""
    path = lambda tag: F.expr(f"xpath(xml, '//nonDerivativeTransaction//{tag}/text()')")
    z = F.arrays_zip(path("transactionDate/value").alias("day"), path("transactionCode").alias("code"), path("transactionAcquiredDisposedCode/value").alias("ad"), path("transactionShares/value").alias("shares"), path("transactionPricePerShare/value").alias("price"))
    rows = docs.select(F.expr("xpath_string(xml, '//rptOwnerName')").alias("owner"), F.expr("cast(xpath_number(xml, 'count(//derivativeTransaction)') as int)").alias("derivatives"), F.explode(z).alias("t"))
    return rows.select("owner", "derivatives", F.col("t.day").try_cast("date").alias("day"), "t.code", "t.ad", number(F.col("t.shares")).alias("shares"), number(F.col("t.price")).alias("price"))


def form13f(docs: DataFrame) -> DataFrame:
    """issuer, cusip, value, shares, put_call from `xml`, whatever the prefixes of its tags."""
    plain = docs.select(F.regexp_replace("xml", r"<(/?)[A-Za-z0-9]+:", "<$1").alias("xml"))
    table = plain.select(F.explode(F.regexp_extract_all("xml", F.lit(r"(?s)<infoTable>.*?</infoTable>"), F.lit(0))).alias("x"))
    tag = lambda name: F.expr(f"nullif(xpath_string(x, '//{name}'), '')")
    return table.select(tag("nameOfIssuer").alias("issuer"), tag("cusip").alias("cusip"), number(tag("value")).alias("value"), number(tag("sshPrnamt")).alias("shares"), tag("putCall").alias("put_call"))


def observations(docs: DataFrame) -> DataFrame:
    """series, day, value from JSON `value` with observations; a dot is no value."""
    schema = "series string, observations array<struct<date:string,value:string>>"
    rows = docs.select(F.from_json("value", schema).alias("j")).select("j.series", F.explode("j.observations").alias("o"))
    return rows.select("series", F.col("o.date").try_cast("date").alias("day"), F.col("o.value").try_cast("double").alias("value")).where("day is not null and value is not null")


def by_header(lines: DataFrame, header: list[str], wanted: dict[str, str]) -> DataFrame:
    """Columns of comma-separated `value` whose header starts with a prefix: wanted maps names to prefixes."""
    p = F.split("value", ",(?=(?:[^\"]*\"[^\"]*\")*[^\"]*$)")
    at = {name: next((k for k, h in enumerate(header) if h.strip().startswith(prefix)), None) for name, prefix in wanted.items()}
    text = lambda k: F.trim(F.regexp_replace(F.get(p, F.lit(k)), '"', ""))
    return lines.select(*[(F.lit(None).cast("string") if k is None else text(k)).alias(name) for name, k in at.items()])


def futures(lines: DataFrame, header: list[str], product: str) -> DataFrame:
    """day, identity, net_oi, long_oi, short_oi of a product; the net is long less short where it isn't given."""
    rows = by_header(lines, header, {"day": "date", "product": "product", "who": "identity", "long": "long_oi", "short": "short_oi", "net": "net_oi"})
    who = F.when(F.lower("who").contains("foreign"), "foreign").when(F.lower("who").contains("trust"), "trust").otherwise("dealer")
    return rows.where(F.col("product").contains(product)).select(F.try_to_date("day", "yyyy/MM/dd").alias("day"), who.alias("identity"), F.coalesce(number("net"), number("long") - number("short")).alias("net_oi"), number("long").alias("long_oi"), number("short").alias("short_oi"))


def fear_greed(docs: DataFrame) -> DataFrame:
    """score, rating and a week before from JSON `value`: the first and the eighth of its data."""
    rows = docs.select(F.from_json("value", "data array<struct<value:string,value_classification:string>>").alias("j"))
    at = lambda k: F.get("j.data", F.lit(k))
    return rows.select(at(0)["value"].try_cast("double").alias("score"), at(0)["value_classification"].alias("rating"), at(7)["value"].try_cast("double").alias("week_ago"))


def fear_greed_graph(docs: DataFrame) -> DataFrame:
    """score, rating and the values of the close, week, month and year before from JSON `value` with fear_and_greed; a document without a score has no row."""
    names = {"previous_close": "prev_close", "previous_1_week": "week_ago", "previous_1_month": "month_ago", "previous_1_year": "year_ago"}
    schema = "fear_and_greed struct<score:string,rating:string," + ",".join(f"{n}:string" for n in names) + ">"
    g = docs.select(F.from_json("value", schema).alias("j")).select("j.fear_and_greed.*")
    rows = g.select(F.round(F.col("score").try_cast("double"), 1).alias("score"), F.coalesce("rating", F.lit("")).alias("rating"), *[F.col(n).try_cast("double").alias(a) for n, a in names.items()])
    return rows.where("score is not null")


def fear_greed_lines(files: DataFrame) -> DataFrame:
    """source, score, rating, prev_close, week_ago of the last line of each file: source, n (of the line), value (date,score,rating).

    Lines that begin with no year or have no score are skipped; a week before is five lines before.
    """
    p = F.split(F.regexp_replace("value", "\r", ""), ",")
    at = lambda k: F.trim(F.get(p, F.lit(k)))
    rows = files.select("source", "n", at(0).alias("day"), at(1).try_cast("double").alias("score"), F.coalesce(at(2), F.lit("")).alias("rating")).where(F.col("day").rlike("^[0-9]{4}") & F.col("score").isNotNull())
    w = Window.partitionBy("source").orderBy("n")
    known = rows.select("source", "n", "score", "rating", F.lag("score").over(w).alias("prev_close"), F.lag("score", 5).over(w).alias("week_ago"))
    last = known.groupBy("source").agg(F.max_by(F.struct("score", "rating", "prev_close", "week_ago"), "n").alias("x"))
    return last.select("source", F.round("x.score", 1).alias("score"), "x.rating", "x.prev_close", F.round("x.week_ago", 1).alias("week_ago"))


def statement_row(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """The values of the row whose label fits best: the same without blanks and case before one that contains it, in the order wanted."""
    plain = F.lower(F.regexp_replace("label", r"\s", ""))
    keys = [w.lower().replace(" ", "") for w in wanted]
    rank = F.coalesce(*[F.when(plain == k, n) for n, k in enumerate(keys)], *[F.when(plain.contains(k), len(keys) + n) for n, k in enumerate(keys)])
    fit = rows.withColumn("rank", rank).where("rank is not null")
    return fit.join(fit.agg(F.min(F.struct("rank", "label")).alias("best")), F.struct("rank", "label") == F.col("best")).drop("rank", "best")


def ledger_upload(spark: SparkSession, path: str) -> DataFrame:
    """line, day, symbol, side, qty, price, fee, reject of each row of a file with the columns date, ticker, side, qty, price, fee: what is wrong with a row is told in reject."""
    names = {"date": "day", "ticker": "symbol", "side": "side", "qty": "qty", "price": "price", "fee": "fee"}
    rows = spark.read.csv(path, header=True, enforceSchema=False)
    have = {c.strip().lower(): c for c in rows.columns}
    texts = [F.col(f"`{have[n]}`").cast("string").alias(a) if n in have else F.lit(None).cast("string").alias(a) for n, a in names.items()]
    return apply(spark, "checked_trades", {"raw_trades": rows.select(F.monotonically_increasing_id().alias("line"), *texts)})


def ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=LEDGER, mode="PERMISSIVE")


def holdings_text(lines: DataFrame) -> DataFrame:
    """symbol, qty and mean cost of `value` SYM:qty:cost; rows of less than one share are rejected, doubles merged."""
    p = F.split("value", ":")
    rows = lines.select(F.upper(F.trim(F.get(p, F.lit(0)))).alias("symbol"), F.get(p, F.lit(1)).try_cast("double").alias("qty"), F.get(p, F.lit(2)).try_cast("double").alias("cost")).where("symbol <> '' and qty >= 1 and cost > 0")
    return rows.groupBy("symbol").agg(F.sum("qty").alias("qty"), (F.sum(F.col("qty") * F.col("cost")) / F.sum("qty")).alias("cost"))


def tickers(texts: DataFrame) -> DataFrame:
    """Distinct symbols of two to five capitals in `text` that stand apart from letters, also beside CJK."""
    return texts.select("*", F.array_distinct(F.regexp_extract_all("text", F.lit(r"(?<![A-Za-z0-9])([A-Z]{2,5})(?![A-Za-z0-9])"), F.lit(1))).alias("symbols"))


def last_verdict(c: Column | str) -> Column:
    """The last of BUY, HOLD or SELL that a text names after 'verdict'."""
    return F.try_element_at(F.regexp_extract_all(F.upper(c), F.lit(r"VERDICT\W+(BUY|HOLD|SELL)"), F.lit(1)), F.lit(-1))
