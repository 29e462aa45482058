"""Orders of the plain rule for any number of accounts and rounds, as one fold over each round's ranked candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.streaming.paper import Limits


def orders(scored: DataFrame, held: DataFrame, accounts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """account, round, place (null for sales), symbol, side, qty.

    scored: account, round, symbol, score, price, unit, barred, scale; held: account, round, symbol, qty;
    accounts: account, round, equity, cash. What is held and scores leave or less is sold. The best of the
    rest that score buy or more, by score, then symbol, are bought while slots and cash last: what a stop may
    lose, a position may weigh and the cash left buys, the least of them times the scale. A null score is 0,
    a null or non-positive unit a share of the price, a null scale 1; without a price or with no equity
    nothing is bought. The fold carries what is left of cash and slots; a round's candidates are one group.
    """
    key = ["account", "round", "symbol"]
    quoted = F.col("_quoted").isNotNull()
    both = held.select(*key, F.col("qty").alias("_held")).join(scored.withColumn("_quoted", F.lit(True)), key, "full").withColumn("score", F.coalesce("score", F.lit(0.0)))
    sold = (F.col("_held").isNotNull() & (F.col("_held") != 0) & quoted & (F.col("score") <= limits.leave)).alias("sold")
    each = both.withColumn("sold", F.coalesce(sold, F.lit(False))).withColumn("stays", F.col("_held").isNotNull() & ~F.col("sold"))
    able = quoted & ~F.col("stays") & ~F.coalesce("barred", F.lit(False)) & (F.col("score") >= limits.buy) & (F.col("price") > 0)
    unit = F.when(F.col("unit") > 0, F.col("unit")).otherwise(F.col("price") * limits.unit)
    scale = F.when(F.isnan("scale"), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("scale", F.lit(1.0)))))
    item = F.struct((-F.col("score")).alias("rank"), "symbol", "price", unit.alias("unit"), scale.alias("scale"))
    round_ = each.groupBy("account", "round").agg(
        F.count_if("stays").alias("stay"),
        F.array_sort(F.collect_list(F.when(able, item))).alias("wanted"),
        F.collect_list(F.when(F.col("sold"), F.struct("symbol", F.abs("_held").cast("double").alias("qty")))).alias("gone"),
    )
    fold = f"""aggregate(wanted, named_struct('cash', cast(cash as double), 'room', if(equity > 0, {limits.slots} - stay, 0L), 'got', cast(array() as array<struct<symbol:string,qty:double>>)),
        (a, x) -> element_at(transform(array(cast(if(a.room > 0, greatest(0D, least(equity * {limits.risk}D / x.unit, equity * {limits.position}D / x.price, a.cash / x.price)) * x.scale, 0D) as long)),
          q -> if(q >= 1, named_struct('cash', a.cash - q * x.price, 'room', a.room - 1L, 'got', array_append(a.got, named_struct('symbol', x.symbol, 'qty', cast(q as double)))), a)), 1), a -> a.got)"""
    done = round_.join(accounts, ["account", "round"]).select("account", "round", "gone", F.expr(fold).alias("got"))
    sales = done.select("account", "round", F.lit(None).cast("int").alias("place"), F.inline("gone")).withColumn("side", F.lit("sell"))
    buys = done.select("account", "round", F.posexplode("got").alias("place", "g")).select("account", "round", "place", "g.symbol", "g.qty", F.lit("buy").alias("side"))
    return sales.unionByName(buys).select("account", "round", "place", "symbol", "side", "qty")
