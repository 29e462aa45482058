"""The tests of a thesis over a caller's prices, and the same drift test over other baskets."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.plans.compose import apply


def thesis(spark: SparkSession, frames: Mapping[str, DataFrame], others: Mapping[str, Mapping[str, DataFrame]] | None = None, least: int = 252) -> DataFrame:
    """test, n, figure, survived. frames: bars and orders, or any relations in their place; others: the same for other baskets by label; survived is null below least rows."""
    rows = [apply(spark, "thesis_tests", dict(frames), least=least)]
    for label, given in (others or {}).items():
        drift = apply(spark, "block_bootstrap", dict(given)).agg(F.max("n").alias("n"), F.max("p").alias("p"))
        rows.append(drift.select(F.lit(f"T8 {label}").alias("test"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.col("p").alias("figure"), F.when(F.col("n") >= least, F.col("p") < 0.05).alias("survived")))
    return reduce(DataFrame.unionByName, rows)
