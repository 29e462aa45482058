"""Stateful alerts over streams, and the same over batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SENT = "symbol string, category string, ts timestamp"


def passed(times: list[pd.Timestamp], last: pd.Timestamp | None, hours: float) -> tuple[list[bool], pd.Timestamp | None]:
    """Which signals, in order of time, go out: none within hours of the last one sent, but all of the same moment."""
    out = []
    for t in times:
        go = last is None or t == last or (t - last).total_seconds() >= hours * 3600
        last = t if go else last
        out.append(go)
    return out, last


def cooldown(signals: DataFrame, hours: float = 24) -> DataFrame:
    """The signals (symbol, category, ts) that go out, measured from the last one sent, by symbol and category.

    Rows are dealt out by key, sorted, and met in batches: a task holds a batch and the time of the last one sent.
    """
    quiet = round(hours * 3_600_000_000)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, started, last = None, False, None
        for b in batches:
            out = []
            for *now, at in zip(*(c.to_pylist() for c in (b.column("symbol"), b.column("category"), b.column("at")))):
                if now != key:
                    key, started, last = now, False, None
                go = not started or at is not None and last is not None and (at == last or at - last >= quiet)
                started, last = True, at if go else last
                out.append(go)
            yield b.filter(pa.array(out, pa.bool_())).select(["symbol", "category", "ts"])

    rows = signals.select("symbol", "category", F.col("ts").cast("timestamp").alias("ts")).withColumn("at", F.unix_micros("ts"))
    return rows.repartition("symbol", "category").sortWithinPartitions("symbol", "category", F.asc_nulls_last("at")).mapInArrow(fold, SENT)


def cooldown_stream(signals: DataFrame, hours: float = 24) -> DataFrame:
    """cooldown() over a stream. The time of the last one sent is the state; it expires a week of quiet later."""

    def fold(key: tuple, batches: Iterable[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches)).sort_values("ts")
        last = pd.Timestamp(state.get[0], unit="us") if state.exists else None
        go, last = passed(list(pdf["ts"]), last, hours)
        state.update((int(last.value // 1000),))
        state.setTimeoutDuration(7 * 24 * 3600 * 1000)
        yield pdf[go][["symbol", "category", "ts"]]

    signals = signals.select("symbol", "category", F.col("ts").cast("timestamp").alias("ts"))
    return signals.groupBy("symbol", "category").applyInPandasWithState(fold, SENT, "last long", "append", "ProcessingTimeTimeout")


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tumbling windows of an hour by type of event; over a stream those that closed, with a watermark."""
    at = events.select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value").withWatermark("ts", late)
    return at.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("ts"), F.col("event_type").alias("symbol"), "n", "total")


def first_breaches(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Events (a stream or not) at or past the level of an alert (symbol, op, level: a static table) on their type."""
    on = (F.col("event_type") == F.col("symbol")) & F.when(F.col("op") == "ge", F.col("value") >= F.col("level")).otherwise(F.col("value") <= F.col("level"))
    return events.join(alerts.where("level is not null"), on).select("symbol", "op", "level", "event_id", "ts", "value")
