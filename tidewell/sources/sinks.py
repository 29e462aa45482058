"""Sinks: CSV exports and append-only tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter


def to_csv(df: DataFrame, path: str) -> None:
    """SNK-02: df as CSV files with a header, one for each partition; quotes in quoted values are doubled."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append(df: DataFrame, path: str) -> None:
    """SRC-49: rows added to a table; the view journal_tail keeps the last ones."""
    df.write.mode("append").parquet(path)


def push(alerts: DataFrame, send: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """SNK-04: a stream of alerts given to send batch by batch. A batch that failed comes again with its number, by which send can know it."""
    return alerts.writeStream.foreachBatch(send).option("checkpointLocation", checkpoint)
