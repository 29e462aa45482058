"""One fold over the moments of each key, for a batch and for a stream.

A fold says what a moment's rows do to a key's state, when something is due by itself, and what happens
then. replay() runs it over a table: rows are dealt out by key, sorted, and met in batches, so a task holds
the rows of one moment and a state. follow() runs the same over a stream by transformWithStateInPandas: rows
wait in list state until the watermark has passed their moment, and timers of event time wake the key for
its next moment and for what is due. Whatever the batches of a stream, a key meets its moments in order, so
both give the same rows, but for what comes later than the watermark allows.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import date, timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

DAY = 86_400_000_000  # microseconds
EPOCH = date(1970, 1, 1)
ROWS = 2048


def day_of(at: int) -> date:
    """The day (UTC) of a moment in microseconds."""
    return EPOCH + timedelta(days=at // DAY)


def midnight(day: date) -> int:
    """The moment at which a day begins."""
    return (day - EPOCH).days * DAY


def moment(day: str, hours: int = 0) -> Column:
    """The beginning of a day of UTC, or so many hours later, whatever the session's zone."""
    return F.timestamp_micros(F.unix_date(day).cast("long") * DAY + hours * 3_600_000_000)


class Fold:
    """State is whatever JSON can hold. out: the columns of a result row after those of the key; order: columns that order the rows of a moment."""

    out = ""
    order: tuple[str, ...] = ()

    def start(self) -> dict:
        return {}

    def step(self, state: dict, at: int, rows: list[dict]) -> Iterator[tuple]:
        """Result rows of a moment; state is changed in place."""
        raise NotImplementedError

    def due(self, state: dict) -> int | None:
        """The next moment at which something happens by itself. It comes before the rows of that moment."""
        return None

    def end(self, state: dict, at: int) -> Iterator[tuple]:
        """Result rows of what was due at a moment; due() must then be later."""
        return iter(())

    def finish(self, state: dict) -> Iterator[tuple]:
        """Result rows of a key whose table has no more rows. A stream has no such end."""
        return iter(())


def advance(fold: Fold, state: dict, rows: list[dict], upto: int | None) -> Iterator[tuple]:
    """All that happens by the rows (in order, each with its moment at), then what is due up to a moment."""
    k = 0
    while k < len(rows):
        at = rows[k]["at"]
        while (due := fold.due(state)) is not None and due <= at:
            yield from fold.end(state, due)
        n = k
        while n < len(rows) and rows[n]["at"] == at:
            n += 1
        yield from fold.step(state, at, rows[k:n])
        k = n
    while upto is not None and (due := fold.due(state)) is not None and due <= upto:
        yield from fold.end(state, due)


def _schema(df: DataFrame, keys: list[str], fold: Fold) -> str:
    return ", ".join([*(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys), fold.out])


def _at(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.where(" and ".join([f"`{k}` is not null" for k in keys] + ["ts is not null"])).withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))


def replay(df: DataFrame, keys: list[str], fold: Fold, upto: int | None = None) -> DataFrame:
    """The fold's rows over a table: keys, ts, and what the fold reads. upto: the moment up to which things that are due happen.

    Rows without a key or ts are left out. A key's moments are one task's work, in bounded memory.
    """
    order = list(fold.order)
    rows = _at(df, keys).drop("ts").repartition(*keys).sortWithinPartitions(*keys, "at", *order)
    schema = _schema(df, keys, fold)
    names = [c.split()[0] for c in keys] + [n for n in _names(fold.out)]
    kind = df.sparkSession.createDataFrame([], schema).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, moment, out = None, {}, [], []

        def flush() -> Iterator[tuple]:
            if moment:
                yield from ((*key, *r) for r in advance(fold, state, moment, None))
                moment.clear()

        def close() -> Iterator[tuple]:
            yield from flush()
            if key is not None:
                yield from ((*key, *r) for r in advance(fold, state, [], upto))
                yield from ((*key, *r) for r in fold.finish(state))

        for b in batches:
            for r in b.to_pylist():
                of = tuple(r[k] for k in keys)
                if of != key:
                    out += close()
                    key, state = of, fold.start()
                elif moment and moment[0]["at"] != r["at"]:
                    out += flush()
                moment.append(r)
            if len(out) >= ROWS:
                yield _batch(out, names, kind)
                out = []
        out += close()
        yield _batch(out, names, kind)

    return rows.mapInArrow(run, schema)


def _names(ddl: str) -> list[str]:
    """The names of the columns of a schema: what begins each part outside of brackets."""
    out, depth, word = [], 0, ""
    for c in ddl + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and depth == 0:
            out.append(word.split()[0])
            word = ""
        else:
            word += c
    return out


def _batch(rows: list[tuple], names: list[str], kind: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind.field(k).type) for k in range(len(names))], schema=kind)


class _Follower(StatefulProcessor):
    """Rows wait for the watermark; a timer at each moment and at what is due wakes the key."""

    def __init__(self, fold: Fold, names: list[str]):
        self.fold, self.names = fold, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, row string")
        self.state = handle.getValueState("state", "text string, done long")

    def _wake(self, at: int) -> None:
        self.handle.registerTimer(-(-at // 1000))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf.astype(object).where(pdf.notna(), None)
            found = pdf.drop(columns=["ts"]).to_dict("records")
            self.waiting.appendList([(int(r["at"]), json.dumps(r, default=str)) for r in found])
            for at in {int(r["at"]) for r in found}:
                self._wake(at)
        yield pd.DataFrame(columns=self.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        text, done = self.state.get() if self.state.exists() else (None, None)
        waiting = list(self.waiting.get()) if self.waiting.exists() else []
        now = [json.loads(row) for at, row in waiting if at <= upto and (done is None or at > done)]
        later = [(at, row) for at, row in waiting if at > upto]
        now.sort(key=lambda r: (r["at"], *[(r[c] is not None, r[c]) for c in self.fold.order]))
        state = json.loads(text) if text else self.fold.start()
        out = [(*key, *r) for r in advance(self.fold, state, now, upto)]
        if later:
            self.waiting.put(later)
        else:
            self.waiting.clear()
        self.state.update((json.dumps(state), max(upto, done or upto)))
        if (due := self.fold.due(state)) is not None:
            self._wake(due)
        yield pd.DataFrame(out, columns=self.names)


def follow(df: DataFrame, keys: list[str], fold: Fold, late: str = "0 seconds") -> DataFrame:
    """The fold's rows over a stream of the same columns, appended once the watermark (late behind the latest ts) has passed them.

    State is kept in RocksDB, which transformWithState needs.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = _at(df.withColumn("ts", F.col("ts").cast("timestamp")), keys).withWatermark("ts", late)
    names = [*keys, *_names(fold.out)]
    return rows.groupBy(*keys).transformWithStateInPandas(_Follower(fold, names), _schema(df, keys, fold), "append", "eventTime")
