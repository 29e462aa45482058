"""Documents of state that come back whatever was written, and versions of a table of which readers see whole ones only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a document has where it has nothing usable. Fixed values; thresholds are JSON.
THRESHOLDS = {"rsi_oversold": "35.0", "rsi_overbought": "68.0", "price_change_pct": "3.0", "vol_spike_ratio": "2.0", "cooldown_hours": "6.0", "macd_enabled": "true"}
WATCHLIST = ["SPY", "QQQ"]
OFFSET = r'"last_update_id"\s*:\s*(\d+)'
KEEP_DAYS = 35
CACHES = {"fund_cache": "date", "earnings_cache": "checked"}


def overridden(base: dict[str, str], given: Column) -> Column:
    """The map base with the entries of the map given in place of its own, and added to them; base alone if given is null."""
    known = F.create_map(*[F.lit(x) for pair in base.items() for x in pair])
    left = F.map_filter(known, lambda k, _: ~F.coalesce(F.map_contains_key(given, k), F.lit(False)))
    return F.when(given.isNull(), known).otherwise(F.map_concat(left, given))


def _kind(v: Column) -> Column:
    """OBJECT, ARRAY, STRING, BIGINT, ... of a variant; null for none and for JSON's null."""
    return F.nullif(F.regexp_extract(F.schema_of_variant(v), "^([A-Z]+)", 1), F.lit("VOID"))


def _part(v: Column, name: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", kind)


def repaired(docs: DataFrame, key: str, text: str, watchlist: list[str] | None = None, thresholds: dict[str, str] | None = None) -> DataFrame:
    """key, watchlist, thresholds, signal_history, fund_cache, earnings_cache, last_update_id, problem, corrupt of each document.

    A text that is no JSON object (problem broken, its text in corrupt) or null (problem missing) gives the
    defaults. A watchlist that is no list, thresholds, a history or caches that are no objects are replaced, an
    empty list stays, thresholds that lack keys get them; values are JSON. last_update_id is a whole number, or
    a text of digits; null, false, 0 and what is empty are 0; anything else, and any broken text, takes the
    first number that follows the name in the text, or 0. A text that repeats a key counts as broken.
    """
    v = F.try_parse_json(F.col(text))
    whole = F.coalesce(_kind(v) == "OBJECT", F.lit(False))
    plain = lambda m: F.transform_values(m, lambda _, x: F.to_json(x))
    of = lambda name: plain(_part(v, name, "map<string,variant>"))
    none = F.create_map().cast("map<string,string>")
    found = F.coalesce(F.expr(f"try_cast(nullif(regexp_extract(`{text}`, r'{OFFSET}', 1), '') AS BIGINT)"), F.lit(0).cast("long"))
    offset, kind = _part(v, "last_update_id", "variant"), _kind(_part(v, "last_update_id", "variant"))
    digits = F.trim(F.try_variant_get(offset, "$", "string"))
    empty = kind.isNull() | (kind == "STRING") & (F.length(F.try_variant_get(offset, "$", "string")) == 0) | F.to_json(offset).isin("[]", "{}")
    number = (
        F.when(empty, F.lit(0))
        .when(kind == "BOOLEAN", F.try_variant_get(offset, "$", "boolean").cast("int"))
        .when(kind.isin("BIGINT", "DECIMAL", "DOUBLE"), F.try_variant_get(offset, "$", "double").cast("long"))
        .when((kind == "STRING") & digits.rlike(r"^[+-]?[0-9]+$"), F.expr("0L") + digits.try_cast("long"))
    )
    listed = F.transform(_part(v, "watchlist", "array<variant>"), lambda x: F.try_variant_get(x, "$", "string"))
    return docs.select(
        key,
        F.when(whole & listed.isNotNull(), listed).otherwise(F.array(*map(F.lit, watchlist or WATCHLIST))).alias("watchlist"),
        F.when(whole, overridden(thresholds or THRESHOLDS, of("thresholds"))).otherwise(overridden(thresholds or THRESHOLDS, F.lit(None).cast("map<string,string>"))).alias("thresholds"),
        F.coalesce(F.when(whole, of("signal_history")), none).alias("signal_history"),
        *[F.coalesce(F.when(whole, of(c)), none).alias(c) for c in CACHES],
        F.when(whole, F.coalesce(number.cast("long"), found)).otherwise(found).alias("last_update_id"),
        F.when(F.col(text).isNull(), F.lit("missing")).when(~whole, F.lit("broken")).alias("problem"),
        F.when(~whole, F.col(text)).alias("corrupt"),
    )


def pruned(states: DataFrame, today: Column, days: int = KEEP_DAYS) -> DataFrame:
    """states without the entries of its caches that are no objects, or older than so many days before today."""
    first = F.date_sub(today, days).cast("string")
    fresh = lambda at: lambda _, x: F.coalesce(F.get_json_object(x, f"$.{at}") >= first, F.lit(False))
    return states.withColumns({cache: F.map_filter(cache, fresh(at)) for cache, at in CACHES.items()})


class Versions:
    """A table in a folder as versions. A version is its files, then one manifest that names them and appears at once.

    A write that ends early leaves files that no manifest names: readers stay with the last version. Two
    writers of one version can't both succeed: the second finds its manifest there.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        """The versions that are there, in order."""
        at = self._path("manifests")
        return sorted(int(f.getPath().getName()) for f in self.fs.listStatus(at) if f.getPath().getName().isdigit()) if self.fs.exists(at) else []

    def save(self, df: DataFrame) -> int:
        """Write df as the next version and return its number."""
        n, name = (self.numbers() or [0])[-1] + 1, f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.folder}/{name}")
        draft = self._path(f"manifests/.{uuid.uuid4().hex}")
        self.fs.mkdirs(draft.getParent())
        out = self.fs.create(draft, False)
        out.write(bytearray(name.encode()))
        out.close()
        final = self._path(f"manifests/{n:012d}")
        if self.fs.exists(final) or not self.fs.rename(draft, final):
            self.fs.delete(draft, False)
            raise RuntimeError(f"version {n} of {self.folder} was written by another")
        return n

    def load(self, n: int | None = None) -> DataFrame | None:
        """Version n, or the last one; None if there is none."""
        n = n or (self.numbers() or [0])[-1]
        if not n:
            return None
        name = self.spark.read.text(str(self._path(f"manifests/{n:012d}").toString())).first()[0]
        return self.spark.read.parquet(f"{self.folder}/{name}")
