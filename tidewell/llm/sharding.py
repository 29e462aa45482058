"""Placement of documents on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import packed, read

#: A prime, so that every skip visits all slots; and the number of shards of the query.
TABLE_SIZE, SHARDS = 65_537, 64


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of its shard: shards in turn claim the next free slot of their own permutation.

    Slots differ by one at most from shard to shard, and few change their shard when one comes or goes.
    """
    if not shards or len(shards) > size or len(set(shards)) < len(shards):
        raise ValueError("between 1 and size distinct shards are needed")
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the size of the table must be prime")
    at, skip = [], []
    for name in shards:
        digest = hashlib.md5(name.encode()).hexdigest()
        at.append(int(digest[:15], 16) % size)
        skip.append(int(digest[15:30], 16) % (size - 1) + 1)
    table, free = [-1] * size, size
    while free:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % size
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def names(n: int) -> list[str]:
    return [f"shard-{k:05d}" for k in range(n)]


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of its MD5, so that other engines can compute it too."""
    return (F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(docs: DataFrame, shards: int = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """docs with slot and shard. The table of size slots is broadcast: its bound is size, whatever the rows.

    A row without doc_id is placed by its text, one without either by the empty text. Rows that repeat a
    doc_id get the same shard. Columns named slot and shard are replaced.
    """
    spark = docs.sparkSession
    table = ",".join(map(str, lookup_table(names(shards), size)))
    slots = spark.range(1).select(F.posexplode(F.split(F.lit(table), ",")).alias("slot", "shard")).select("slot", F.col("shard").cast("int"))
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), "text"), F.lit("text "))
    placed = packed(docs, slot_of(key, size).alias("slot")).join(F.broadcast(slots), "slot")
    return placed.select(*[f"row.`{c}`" for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, slot, shard of every document."""
    return place(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "slot", "shard")


def op10_sql() -> str:
    table = ",".join(map(str, lookup_table(names(SHARDS))))
    return f"""
WITH placed AS (
  SELECT doc_id, CAST(CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) % {TABLE_SIZE} AS INTEGER) AS slot
  FROM documents
), slots AS (
  SELECT CAST(unnest(range(0, {TABLE_SIZE})) AS INTEGER) AS slot, CAST(unnest(string_split('{table}', ',')) AS INTEGER) AS shard
)
SELECT p.doc_id, p.slot, s.shard FROM placed p JOIN slots s ON s.slot = p.slot
"""
