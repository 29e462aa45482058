"""Mixing of sources to target weights by Pfair scheduling.

The rows of a source form blocks. With weight w, block j is released at slot floor(j / w) and due at
slot ceil((j + 1) / w); each slot goes to the released block with the earliest deadline. All windows are
met as the weights sum to 1, so at any slot a source is within one block of its share. Weights are taken as
the exact fractions they are, and so as whole numbers; their sum is a period, after which the schedule
repeats: a block's slot follows from a table of one period, however many slots there are in all.
"""

from __future__ import annotations

import heapq
import json
import math
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.llm.common import cut, packed, read

#: Rows of a block, and the power of a source's rows that is, as a whole number, its default weight.
BLOCK_ROWS, POWER = 20, 0.5
NO_SOURCE = "(none)"
#: Slots of a period at most. Whole weights with a greater sum are rounded to shares of so many slots.
MOST_SLOTS = 200_000


def shares(weights: dict[str, float], period: int) -> dict[str, int]:
    """Whole shares of the period by largest remainder; a source that would have none gets one from the largest."""
    if len(weights) > period:
        raise ValueError("the period must have a slot for each source")
    total = sum(map(Fraction, weights.values()))
    exact = {s: Fraction(w) * period / total for s, w in weights.items()}
    out = {s: math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (out[s] - exact[s], s))[: period - sum(out.values())]:
        out[s] += 1
    none = [s for s in sorted(out) if not out[s]]
    for s in none:
        out[s] += 1
    large = [(-k, s) for s, k in out.items()]
    heapq.heapify(large)
    for _ in none:
        k, s = heapq.heapreplace(large, (large[0][0] + 1, large[0][1]))
        out[s] = -k - 1
    return out


def whole(weights: dict[str, float], most: int = MOST_SLOTS) -> dict[str, int]:
    """The weights as the least whole numbers in the same proportions, exactly, if their sum is at most most.

    A weight is the decimal that it is written as. Beyond most slots shares are rounded, each by less than
    a slot of most, which the sources must not outnumber.
    """
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    scale = math.lcm(*[x.denominator for x in exact.values()])
    ints = {s: int(x * scale) for s, x in exact.items()}
    common = math.gcd(*ints.values())
    ints = {s: k // common for s, k in ints.items()}
    return ints if sum(ints.values()) <= most else shares(ints, most)


def default_weights(rows: dict[str, int], power: float = POWER) -> dict[str, float]:
    """The power of each source's rows, as a whole number from 1 on."""
    return {s: max(1, round(n**power)) for s, n in rows.items()}


def schedule(share: dict[str, int]) -> list[tuple[str, int, int]]:
    """source, block, slot for one period: earliest deadline first among the released blocks."""
    period = sum(share.values())
    waiting = [(0, s, 0) for s in sorted(share)]
    ready: list[tuple[int, str, int]] = []
    out = []
    for slot in range(period):
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-((j + 1) * -period // share[s]), s, j))
        _, s, j = heapq.heappop(ready)
        out.append((s, j, slot))
        heapq.heappush(waiting, ((j + 1) * period // share[s], s, j + 1))
    return out


def _ranked(docs: DataFrame, *more: Column) -> DataFrame:
    """doc_id, source, md5, rank of each row within its source in the order of md5, doc_id; and more columns.

    Rows are numbered within each of 4,096 ranges of md5, and the ranges' counts are added up: no task
    holds a whole source.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), "text"), F.lit("text "))
    slim = docs.select("doc_id", F.coalesce("source", F.lit(NO_SOURCE)).alias("source"), F.md5(key).alias("md5"), *more).withColumn("part", F.substring("md5", 1, 3))
    parts = slim.groupBy("source", "part").agg(F.count("*").alias("n"))
    before = parts.select("source", "part", F.coalesce(F.sum("n").over(W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    at = F.row_number().over(W.partitionBy("source", "part").orderBy("md5", "doc_id"))
    out = slim.withColumn("at", at).join(before, ["source", "part"]).withColumn("rank", F.col("before") + F.col("at") - 1)
    return out.drop("part", "at", "before")


def _placed(ranked: DataFrame, share: dict[str, int], slots: list[tuple[str, int, int]], block_rows: int) -> DataFrame:
    """ranked with block, k (the source's share), at, slot: null where the source has no share."""
    spark, period = ranked.sparkSession, len(slots)
    table = json.dumps([{"source": s, "j": j, "at": slot} for s, j, slot in slots])
    table = spark.range(1).select(F.inline(F.from_json(F.lit(table), "array<struct<source:string,j:long,at:long>>")))
    k = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps([{"source": s, "k": n} for s, n in share.items()])), "array<struct<source:string,k:long>>")))
    blocks = ranked.withColumn("block", F.floor(F.col("rank") / block_rows)).join(F.broadcast(k), "source", "left").withColumn("j", F.expr("block % k"))
    return blocks.join(F.broadcast(table), ["source", "j"], "left").withColumn("slot", F.expr(f"block div k * {period} + at"))


def mix(docs: DataFrame, weights: dict[str, float] | None = None, period: int | None = None, block_rows: int = BLOCK_ROWS, power: float = POWER) -> DataFrame:
    """doc_id, source, md5, block, release, deadline, slot, position, in_mix of each row of docs.

    weights: by source; None: the power of the source's rows, as a whole number. They hold exactly, to within a
    block at every slot, unless a period is given, whose whole shares they are rounded to. A source without
    weight takes no slot (block and what follows it null, in_mix false). in_mix: the slot is before the first
    one whose source has no row left for it, up to which the weights hold. Null sources are a source of their
    own; rows without doc_id are ordered by their text; rows that repeat a doc_id take places one after the
    other. The driver gets one row a source and makes one period.
    """
    spark = docs.sparkSession
    ranked = cut(_ranked(docs))
    rows = {r["source"]: r["n"] for r in ranked.groupBy("source").agg(F.count("*").alias("n")).toLocalIterator()}
    weights = {s: w for s, w in (weights or default_weights(rows, power)).items() if s in rows and w > 0}
    if not weights:
        return ranked.select("doc_id", "source", "md5", *[F.lit(None).cast("long").alias(c) for c in ("block", "release", "deadline", "slot", "position")], F.lit(False).alias("in_mix"))
    share = shares(weights, max(period, 2 * len(weights))) if period else whole(weights)
    period = sum(share.values())
    slots = schedule(share)
    at = {(s, j): slot for s, j, slot in slots}
    empty = {s: -(-rows[s] // block_rows) for s in share}  # the first block without rows
    horizon = min(empty[s] // k * period + at[s, empty[s] % k] for s, k in share.items())
    placed = _placed(ranked, share, slots, block_rows)
    return placed.select(
        "doc_id", "source", "md5",
        F.when(F.col("slot").isNotNull(), F.col("block")).alias("block"),
        F.expr(f"block * {period} div k").alias("release"),
        F.expr(f"((block + 1) * {period} + k - 1) div k").alias("deadline"),
        "slot",
        F.expr(f"slot * {block_rows} + rank % {block_rows}").alias("position"),
        F.coalesce(F.col("slot") < horizon, F.lit(False)).alias("in_mix"),
    )


def keep_mix(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that are in the mix: those of each source up to its last one there, in the order of md5, doc_id.

    The last ones are one row for each source, as many as the period's slots at most, and are broadcast.
    """
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.concat(F.lit("text "), "row.text"), F.lit("text "))
    place = F.struct(F.md5(key).alias("md5"), "row.doc_id")
    last = mix(docs, **how).where("in_mix").groupBy("source").agg(F.max(F.struct("md5", "doc_id")).alias("last"))
    at = packed(docs, F.coalesce("source", F.lit(NO_SOURCE)).alias("source")).join(F.broadcast(last), "source")
    return at.where(place <= F.col("last")).select("row.*")


def in_mix_order(docs: DataFrame, weights: dict[str, float] | None = None, block_rows: int = BLOCK_ROWS, power: float = POWER) -> DataFrame:
    """All rows of docs in the order of the mix: sorted by slot over the partitions.

    A source that runs out leaves the schedule: the slots it would have had stay empty, and the others go on
    in their proportions. Rows of a source without weight come last. weights as in mix(). The driver gets one
    row a source and makes one period.
    """
    rows = {r["source"]: r["n"] for r in docs.groupBy(F.coalesce("source", F.lit(NO_SOURCE)).alias("source")).agg(F.count("*").alias("n")).toLocalIterator()}
    weights = {s: w for s, w in (weights or default_weights(rows, power)).items() if s in rows and w > 0}
    if not weights:
        return docs
    share = whole(weights)
    placed = _placed(_ranked(docs, F.struct(*docs.columns).alias("row")), share, schedule(share), block_rows)
    return placed.orderBy(F.col("slot").asc_nulls_last(), "source", "rank").select("row.*")


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "source", "block", "release", "deadline", "slot", "position", "in_mix")


def op7_sql() -> str:
    """The same by simulation: a recursive query hands out the slots of one period one by one."""
    return f"""
WITH RECURSIVE ranked AS (
  SELECT doc_id, coalesce(source, '{NO_SOURCE}') AS source,
         row_number() OVER (PARTITION BY coalesce(source, '{NO_SOURCE}') ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rnk
  FROM documents
), size AS (
  SELECT source, count(*) AS n, greatest(1, CAST(round(pow(count(*), {POWER})) AS BIGINT)) AS w FROM ranked GROUP BY source
), common AS (
  SELECT list_reduce(list(w), lambda x, y: gcd(x, y)) AS g, sum(w) // list_reduce(list(w), lambda x, y: gcd(x, y)) AS q FROM size
), share AS (
  SELECT source, n, q, w // g AS k FROM size, common
), lists AS (
  SELECT list(k ORDER BY source) AS ks, list(source ORDER BY source) AS names, CAST(max(q) AS BIGINT) AS q FROM share
), edf(slot, taken, pick) AS (
  SELECT CAST(-1 AS BIGINT), [CAST(0 AS BIGINT) FOR k IN ks], CAST(0 AS BIGINT) FROM lists
  UNION ALL
  SELECT slot + 1, [t + CASE WHEN i = best THEN 1 ELSE 0 END FOR t, i IN taken], best
  FROM (
    SELECT slot, taken, q, list_position(due, list_min(due)) AS best
    FROM (
      SELECT slot, taken, q,
             [CASE WHEN (t * q) // ks[i] <= slot + 1 THEN ((t + 1) * q + ks[i] - 1) // ks[i] ELSE 1000000000 END FOR t, i IN taken] AS due
      FROM edf, lists
    )
  ) WHERE slot + 1 < q
), table_ AS (
  SELECT names[pick] AS source, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS j FROM edf, lists WHERE slot >= 0
), ends AS (
  SELECT min((n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} // k * q + t.slot) AS horizon
  FROM share s JOIN table_ t ON t.source = s.source AND t.j = (n + {BLOCK_ROWS - 1}) // {BLOCK_ROWS} % k
), placed AS (
  SELECT r.doc_id, r.source, rnk, rnk // {BLOCK_ROWS} AS block, s.k, s.q, (rnk // {BLOCK_ROWS}) // s.k * s.q + t.slot AS slot
  FROM ranked r JOIN share s ON s.source = r.source JOIN table_ t ON t.source = r.source AND t.j = (rnk // {BLOCK_ROWS}) % s.k
)
SELECT doc_id, source, CAST(block AS BIGINT) AS block, CAST(block * q // k AS BIGINT) AS release,
       CAST(((block + 1) * q + k - 1) // k AS BIGINT) AS deadline, CAST(slot AS BIGINT) AS slot,
       CAST(slot * {BLOCK_ROWS} + rnk % {BLOCK_ROWS} AS BIGINT) AS position, slot < horizon AS in_mix
FROM placed, ends
"""
