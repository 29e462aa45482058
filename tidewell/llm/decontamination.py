"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over a span of tokens that ignores some positions; its hash is the same whatever
stands at those. The hashes of all spans of the benchmark are joined with those of the documents, and a
hit counts only if the two spans agree in all but a few tokens. The 12 positions fall into four classes,
position mod 4, and a mask keeps two of the classes: whichever two tokens of a span are substituted, one
of the six masks ignores both.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import checked_broadcast, cut, packed, read, row_key

#: Tokens of a span, and how many of them may be substituted.
SPAN, SUBSTITUTED = 12, 2
#: For each seed the positions of the span that it hashes.
MASKS = [tuple(p for p in range(SPAN) if p % 4 in kept) for kept in combinations(range(4), 2)]


def token_hashes(text: Column) -> Column:
    """A hash for each token: a run of letters and digits in lower case."""
    return F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""), lambda t: F.xxhash64(t))


def _seeds(tokens: str, at: str) -> Column:
    """The hash of each mask at a position, with the mask's number."""
    return F.array(*[F.xxhash64(F.lit(n), *[F.col(tokens)[F.col(at) + p] for p in mask]) for n, mask in enumerate(MASKS)])


def _spans(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, at, span, seeds: each position of a span with its tokens; texts of fewer tokens than a span have none."""
    tokens = rows.select(F.col(key), token_hashes(F.col(text)).alias("tokens")).where(F.size("tokens") >= SPAN)
    each = tokens.select(key, "tokens", F.explode(F.sequence(F.lit(0), F.size("tokens") - SPAN)).alias("at"))
    return each.select(key, "at", F.slice("tokens", F.col("at") + 1, SPAN).alias("span"), _seeds("tokens", "at").alias("seeds"))


def hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc, item_id, first, last: first tokens of the first and last span of a document that agrees with one of the item but for two tokens.

    docs: doc, text. The benchmark's spans are broadcast by seed if they are few enough, else both sides are
    dealt out by seed, each row with the 12 tokens of its span only. A span that several items share stands
    once in that join and for all of them in the result. Items of fewer tokens than a span can't be told from
    chance and are not searched for.
    """
    items = cut(_spans(benchmark, "item_id", "text").groupBy("item_id", "span").agg(F.first("seeds").alias("seeds")))
    seeds = cut(items.select(F.col("span").alias("other"), F.explode("seeds").alias("seed")).distinct())
    spans = _spans(docs, "doc", "text").select("doc", "at", "span", F.explode("seeds").alias("seed"))
    agree = reduce(add, [(F.col("span")[p] == F.col("other")[p]).cast("int") for p in range(SPAN)])
    found = spans.join(checked_broadcast(seeds, seeds.count()), "seed").where(agree >= SPAN - SUBSTITUTED)
    by_span = found.groupBy("doc", F.col("other").alias("span")).agg(F.min("at").alias("first"), F.max("at").alias("last"))
    return by_span.join(checked_broadcast(items.select("item_id", "span"), items.count()), "span").drop("span")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc, item_ids (comma-joined), n_items, first_token, last_token of each document with a benchmark passage.

    Null and empty texts have no spans; rows that repeat a key are one document. Items that repeat an item_id
    are one item.
    """
    each = hits(docs, benchmark).groupBy("doc", "item_id").agg(F.min("first").alias("first"), (F.max("last") + SPAN - 1).alias("last"))
    by_doc = each.groupBy("doc").agg(F.sort_array(F.collect_list("item_id")).alias("items"), F.min("first").alias("first_token"), F.max("last").alias("last_token"))
    return by_doc.select("doc", F.array_join(F.col("items").cast("array<string>"), ",").alias("item_ids"), F.size("items").cast("long").alias("n_items"), "first_token", "last_token")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs without a benchmark passage. Rows without doc_id are judged by their text."""
    keyed = packed(docs, row_key().alias("key"))
    found = cut(contaminated(keyed.select(F.col("key").alias("doc"), "row.text"), benchmark).select(F.col("doc").alias("key")))
    return keyed.join(checked_broadcast(found, found.count()), "key", "left_anti").select("row.*")


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, item_ids, n_items, first_token, last_token of each document with a benchmark passage."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    return contaminated(docs, read(spark, sf_dir, "benchmark")).withColumnRenamed("doc", "doc_id")


def op6_sql() -> str:
    """The same by comparing spans that share the tokens of a mask, as text."""
    token = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"
    keys = ", ".join("concat_ws(' ', " + ", ".join([f"'{n}'", *[f"t[pos + {p + 1}]" for p in mask]]) + ")" for n, mask in enumerate(MASKS))
    agree = " + ".join(f"CAST(d.t[d.pos + {p + 1}] = b.t[b.pos + {p + 1}] AS INTEGER)" for p in range(SPAN))
    return f"""
WITH b0 AS (SELECT item_id, {token} AS t FROM benchmark),
b1 AS (SELECT item_id, t, CAST(unnest(range(0, len(t) - {SPAN - 1})) AS INTEGER) AS pos FROM b0 WHERE len(t) >= {SPAN}),
b AS (SELECT item_id, t, pos, unnest([{keys}]) AS seed FROM b1),
d0 AS (SELECT doc_id, {token} AS t FROM documents),
d1 AS (SELECT doc_id, t, CAST(unnest(range(0, len(t) - {SPAN - 1})) AS INTEGER) AS pos FROM d0 WHERE len(t) >= {SPAN}),
d AS (SELECT doc_id, t, pos, unnest([{keys}]) AS seed FROM d1),
e AS (SELECT d.doc_id, b.item_id, min(d.pos) AS f, max(d.pos) + {SPAN - 1} AS l FROM d JOIN b ON b.seed = d.seed WHERE {agree} >= {SPAN - SUBSTITUTED} GROUP BY ALL)
SELECT doc_id, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY item_id) AS item_ids, count(*) AS n_items, min(f) AS first_token, max(l) AS last_token
FROM e GROUP BY doc_id
"""
