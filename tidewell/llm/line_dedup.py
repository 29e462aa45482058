"""Repeated runs of lines by a suffix array over line IDs, built by distributed prefix doubling.

A suffix starts at each line that isn't blank. Its name at level k stands for its first 2 ** k lines;
the names of level k + 1 pair the name of a suffix with the one 2 ** k lines further on. Suffixes whose
name no other one has leave the doubling, so what goes on are the repeats. Suffixes that share a name
are an interval of the array with a common prefix, whose first place in (doc_id, line) order is the
original. A run of any length m is named by the two blocks of 2 ** k lines that cover it, from the
levels that are there.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.llm.common import cut, read

#: A run of lines is a repeated passage if it has more words than this.
WORDS = 50


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, i (number among the lines that aren't blank), line (number among all), name (hash of the line), words."""
    all_ = docs.select("doc_id", F.split("text", "\n", -1).alias("l")).select("doc_id", F.filter(F.transform("l", lambda x, k: F.struct(k.alias("line"), F.trim(x).alias("t"))), lambda x: x["t"] != "").alias("l"))
    each = all_.select("doc_id", F.posexplode("l").alias("i", "x"))
    return each.select("doc_id", "i", "x.line", F.xxhash64("x.t").alias("name"), F.size(F.split("x.t", r"\s+")).alias("words"))


def _repeated(level: DataFrame) -> DataFrame:
    """The rows whose name another row has too."""
    again = level.groupBy("name").agg(F.count("*").alias("_n")).where("_n > 1").select("name")
    return level.join(again, "name", "left_semi")


def suffix_levels(start: DataFrame) -> list[DataFrame]:
    """Level k: doc_id, i, name of the suffixes whose first 2 ** k lines come elsewhere too. start: level 0."""
    levels = [cut(_repeated(start.select("doc_id", "i", "name")))]
    while levels[-1].take(1):
        step = 1 << (len(levels) - 1)
        further = F.first("name").over(W.partitionBy("doc_id").orderBy("i").rangeBetween(step, step))
        longer = levels[-1].withColumn("next", further).where("next is not null").select("doc_id", "i", F.xxhash64("name", "next", F.lit(step)).alias("name"))
        levels.append(cut(_repeated(longer)))
    return levels[:-1] or levels


def _windows(known: DataFrame, words: int) -> DataFrame:
    """doc_id, i, m: for each line the shortest runs of more than so many words that start or that end there."""
    by_doc = W.partitionBy("doc_id", "island").orderBy("i")
    island = known.withColumn("island", F.col("i") - F.row_number().over(W.partitionBy("doc_id").orderBy("i")))
    total = island.withColumn("upto", F.sum("words").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    # a line that isn't blank has a word at least, so no such run has more than words + 1 lines
    sums = F.collect_list("upto").over(by_doc.rowsBetween(0, words))
    past = F.collect_list(F.col("upto") - F.col("words")).over(by_doc.rowsBetween(-words, 0))
    both = total.select("doc_id", "i", F.array_position(F.transform(sums, lambda x: x > F.col("upto") - F.col("words") + words), True).alias("ahead"), F.array_position(F.transform(F.reverse(past), lambda x: x < F.col("upto") - words), True).alias("back"))
    run = F.array(F.struct(F.col("i"), F.col("ahead").alias("m")), F.struct((F.col("i") - F.col("back") + 1).alias("i"), F.col("back").alias("m")))
    return both.select("doc_id", F.explode(run).alias("r")).where("r.m > 0").select("doc_id", F.col("r.i").cast("int").alias("i"), F.col("r.m").cast("int").alias("m")).distinct()


def repeated_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, line: the lines (from 0) of the later copies of all repeated runs of more than so many words.

    A run is taken to its full length: every line of it lies in a run of more than words words that is
    minimal from its start or its end. Lines are compared without blanks at their ends; blank lines count
    for nothing. Null and empty texts have no lines. Rows that repeat a doc_id with the same text are one
    document; rows without doc_id are left alone.
    """
    start = cut(lines(docs.where("doc_id is not null").select("doc_id", "text")).dropDuplicates(["doc_id", "i", "name"]))
    levels = suffix_levels(start)
    known = start.join(levels[0], ["doc_id", "i", "name"], "left_semi")
    runs = _windows(known, words).withColumn("k", F.floor(F.log2("m") + F.lit(1e-9)).cast("int"))
    names = reduce(DataFrame.union, [x.select("doc_id", "i", F.lit(k).alias("k"), "name") for k, x in enumerate(levels)])
    head = runs.join(names.withColumnRenamed("name", "head"), ["doc_id", "i", "k"])
    tail = names.select("doc_id", F.col("i").alias("t"), "k", F.col("name").alias("tail"))
    keyed = cut(head.withColumn("t", F.expr("i + m - shiftleft(1, k)")).join(tail, ["doc_id", "t", "k"]).select("doc_id", "i", "m", F.xxhash64("m", "head", "tail").alias("key")))
    first = keyed.groupBy("key").agg(F.min(F.struct("doc_id", "i")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = keyed.join(first, "key").where(F.struct("doc_id", "i") > F.col("first"))
    gone = later.select("doc_id", F.explode(F.sequence("i", F.col("i") + F.col("m") - 1)).alias("i")).distinct()
    return start.join(gone, ["doc_id", "i"], "left_semi").select("doc_id", "line").distinct()


def removals(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, removed (sorted numbers of the lines that go) for each document that loses any."""
    return repeated_lines(docs, words).groupBy("doc_id").agg(F.sort_array(F.collect_list("line")).alias("removed"))


def dedup_lines(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs without the later copies of repeated runs of lines in its texts."""
    gone = removals(docs, words)
    kept = F.array_join(F.filter(F.split("text", "\n", -1), lambda x, k: ~F.array_contains("removed", k)), "\n")
    return docs.join(gone, "doc_id", "left").withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_removed, removed_lines (numbers from 0, comma-joined) of each document that loses lines."""
    gone = removals(read(spark, sf_dir, "documents"))
    return gone.select("doc_id", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.col("removed").cast("array<string>"), ",").alias("removed_lines"))


def op9_sql() -> str:
    """The same from the texts of the runs themselves."""
    return f"""
WITH l AS (
  SELECT doc_id, unnest(range(0, len(t))) AS line, trim(unnest(t), ' ') AS s FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents)
), n AS (
  SELECT doc_id, line, s, len(regexp_split_to_array(s, '\\s+')) AS w, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS i FROM l WHERE s <> ''
), d AS (
  SELECT doc_id, list(s ORDER BY i) AS s, list(w ORDER BY i) AS w, list(line ORDER BY i) AS line FROM n GROUP BY doc_id
), p AS (
  SELECT doc_id, s, line, w, unnest(range(1, len(w) + 1)) AS i FROM d
), r AS (
  SELECT doc_id, s, line, i, list_filter(range(1, least({WORDS + 1}, len(w) - i + 1) + 1), lambda m: list_sum(w[i:i + m - 1]) > {WORDS})[1] AS ahead,
         list_filter(range(1, least({WORDS + 1}, i) + 1), lambda m: list_sum(w[i - m + 1:i]) > {WORDS})[1] AS back FROM p
), runs AS (
  SELECT DISTINCT doc_id, i, ahead AS m, array_to_string(s[i:i + ahead - 1], chr(10)) AS t FROM r WHERE ahead IS NOT NULL
  UNION
  SELECT DISTINCT doc_id, i - back + 1, back, array_to_string(s[i - back + 1:i], chr(10)) FROM r WHERE back IS NOT NULL
), later AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, m ORDER BY doc_id, i) AS k FROM runs) WHERE k > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + m)) AS i FROM later
)
SELECT doc_id, count(*) AS n_removed, string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) AS removed_lines
FROM n JOIN gone USING (doc_id, i) GROUP BY doc_id
"""
