"""Quality by an interpolated modified Kneser-Ney model of character 5-grams.

The words of a corpus are mostly rare, so the tokens are characters: 12 bits each, five to a 60-bit key. The
most frequent code points of the trusted text have an id each; the others share a few by a hash.
Counts of all trusted text are summed by key, and the lower orders are continuation counts of the next
higher one. Each n-gram that training has seen gets two values: total, the log-probability of its last
character with all backing off done, and step, what it adds to the total of its suffix. A document's
log-probability is then a sum of counts times values: the totals of the longest n-grams found among the
most frequent ones, of which a bounded number is broadcast, and the steps of all others, which a join
dealt out by key adds. Texts are judged by bits that held-out trusted texts of their language and length
have: quantiles of those are the limits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidewell.llm.common import checked_broadcast, cut, forget, packed, read, row_key, small_batches

ORDER, BITS = 5, 12
BEGIN, END = 1, 2
#: Ids that all code points but the frequent ones share, the first id of those, and ids they may have.
SHARED, FIRST, FREQUENT = 61, 64, (1 << BITS) - 64
#: n-grams that are broadcast at most (12 bytes each), and trusted documents of which one is held out.
HEAD, HELD_OUT = 1_000_000, 8
#: Quantile of held-out texts that is the limit, what is added to it, and texts that a length class must have.
QUANTILE, SLACK, CLASS_TEXTS = 0.998, 1.02, 100
CHUNK = 2_000_000


def alphabet(texts: DataFrame) -> np.ndarray:
    """The id of every code point: one each for the most frequent of texts (ties: the smaller first), as many as there are ids."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, dtype=np.int64)
        for b in batches:
            for t in b.column(0):
                if t.is_valid:
                    at, n = np.unique(np.frombuffer(t.as_py().encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)
                    total[at] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["point", "n"])

    top = texts.select("text").mapInArrow(count, "point long, n long").groupBy("point").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "point").limit(FREQUENT)
    ids = (np.arange(0x110000, dtype=np.int64) * 0x9E3779B1 % (1 << 32) % SHARED + FIRST - SHARED).astype(np.int16)
    points = [r["point"] for r in top.select("point").toLocalIterator()]
    ids[points] = FIRST + np.arange(len(points))
    return ids


def grams(text: str, ids: np.ndarray) -> np.ndarray:
    """The key of the n-gram that ends at each character and at the end. ids: what alphabet() returns."""
    x = ids[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")].astype(np.int64)
    x = np.concatenate([np.full(ORDER - 1, BEGIN), x, [END]])
    key = np.zeros(len(x) - ORDER + 1, dtype=np.int64)
    for k in range(ORDER):
        key = key << BITS | x[k : k + len(key)]
    return key


def gram_counts(texts: DataFrame, ids: np.ndarray) -> DataFrame:
    """key, c over all rows of texts: text. A task sums up each chunk before it sends anything."""
    sent = texts.sparkSession.sparkContext.broadcast(ids)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, c = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            both, at = np.unique(np.concatenate([keys, k]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([n, c]), minlength=len(both)).astype(np.int64)

        for b in batches:
            for t in b.column(0):
                if t.is_valid and (text := t.as_py()):
                    for at in range(0, len(text), CHUNK):  # a very long text goes in pieces that overlap
                        g = grams(text[max(0, at - ORDER + 1) : at + CHUNK], sent.value)
                        g = g[ORDER - 1 if at else 0 : None if at + CHUNK >= len(text) else -1]
                        held.append(g)
                        size += len(g)
                        if size >= CHUNK:
                            keys, n = merged()
                            held, size = [], 0
                            if len(keys) >= CHUNK:
                                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "c"])
                                keys, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        keys, n = merged()
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["key", "c"])

    return texts.select("text").mapInArrow(count, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


def _discounts(n: list[int]) -> list[float]:
    """The modified discounts for counts 1, 2 and 3 or more, from the numbers of n-grams of counts 1 to 4."""
    y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [min(max(k + 1 - (k + 2) * y * n[k + 1] / n[k], 0.05), k + 1 - 0.05) if n[k] else (k + 1) / 2 for k in range(3)]


def model(texts: DataFrame, ids: np.ndarray) -> DataFrame:
    """n, key, c, total, step of each n-gram of texts, for n of 1 to ORDER. n = 1, key = 0: an unseen character; n = 0: what a text has from its begin."""
    orders = {ORDER: cut(gram_counts(texts, ids))}
    for n in range(ORDER - 1, 0, -1):
        orders[n] = cut(orders[n + 1].groupBy(F.col("key").bitwiseAND((1 << BITS * n) - 1).alias("key")).agg(F.count("*").alias("c")))
    of, below, begin = {}, None, 0.0
    for n in range(1, ORDER + 1):
        first = [F.count(F.when(F.col("c") == k, 1)) for k in (1, 2, 3, 4)]
        d = _discounts(list(orders[n].agg(*first).first()))
        cost = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        grams_ = orders[n].withColumn("d", cost).withColumn("ctx", F.shiftright("key", BITS))
        ctx = grams_.groupBy("ctx").agg(F.sum("c").alias("s"), (F.sum("d") / F.sum("c")).alias("gamma"))
        if n == 1:
            s, gamma = ctx.select("s", "gamma").first() or (1, 1.0)
            p = grams_.select("key", "c", ((F.col("c") - F.col("d")) / s + gamma / (1 << BITS)).alias("p"), F.lit(0.0).alias("rest"))
            unseen = grams_.sparkSession.range(1).select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("c"), F.lit(gamma / (1 << BITS)).alias("p"), F.lit(0.0).alias("rest"))
            p = p.union(unseen)
        else:
            lower = of[n - 1].select(F.col("key").alias("suffix"), F.col("p").alias("q"))
            joined = grams_.withColumn("suffix", F.col("key").bitwiseAND((1 << BITS * (n - 1)) - 1)).join(ctx, "ctx").join(lower, "suffix")
            p = joined.select("key", "c", ((F.col("c") - F.col("d")) / F.col("s") + F.col("gamma") * F.col("q")).alias("p"), (F.log("gamma") + F.log("q")).alias("rest"))
            only_begin = sum(BEGIN << BITS * k for k in range(n - 1))
            begin += next((r[0] for r in ctx.where(F.col("ctx") == only_begin).select(F.log("gamma")).collect()), 0.0)
            backoff = ctx.select(F.col("ctx").alias("key"), F.log("gamma").alias("bo"))
            of[n - 1] = cut(of[n - 1].join(backoff, "key", "left").na.fill(0.0, ["bo"]))
        of[n] = cut(p)
    out = None
    for n in range(1, ORDER + 1):
        x = of[n] if n < ORDER else of[n].withColumn("bo", F.lit(0.0))
        x = x.select(F.lit(n).alias("n"), "key", "c", "p", "rest", "bo")
        step = x.withColumn("step", F.log("p") - F.col("rest") + F.col("bo"))
        if n == 1:
            total = step.withColumn("total", F.col("step"))
        else:
            lower = below.select(F.col("key").alias("suffix"), F.col("total").alias("under"))
            total = step.withColumn("suffix", F.col("key").bitwiseAND((1 << BITS * (n - 1)) - 1)).join(lower, "suffix").withColumn("total", F.col("under") + F.col("step"))
        below = cut(total.select("n", "key", "c", "total", "step"))
        out = below if out is None else out.union(below)
    for x in [*orders.values(), *of.values()]:
        forget(x)
    zero = out.sparkSession.range(1).select(F.lit(0).alias("n"), F.lit(0).cast("long").alias("key"), F.lit(0).cast("long").alias("c"), F.lit(begin).alias("total"), F.lit(begin).alias("step"))
    return out.union(zero)


def _tag(n: Column | int) -> Column:
    """The order of an n-gram above the bits of its key, so that one column names n-grams of all orders."""
    return F.shiftleft((F.lit(n) if isinstance(n, int) else n).cast("long"), BITS * ORDER)


class Head:
    """The n-grams held in memory: from tagged key to total, by a table of first slots and a search for the rest."""

    def __init__(self, keys: np.ndarray, totals: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.totals = keys[order], totals[order].astype(np.float32)

    def find(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "slots"):  # in each worker, rather than sent
            self.slots = np.zeros(1 << 21, dtype=np.int32)
            self.slots[self._slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        at = self.slots[self._slot(q)]
        miss = np.flatnonzero(self.keys[at] != q)
        if len(miss):
            at[miss] = np.minimum(np.searchsorted(self.keys, q[miss]), len(self.keys) - 1)
        return self.keys[at] == q, self.totals[at]

    @staticmethod
    def _slot(q: np.ndarray) -> np.ndarray:
        return ((q.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(43)).astype(np.int64)

    def __getstate__(self):
        return {"keys": self.keys, "totals": self.totals}


def scored(docs: DataFrame, of: DataFrame, ids: np.ndarray, head_rows: int = HEAD) -> DataFrame:
    """docs' columns but text, with n (characters and the end) and nats (their negative log-probability by the model of).

    of: what model() returns. The head_rows most frequent n-grams are broadcast; where the model has more,
    the n-grams of a document that are not among them are counted and joined with the rest by key.
    """
    spark = docs.sparkSession
    total_rows = of.count()
    least = 0
    if total_rows > head_rows:  # the least count at which the n-grams fit the head, from a table of counts
        sizes = of.groupBy(F.least("c", F.lit(1000)).alias("c")).agg(F.count("*").alias("n")).orderBy(F.desc("c")).collect()
        room = head_rows
        for r in sizes:
            if r["n"] > room:
                break
            room, least = room - r["n"], r["c"]
        else:
            least = 0
        least = least or 1001
    in_head = (F.col("c") >= least) | (F.col("n") <= 1)
    head = of.where(in_head).select((_tag(F.col("n")) + F.col("key")).alias("k"), F.col("total").cast("float").alias("total")).toArrow()
    letters = spark.sparkContext.broadcast(ids)
    sent = spark.sparkContext.broadcast(Head(head["k"].to_numpy(), head["total"].to_numpy()))
    begin = float(head["total"].to_numpy()[head["k"].to_numpy() == 0].sum())
    tails = total_rows > head.num_rows
    del head

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        masks = [(1 << BITS * n) - 1 for n in range(ORDER + 1)]
        for b in batches:
            out: list[tuple] = []
            for t in b.column(b.schema.get_field_index("text")):
                text, n, nats, tail = t.as_py() or "", 0, 0.0, []
                for at in range(0, len(text), CHUNK):
                    q = grams(text[max(0, at - ORDER + 1) : at + CHUNK], letters.value)
                    q = q[ORDER - 1 if at else 0 : None if at + CHUNK >= len(text) else -1]
                    n += len(q)
                    for order in range(ORDER, 0, -1):
                        found, total = table.find((q & masks[order]) | order << BITS * ORDER)
                        nats -= float(total[found].sum(dtype=np.float64))
                        q = q[~found]
                        if not len(q):
                            break
                        if tails:
                            tail.append((q & masks[order]) | order << BITS * ORDER)
                    else:
                        nats -= len(q) * float(table.find(np.array([1 << BITS * ORDER]))[1][0])
                nats -= begin if n else 0.0
                k, c = np.unique(np.concatenate(tail), return_counts=True) if tail else ([], [])
                out.append((n, nats, k, c))
            cols = [b.column(i) for i, name in enumerate(b.schema.names) if name != "text"]
            cols += [pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.float64())]
            if tails:
                cols += [pa.array([r[2] for r in out], pa.list_(pa.int64())), pa.array([r[3] for r in out], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    kept = docs.drop("text")
    names = [*kept.columns, "n", "nats", *["tail", "times"] * tails][: len(kept.columns) + (4 if tails else 2)]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema], "n long, nats double", *["tail array<long>, times array<long>"] * tails])
    first = docs.mapInArrow(score, schema)
    if not tails:
        return first
    first = cut(first.withColumn("_row", F.monotonically_increasing_id()))
    rest = of.where(~in_head).select((_tag(F.col("n")) + F.col("key")).alias("k"), "step")
    each = first.select("_row", F.explode(F.arrays_zip("tail", "times")).alias("x")).select("_row", F.col("x.tail").alias("k"), F.col("x.times").alias("times"))
    more = each.join(rest, "k").groupBy("_row").agg(F.sum(F.col("times") * F.col("step")).alias("more"))
    return first.join(more, "_row", "left").withColumn("nats", F.col("nats") - F.coalesce("more", F.lit(0.0))).select(*kept.columns, "n", "nats")


def length_class(n: Column) -> Column:
    """0 up to 64 characters, and one more for each four times as many, up to 3."""
    return F.least(F.lit(3), F.greatest(F.lit(0), F.ceil((F.log2(n) - 6) / 2))).cast("int")


def limits(held: DataFrame, quantile: float = QUANTILE, slack: float = SLACK, texts: int = CLASS_TEXTS) -> DataFrame:
    """lang, class, limit: what of texts of the language and length class a share of quantile stays below, times slack.

    held: lang, class, loss. Losses are counted in bins of 0.001, so no task holds a language. A class with
    too few texts takes the limit of its language, or of all, whichever has enough.
    """
    bins = held.groupBy("lang", "class", F.round("loss", 3).alias("loss")).agg(F.count("*").alias("n"))
    grouped = bins.groupBy(F.expr("lang"), F.expr("class"), "loss").agg(F.sum("n").alias("n"))
    by_lang = bins.groupBy("lang", "loss").agg(F.sum("n").alias("n")).select("lang", F.lit(-1).alias("class"), "loss", "n")
    by_class = bins.groupBy("class", "loss").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "class", "loss", "n")
    over_all = bins.groupBy("loss").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), F.lit(-1).alias("class"), "loss", "n")
    every = grouped.select("lang", "class", "loss", "n").union(by_lang).union(by_class).union(over_all)
    w = W.partitionBy("lang", "class")
    upto = every.withColumn("upto", F.sum("n").over(w.orderBy("loss"))).withColumn("all", F.sum("n").over(w))
    return upto.where(F.col("upto") >= F.col("all") * quantile).groupBy("lang", "class").agg((F.min("loss") * slack).alias("limit"), F.max("all").alias("texts")).withColumn("enough", F.col("texts") >= texts)


def judged(docs: DataFrame, trusted: DataFrame, head_rows: int = HEAD) -> DataFrame:
    """key, lang, n, loss (nats a character), limit, keep of each row of docs.

    docs: key, lang, text. trusted: key of the trusted rows. A text is rejected if its loss is above its
    limit; null and empty texts, which have no loss, are rejected. A null lang is a language of its own.
    Without any trusted text nothing is known and every text that isn't empty is kept.
    """
    docs = docs.withColumn("lang", F.coalesce("lang", F.lit("(none)")))
    trusted = cut(trusted.select("key").distinct())
    rows = trusted.count()
    is_held = F.pmod(F.xxhash64("key", F.lit("held out")), F.lit(HELD_OUT)) == 0
    good = cut(docs.join(checked_broadcast(trusted, rows), "key", "left_semi").where(~is_held).select("text"))
    ids = alphabet(good)
    of = cut(model(good, ids))
    scores = cut(scored(docs.select("key", "lang", "text"), of, ids, head_rows).withColumn("loss", F.when(F.col("n") > 1, F.col("nats") / F.col("n"))))
    forget(good)
    scores = scores.withColumn("class", length_class(F.col("n")))
    held = scores.where(is_held & F.col("loss").isNotNull()).join(checked_broadcast(trusted, rows), "key", "left_semi")
    # languages times five classes of lengths, each a few bytes
    known = {(r["lang"], r["class"]): (r["limit"], r["enough"]) for r in limits(held).toLocalIterator()}
    langs = {lang for lang, _ in known if lang}
    spark = docs.sparkSession

    def limit_of(lang: str | None, k: int) -> float:
        tries = [known.get((lang, k)), known.get((lang, -1)), known.get((None, k)), known.get((None, -1))]
        there = [x for x in tries if x]
        return next((x[0] for x in there if x[1]), max((x[0] for x in there), default=math.inf))

    table = spark.createDataFrame(pd.DataFrame([(lang, k, limit_of(lang, k)) for lang in sorted(langs) for k in range(4)], columns=["lang", "class", "limit"]), "lang string, class int, limit double")
    other = F.element_at(F.array(*[F.lit(limit_of(None, k)) for k in range(4)]), F.col("class") + 1)
    out = scores.join(checked_broadcast(table, len(langs) * 4), ["lang", "class"], "left").withColumn("limit", F.coalesce("limit", other))
    return out.select("key", "lang", "n", "loss", "limit", F.coalesce(F.col("loss") <= F.col("limit"), F.lit(False)).alias("keep"))


def trusted_rows(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").alias("key"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that the classifier keeps. Rows that repeat a doc_id go together if one is rejected."""
    keyed = packed(docs, row_key().alias("key"))
    found = judged(keyed.select("key", "row.lang", "row.text"), trusted_rows(labels))
    gone = cut(found.where("not keep").select("key").distinct())
    return keyed.join(checked_broadcast(gone, gone.count()), "key", "left_anti").select("row.*")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, perplexity (of a character), highest perplexity kept, keep of each document."""
    small_batches(spark)
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "lang", "text")
    found = judged(docs, trusted_rows(read(spark, sf_dir, "labels")))
    return found.select(F.col("key").alias("doc_id"), "lang", F.exp("loss").alias("perplexity"), F.exp("limit").alias("highest"), "keep")
