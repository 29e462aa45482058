"""Toxicity by a counterfactually regularised classifier.

A logistic model over the presence of words and of their beginnings, which inflected forms share. Each training text also comes with its identity terms
swapped, and one without any with a neutral mention put in; what the swap changes in the score is
penalised, so that naming a group doesn't make a text toxic.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import cut, read, small_batches

#: Labelled texts on which the model is fitted at most, words it keeps at most, texts that a word must be in.
SAMPLE, WORDS, LEAST = 12_000, 1024, 5
#: Strength of the counterfactual penalty and of the weights' own, which drops words of few toxic texts.
FAIRNESS, SPARSE = 1.0, 0.004
ROUNDS = 1500
#: Lengths of the beginnings; one is written as itself and a star.
PREFIXES = (4, 5, 6)

#: Identity terms by kind: a fixed list. A term is swapped for the next one of its kind.
IDENTITY = {
    "gender": ["man", "woman", "men", "women", "boy", "girl", "male", "female", "transgender", "nonbinary"],
    "religion": ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"],
    "origin": ["african", "american", "asian", "european", "arab", "mexican", "chinese", "indian", "german", "french", "spanish", "immigrant", "refugee"],
    "colour": ["black", "white", "brown"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "homosexual", "heterosexual"],
    "age and ability": ["old", "young", "elderly", "teenage", "deaf", "blind", "disabled", "autistic"],
}
SWAP = {t: terms[(k + 1) % len(terms)] for terms in IDENTITY.values() for k, t in enumerate(terms)}
WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    return set(WORD.findall((text or "").lower()))


def swapped(found: set[str], mention: str) -> set[str]:
    """found with its identity terms swapped, or with a mention where there are none."""
    named = found & SWAP.keys()
    return (found - named) | {SWAP[t] for t in named} if named else found | {mention}


def features_of(found: set[str]) -> set[str]:
    """Words, the beginnings of longer ones, and the beginnings that two or three of them share."""
    out = set(found)
    for k in PREFIXES:
        for start, n in Counter([w[:k] for w in found if len(w) > k]).items():
            out.update([start + "*", start + "**", start + "***"][:n])
    return out


class Model:
    """Weights of words and beginnings, for a logistic score."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights, self.bias = weights, bias

    def score(self, text: str | None) -> float:
        z = self.bias + sum(self.weights[w] for w in sorted(self.weights.keys() & features_of(words(text))))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _dense(rows: list[list[int]], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each feature that is there."""
    return np.repeat(np.arange(len(rows)), [len(r) for r in rows]), np.array([j for r in rows for j in r], dtype=np.int64)


def fit(texts: list[list[int]], twins: list[list[int]], y: np.ndarray, width: int, sparse: float = SPARSE, balanced: bool = True, fairness: float = FAIRNESS, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise log loss (balanced: with both labels weighing the same) + fairness * mean (z - z of the twin) ** 2 + sparse * |w|, by accelerated proximal steps."""
    n = len(y)
    (i, j), (k, m) = _dense(texts, width), _dense(twins, width)
    w, b = np.zeros(width), 0.0
    balance = np.ones(n) if not balanced else np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    most = max([1, *map(len, texts)]) + max([1, *map(len, twins)])
    step = 1 / (0.25 * most + 2 * fairness * most + 1)
    ahead, ahead_b, pace = w, b, 1.0
    for _ in range(rounds):
        z = np.bincount(i, ahead[j], minlength=n)
        gap = z - np.bincount(k, ahead[m], minlength=n)
        g = balance * (1 / (1 + np.exp(-np.clip(z + ahead_b, -30, 30))) - y) / n
        pull = 2 * fairness * gap / n
        grad = np.bincount(j, (g + pull)[i], minlength=width) - np.bincount(m, pull[k], minlength=width)
        moved = ahead - step * grad
        new, new_b = np.sign(moved) * np.maximum(np.abs(moved) - step * sparse, 0), ahead_b - step * g.sum()
        nextp = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        ahead, ahead_b = new + (pace - 1) / nextp * (new - w), new_b + (pace - 1) / nextp * (new_b - b)
        w, b, pace = new, new_b, nextp
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of the texts of docs that labels marks, from at most about sample rows (by a hash of doc_id) outside the held-out fifth.

    With no text of either label every score is the share of toxic ones (a half without any).
    """
    marked = labels.where("doc_id is not null and toxic is not null and crc32(cast(doc_id as string)) % 5 <> 0").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = marked.count()
    cutoff = int(min(1.0, sample / max(n, 1)) * (1 << 20))
    chosen = marked.where(F.pmod(F.xxhash64("doc_id", F.lit("toxicity")), F.lit(1 << 20)) < cutoff)
    some = cut(docs.where("text is not null").join(F.broadcast(chosen), "doc_id").select("toxic", "text"))
    total = some.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("t")).first()
    rate = total["t"] / total["n"] if total["n"] else 0.5
    if not total["n"] or not 0 < rate < 1:
        return Model({}, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sorted(features_of(words(t))) for t in b.column(1).to_pylist()], pa.list_(pa.string()))], names=["toxic", "words"])

    spelt = some.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(spell, "toxic int, words array<string>")
    each = spelt.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"))
    identity = F.col("word").isin(sorted(SWAP))
    spread = F.abs(F.col("t") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    kept = each.where((F.col("n") >= LEAST) & (spread >= 4) & ~identity).orderBy(F.desc(spread), "word").limit(WORDS).select("word")
    names = sorted(r["word"] for r in kept.collect()) + sorted(SWAP)  # bounded by WORDS and the list of terms
    at = {w: k for k, w in enumerate(names)}
    mentions = sorted(SWAP)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own, other = [], []
            for text in b.column(1).to_pylist():
                have = words(text)
                twin = swapped(have, mentions[len(text) % len(mentions)])
                own.append(sorted(at[w] for w in features_of(have) & at.keys()))
                other.append(sorted(at[w] for w in features_of(twin) & at.keys()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.int32())), pa.array(other, pa.list_(pa.int32()))], names=["toxic", "own", "twin"])

    rows = some.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(features, "toxic int, own array<int>, twin array<int>").toArrow()
    rows = sorted(zip(rows["toxic"].to_pylist(), rows["own"].to_pylist(), rows["twin"].to_pylist()))
    own, twin, y = [r[1] for r in rows], [r[2] for r in rows], np.array([r[0] for r in rows], dtype=float)
    first, _ = fit(own, twin, y, len(names))  # which words count; then how much
    on = {int(k): n for n, k in enumerate(np.flatnonzero(np.abs(first) > 1e-6))}
    names = [names[k] for k in on]
    w, b = fit([[on[k] for k in r if k in on] for r in own], [[on[k] for k in r if k in on] for r in twin], y, len(names), sparse=1e-5, balanced=False)
    return Model({t: float(v) for t, v in zip(names, w) if abs(v) > 1e-4}, b)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs. Null and empty texts have the score of the bias; a null doc_id isn't held out."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sent.value.score(t.as_py()) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    found = docs.select("doc_id", "text").mapInArrow(score, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read(spark, sf_dir, "documents")
    return scores(docs, train(docs, read(spark, sf_dir, "labels")))
