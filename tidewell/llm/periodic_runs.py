"""Periodic runs of words by a harmonic grid.

A run of period p and length max(12, 2p) or more holds two words i and i + p with i on a grid whose spacing
is its length less p. So all runs show at the pairs (period, grid point): n / p of them for a period, n ln n
together. Prefix hashes tell whether two windows are equal, and a binary search over all pairs at once finds
how far the words from i and from i + p agree, forwards and backwards (their longest common extensions). The
words of what is found are compared, and of one stretch found with several periods the smallest stays.

A document never leaves its row: there is no shuffle, and a task holds WORDS_AT_ONCE words (or one longer
text) and PAIRS_AT_ONCE pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import read, small_batches

#: Fewest words of a run, besides two periods.
LEAST = 12
#: Words hashed together, and pairs (period, grid point) compared together.
WORDS_AT_ONCE, PAIRS_AT_ONCE = 1 << 20, 1 << 20
#: Two primes and bases of the prefix hashes.
MODULI, BASES = (2**31 - 1, 2**31 - 19), (911_382_323, 972_663_749)

RUNS = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class _Hashes:
    """Prefix hashes of a sequence of small whole numbers."""

    def __init__(self, w: np.ndarray):
        self.tables = []
        for m, base in zip(MODULI, BASES):
            power = np.ones(len(w) + 1, dtype=np.int64)
            done = 1
            while done < len(power):
                some = min(done, len(power) - done)
                power[done : done + some] = power[:some] * pow(base, done, m) % m
                done += some
            prefix = np.zeros(len(w) + 1, dtype=np.int64)
            prefix[1:] = np.cumsum((w + 1) * power[:-1] % m) % m
            self.tables.append((m, power, prefix))

    def same(self, i: np.ndarray, j: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the n numbers from i and those from j (not before i) have equal hashes."""
        out = np.ones(len(i), dtype=bool)
        for m, power, prefix in self.tables:
            out &= (prefix[i + n] - prefix[i]) % m * power[j - i] % m == (prefix[j + n] - prefix[j]) % m
        return out


def _longest(holds: Callable[[np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """For each pair the greatest n up to most for which holds(n), by one binary search over all of them."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) // 2
        yes = holds(middle)
        low, high = np.where(yes, middle, low), np.where(yes, high, middle - 1)
    return low


def _grid(starts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs in blocks: the text, the grid point (a place in the sequence) and the period of each."""
    text = np.repeat(np.arange(len(sizes)), sizes // 2)
    period = np.arange(len(text)) - np.repeat(np.cumsum(sizes // 2) - sizes // 2, sizes // 2) + 1
    spacing = np.maximum(LEAST - period, period)
    points = np.maximum(0, (sizes[text] - 1 - period) // spacing + 1)
    upto = np.cumsum(points)
    at = 0
    while at < len(text):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        n = points[at:end]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        of = np.repeat(text[at:end], n)
        yield of, starts[of] + k * np.repeat(spacing[at:end], n), np.repeat(period[at:end], n)
        at = end


def _exact(w: np.ndarray, i: int, p: int, start: int, end: int) -> tuple[int, int]:
    """Start and length of the stretch around i that keeps period p, word by word."""
    ahead = np.flatnonzero(w[i : end - p] != w[i + p : end])
    back = np.flatnonzero(w[start:i] != w[start + p : i + p])
    first = start + int(back[-1]) + 1 if len(back) else start
    last = i + int(ahead[0]) if len(ahead) else end - p
    return first, last + p - first


def runs_of(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs (start, length, smallest period) by start, then period."""
    names: dict[bytes, int] = {}
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    w = np.zeros(int(sizes.sum()) + len(texts) + 1, dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes  # a number of its own stands before each text and after the last: no window crosses it
    for s, t in zip(starts, texts):
        w[s : s + len(t)] = [names.setdefault(x, len(names)) for x in t]
    w[np.concatenate([starts - 1, [len(w) - 1]])] = len(names) + np.arange(len(texts) + 1)
    out: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    hashes = None
    for of, i, p in _grid(starts, sizes):
        on = w[i] == w[i + p]
        of, i, p = of[on], i[on], p[on]
        if not len(i):
            continue
        hashes = hashes or _Hashes(w)
        half = (np.maximum(LEAST - p, p) + 1) // 2  # the words that agree are as many as the spacing, so half of them lie on one side
        ahead, back = starts[of] + sizes[of] - i - p, i - starts[of]
        n, m = np.minimum(half, ahead), np.minimum(half, back)
        on = (half <= ahead) & hashes.same(i, i + p, n) | (half <= back) & hashes.same(i - m, i + p - m, m)
        of, i, p, ahead, back = of[on], i[on], p[on], ahead[on], back[on]
        f = _longest(lambda n: hashes.same(i, i + p, n), ahead)
        b = _longest(lambda n: hashes.same(i - n, i + p - n, n), back)
        on = f + b >= np.maximum(LEAST, 2 * p) - p
        found = np.stack([of[on], i[on] - b[on], f[on] + b[on] + p[on], p[on], i[on]])
        _, first = np.unique(found[:4], axis=1, return_index=True)
        for t, s, length, q, at in found[:, first].T.tolist():
            here, end = int(starts[t]), int(starts[t] + sizes[t])
            right = np.array_equal(w[s : s + length - q], w[s + q : s + length]) and w[s - 1] != w[s + q - 1] and w[s + length] != w[s + length - q]
            if not right:  # two windows with equal hashes and other words
                s, length = _exact(w, at, q, here, end)
                if length < max(LEAST, 2 * q):
                    continue
            key = (s - here, length)
            out[t][key] = min(q, out[t].get(key, q))
    return [sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2])) for found in out]


def kept_words(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, q in runs:
        depth[s + q] += 1
        depth[s + n] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:-1]) == 0)]


def periodic_runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start, length, period by start, then period), collapsed of each row of docs: doc_id, text.

    Words are what stands between blanks (space and \\t to \\r), compared byte by byte. A run is a stretch of
    words with smallest period q, of max(LEAST, 2q) words or more, that no word before or after it continues.
    collapsed has the words that no run holds after its first q, joined by a space. change(doc_id, words) may
    put other words in place of a text's own. Null and empty texts have no words, no runs, and an empty
    collapsed text. Rows that repeat a doc_id, or have none, are each returned.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            at = 0
            while at < len(ids):
                some, n = [], 0
                while at + len(some) < len(ids) and (not some or n < WORDS_AT_ONCE):
                    k = at + len(some)
                    words = (texts[k].as_py() or "").encode("utf-8", "surrogatepass").split()
                    some.append(change(ids[k], words) if change else words)
                    n += len(some[-1])
                runs = runs_of(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at : at + len(some)], pa.int64()),
                        pa.array([len(t) for t in some], pa.int64()),
                        pa.array([[{"start": s, "length": n, "period": q} for s, n, q in r] for r in runs], _RUN),
                        pa.array([b" ".join(kept_words(t, r)) for t, r in zip(some, runs)], pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "collapsed"],
                )
                at += len(some)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, RUNS)


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a document, of every tenth (by a hash of doc_id) with a tail that repeats. None for doc_id: as they are."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block = words[a : a + p]
    return words[:a] + (block * ((n - a) // p + 1))[: n - a]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, start, length, period, exponent_milli (of the longest run), runs_sha256, collapsed_sha256 of each document."""
    small_batches(spark)
    found = periodic_runs(read(spark, sf_dir, "documents"), planted)
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    each = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("t"), F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    milli = F.expr("(1000 * t.length) div -t.p").alias("exponent_milli")
    return each.select("doc_id", "n_runs", (-F.col("t.s")).alias("start"), F.col("t.length").alias("length"), (-F.col("t.p")).alias("period"), milli, "runs_sha256", "collapsed_sha256")
