"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits share a variant within r bits of both, so every
fingerprint emits all variants within half the radius, and colliding variants give the links.
A variant is shuffled by its first bits only: a fingerprint goes once to each prefix that its
variants can have (56 prefixes of 10 bits instead of 2,081 variants), and the task that holds a
prefix emits the variants below it, in ranges that fit its memory.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import accumulate, combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, read, small_batches
from tidewell.llm.components import components, local_roots

#: Variants that a task holds at once, and fewest bits of a variant that deal it out.
VARIANTS_AT_ONCE, PREFIX_BITS = 2_000_000, 10
#: The 8 bits of each byte, highest first.
BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """The XXH64 (seed 42) of each shingle of lower-cased words; fewer words are one shingle, none have none."""
    import xxhash

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line, ends = b" ".join(words), list(accumulate(map((1).__add__, map(len, words))))
    n = max(1, len(words) - shingle + 1)
    starts, stops = [0, *ends[: n - 1]], ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(line[i : j - 1], 42) for i, j in zip(starts, stops)]), dtype=">u8").astype(np.uint64)


def fingerprint(text: str | None, shingle: int = 4) -> int:
    """64 bits: bit i is 1 if set in over half of the shingles' hashes. No words: 0."""
    h = shingle_hashes(text, shingle)
    if not len(h):
        return 0
    octets = h.astype(">u8").view(np.uint8).reshape(-1, 8)
    total = np.concatenate([np.bincount(octets[:, k], minlength=256) @ BITS for k in range(8)])
    return int.from_bytes(np.packbits(total * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row of docs; a null text counts as empty."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(of, "doc_id long, fp long")


@lru_cache(maxsize=256)
def _ball(bits: int, r: int) -> np.ndarray:
    """All words of so many bits with at most r of them set."""
    return np.array([sum(1 << i for i in at) for k in range(r + 1) for at in combinations(range(bits), k)], dtype=np.uint64)


def meet(low: np.ndarray, who: np.ndarray, left: np.ndarray, bits: int, take: Callable[[np.ndarray, np.ndarray], None]) -> None:
    """Give take the variants, sorted, and the who of each: left bits may still change among the lowest bits of low."""
    size = sum(int((left == r).sum()) * sum(math.comb(bits, k) for k in range(r + 1)) for r in np.unique(left))
    if size > VARIANTS_AT_ONCE and bits > 8:
        top = np.uint64(1 << (bits - 1))
        for bit in (np.uint64(0), top):
            near = left - ((low & top) != bit)
            on = near >= 0
            if on.sum() > 1:
                meet(low[on], who[on], near[on], bits - 1, take)
        return
    mask = np.uint64((1 << bits) - 1)
    keys, owners = [], []
    for r in np.unique(left):
        at, ball = left == r, _ball(bits, int(r))
        keys.append(((low[at] & mask)[:, None] ^ ball).ravel())
        owners.append(np.repeat(who[at], len(ball)))
    if not keys:
        return
    key, owner = np.concatenate(keys), np.concatenate(owners)
    small = int(owner.max()).bit_length() if len(owner) else 0
    if bits + small <= 64:  # both in one word: a plain sort is faster than one of places
        both = np.sort(key << np.uint64(small) | owner.astype(np.uint64))
        take(both >> np.uint64(small), (both & np.uint64((1 << small) - 1)).astype(np.int64))
    else:
        order = np.argsort(key, kind="stable")
        take(key[order], owner[order])


def ball_links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """u, v: links that connect all fingerprints at no more than radius differing bits.

    fps: fp, rep (long), each fp once. Members of one bucket are within 2 * (radius // 2) bits of each
    other, so a chain through the bucket stands for all its pairs; each link is verified. A task returns
    a spanning forest of what it has seen, never the pairs themselves.
    """
    if radius % 2:
        raise ValueError("an even radius is needed: the variants lie within half of it")
    half, n = radius // 2, fps.count()
    variants = sum(math.comb(64, k) for k in range(half + 1))
    bits = min(24, max(PREFIX_BITS, math.ceil(math.log2(max(1, n * variants / VARIANTS_AT_ONCE)))))
    flips = F.array(*[F.struct(F.lit(int(m)).alias("m"), F.lit(int(m).bit_count()).alias("k")) for m in _ball(bits, half)])
    dealt = fps.select("fp", "rep", F.explode(flips).alias("f")).select(
        F.shiftrightunsigned("fp", 64 - bits).bitwiseXOR(F.col("f.m").cast("long")).alias("prefix"), "fp", "rep", (half - F.col("f.k")).alias("left")
    )

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rep", "fp"])
        fp, rep = pdf["fp"].to_numpy().view(np.uint64), pdf["rep"].to_numpy()
        found: list[np.ndarray] = []

        def chain(key: np.ndarray, owner: np.ndarray) -> None:
            same = np.flatnonzero(key[1:] == key[:-1])
            a, b = owner[same], owner[same + 1]
            found.append(np.unique(np.minimum(a, b) << 32 | np.maximum(a, b)))

        meet(fp, np.arange(len(fp)), pdf["left"].to_numpy(), 64 - bits, chain)
        pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
        a, b = pairs >> 32, pairs & 0xFFFFFFFF
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        root = local_roots(len(fp), a[near], b[near])
        on = root != np.arange(len(fp))
        return pd.DataFrame({"u": rep[on], "v": rep[root[on]]})

    return dealt.groupBy("prefix").applyInPandas(forest, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, shingle: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links) for each row of docs.

    Null and empty texts have fingerprint 0 and are linked like any other. Rows without doc_id get a
    fingerprint and the component of other rows with the same one (null if there are none); rows that
    repeat a doc_id are each returned.
    """
    fps = cut(fingerprints(docs, shingle))
    reps = fps.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    nodes = cut(reps.where("rep is not null"))
    of = components(ball_links(nodes, radius))
    named = nodes.join(of, nodes["rep"] == of["node"], "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint, component_id of every document."""
    small_batches(spark)
    return near_duplicates(read(spark, sf_dir, "documents"))
