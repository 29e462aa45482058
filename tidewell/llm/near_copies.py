"""Near copies: SimHash ball hashing over several tables, verified by the exact similarity of word shingles.

One fingerprint of 64 bits can't tell texts with a similarity of 0.8 from others within few bits: they differ
in ten. So the shingles of a text are summed up to a wide SimHash, whose bits make several fingerprints. They
get longer with the logarithm of the texts, so that strangers in a bucket stay as rare as they are, and there
are as many as find a pair at the least similarity with RECALL. In each table every fingerprint emits all variants within half the radius; colliding ones are
checked against further bits and make loose clusters. In a cluster the similarity of shingle sets decides,
pair by pair: small clusters in one task, large ones in blocks, first each block with a block of leaders,
then whatever is not yet in the largest component with all the others.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import checked_broadcast, cut, forget, join_hot, packed, row_key
from tidewell.llm.components import components, local_roots
from tidewell.llm.simhash import _ball, meet, shingle_hashes

#: Words of a shingle, and the similarity (Jaccard) from which on two texts are near copies.
SHINGLE, SIMILARITY = 5, 0.8
#: Bits that two fingerprints of a table may differ in, the probability that one of the tables finds a pair at
#: SIMILARITY, and bits of a fingerprint beyond the logarithm of the texts, and at least and at most.
RADIUS, RECALL, SPARE, FEWEST, MOST = 4, 0.99, 16, 32, 56
#: Bits that a colliding pair may differ in among 128 more: 3.6 standard deviations above what a pair at 0.8 has.
CHECK = 34
#: Rows of a task that holds a prefix at most; documents of a block, and bytes of their shingles.
PREFIX_ROWS, BLOCK, BLOCK_BYTES = 500_000, 256, 8 << 20
#: Pairs that are kept before they are reduced to a forest, and cells of a block's incidence matrix at once.
PAIRS_KEPT, CELLS = 1_000_000, 8_000_000


def _mixed(h: np.ndarray, k: int) -> np.ndarray:
    """Another 64 bits for each hash."""
    z = h + np.uint64((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def tables_for(n: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """How many tables of fingerprints n texts need, and how many bits each has.

    Sets as similar as that are at an angle of arccos(2s / (1 + s)), and so differ in each bit with that over pi.
    """
    bits = min(MOST, max(FEWEST, math.ceil(math.log2(max(2, n))) + SPARE))
    q = math.acos(2 * similarity / (1 + similarity)) / math.pi
    found = sum(math.comb(bits, k) * q**k * (1 - q) ** (bits - k) for k in range(RADIUS + 1))
    return math.ceil(math.log(1 - RECALL) / math.log(1 - found)), bits


def wide(h: np.ndarray, words: int) -> np.ndarray:
    """64 * words bits, as 0 and 1: each is 1 if set for over half of the hashes."""
    total = np.zeros(64 * words, dtype=np.int64)
    for low in range(0, len(h), 4096):
        part = h[low : low + 4096]
        mixed = np.stack([_mixed(part, k) for k in range(words)], axis=1)
        total += np.unpackbits(mixed.view(np.uint8), axis=1).sum(axis=0, dtype=np.int32)
    return (total * 2 > len(h)).astype(np.uint8)


def sketches(docs: DataFrame, tables: int, bits: int, shingle: int = SHINGLE) -> DataFrame:
    """key, th, id, size, tables, c1, c2 for each row of docs: key, th, text. id: a hash of the set of shingles."""
    at, words = np.arange(bits, dtype=np.uint64), -(-(tables * bits + 128) // 64)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            ids, sizes, found, checks = [], [], [], []
            for t in b.column(2):
                h = np.unique(shingle_hashes(t.as_py(), shingle))
                w = wide(h, words)
                ids.append(xxhash.xxh64_intdigest(h.tobytes()) >> 1)
                sizes.append(len(h))
                found.append((w[: tables * bits].reshape(tables, bits).astype(np.uint64) << at).sum(axis=1).astype(np.int64))
                checks.append(np.packbits(w[-128:]).view(np.int64))
            c = np.array(checks, dtype=np.int64).reshape(-1, 2)
            cols = [pa.array(ids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(found, pa.list_(pa.int64())), pa.array(c[:, 0]), pa.array(c[:, 1])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names=["key", "th", "id", "size", "tables", "c1", "c2"])

    return docs.select("key", "th", "text").mapInArrow(of, "key long, th long, id long, size int, tables array<long>, c1 long, c2 long")


class _Found:
    """Links between places that have passed the check, kept as a forest."""

    def __init__(self, check: np.ndarray):
        self.check, self.pairs, self.n = check, [np.zeros(0, dtype=np.int64)], 0

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        on = np.bitwise_count(self.check[a] ^ self.check[b]).sum(axis=1) <= CHECK
        if on.any():
            self.pairs.append(np.unique(np.minimum(a[on], b[on]) << 32 | np.maximum(a[on], b[on])))
            self.n += len(self.pairs[-1])
            if self.n > PAIRS_KEPT:
                root, nodes = self.roots(), np.arange(len(self.check))
                self.pairs = [(nodes << 32 | root)[root != nodes]]
                self.n = len(self.pairs[0])
        return on

    def take(self, key: np.ndarray, owner: np.ndarray) -> None:
        """Neighbours of a bucket; all pairs of it where neighbours fail, so that no stranger breaks a chain. key is sorted."""
        at = np.flatnonzero(key[1:] == key[:-1])
        on = self.near(owner[at], owner[at + 1])
        broken = np.unique(key[at[~on]])
        if len(broken):
            inside = np.flatnonzero(np.isin(key, broken))
            key, owner, step = key[inside], owner[inside], 2
            at = np.flatnonzero(key[step:] == key[:-step])
            while len(at):
                self.near(owner[at], owner[at + step])
                step += 1
                at = at[at + step < len(key)]
                at = at[key[at] == key[at + step]]

    def roots(self) -> np.ndarray:
        pair = np.concatenate(self.pairs)
        return local_roots(len(self.check), pair >> 32, pair & 0xFFFFFFFF)


def loose_links(nodes: DataFrame, bits: int) -> DataFrame:
    """u, v: links that connect all nodes (id, tables, c1, c2) that are within the radius in a table and pass the check."""
    half, n = RADIUS // 2, nodes.count()
    size = lambda p: sum(math.comb(p, k) for k in range(half + 1))
    p = next(p for p in range(4, bits - 8) if n * size(p) <= PREFIX_ROWS << p or p == bits - 9)
    flips = F.array(*[F.struct(F.lit(int(m)).alias("m"), F.lit(int(m).bit_count()).alias("k")) for m in _ball(p, half)])
    each = nodes.select("id", "c1", "c2", F.posexplode("tables").alias("t", "low")).select("*", F.explode(flips).alias("f"))
    prefix = (F.col("t") * (1 << p)).cast("long") + F.shiftright("low", bits - p).bitwiseXOR(F.col("f.m").cast("long"))
    dealt = each.select(prefix.alias("prefix"), "id", "low", "c1", "c2", (half - F.col("f.k")).cast("byte").alias("left"))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "low"])
        ids = pdf["id"].to_numpy()
        found = _Found(pdf[["c1", "c2"]].to_numpy().view(np.uint64))
        meet(pdf["low"].to_numpy().view(np.uint64), np.arange(len(ids)), pdf["left"].to_numpy(), bits - p, found.take)
        root = found.roots()
        on = root != np.arange(len(ids))
        return pd.DataFrame({"u": ids[on], "v": ids[root[on]]})

    return dealt.groupBy("prefix").applyInPandas(forest, "u long, v long")


def same(sets: list[np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of the sets (of distinct hashes) whose similarity is at least least."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, col, n = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = np.flatnonzero(n > 1)
    new = np.full(len(n), -1)
    new[shared] = np.arange(len(shared))
    on = new[col] >= 0
    owner, col = owner[on], new[col[on]]
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    both, step = np.zeros((len(sets), len(sets)), dtype=np.float32), max(1, CELLS // len(sets))
    for low in range(0, len(shared), step):
        a, b = np.searchsorted(col, [low, low + step])
        x = np.zeros((len(sets), min(step, len(shared) - low)), dtype=np.float32)
        x[owner[a:b], col[a:b] - low] = 1
        both += x @ x.T
    joint = both.astype(float)
    return np.nonzero(np.triu(joint >= least * (sizes[:, None] + sizes[None] - joint), 1) & (joint > 0))


def verified_links(docs: DataFrame, of: DataFrame, least: float = SIMILARITY, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """u, v: links that connect all ids of a cluster whose sets of shingles are similar by least or more.

    docs: id, text, one row for each id of a cluster; of: id, cluster, size (of its set).
    """
    blocks = F.ceil(F.greatest(F.count("*") / block, F.sum("size") * 8 / BLOCK_BYTES)).cast("long")
    large = of.groupBy("cluster").agg(blocks.alias("blocks"))
    members = of.join(large, "cluster").select("id", "cluster", "blocks")

    def shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), shingle)).tobytes() for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sets, pa.binary())], names=["id", "cluster", "blocks", "sets"])

    told = cut(docs.join(checked_broadcast(members, members.count()), "id").select("id", "cluster", "blocks", "text").mapInArrow(shingled, "id long, cluster long, blocks long, sets binary"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("id").sort_values("id")
        ids = pdf["id"].to_numpy()
        a, b = same([np.frombuffer(x, dtype=np.uint64) for x in pdf["sets"]], least)
        root = local_roots(len(ids), a, b)
        on = root != np.arange(len(ids))
        return pd.DataFrame({"u": ids[on], "v": ids[root[on]]})

    def part(n: str, seed: int = 0):
        return F.pmod(F.xxhash64("id", F.lit(seed)), F.col(n))

    together = max(1, told.where("blocks = 1").count() // (block // 2))
    small = told.where("blocks = 1").select(F.lit(-1).cast("long").alias("cluster"), F.pmod(F.xxhash64("cluster"), F.lit(together)).alias("i"), "id", "sets")
    first = told.where("blocks > 1").withColumn("i", part("blocks"))
    first = first.select("cluster", F.explode(F.when(F.col("i") == 0, F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).otherwise(F.array("i"))).alias("i"), "id", "sets")
    links = cut(small.union(first).groupBy("cluster", "i").applyInPandas(compare, "u long, v long"))
    big = told.where("blocks > 1").select("id", "cluster").distinct()
    if not big.take(1):
        return links
    root = components(links)
    state = cut(big.join(root, big["id"] == root["node"], "left").select("id", "cluster", F.coalesce("component", "id").alias("component")))
    sizes = state.groupBy("cluster", "component").agg(F.count("*").alias("n"))
    main = sizes.groupBy("cluster").agg(F.max_by("component", F.struct("n", "component")).alias("component"))
    rest = state.join(main, ["cluster", "component"], "left_anti")
    rests = rest.groupBy("cluster").agg(F.ceil(F.count("*") / (block // 2)).cast("long").alias("rests"))
    grid = told.join(rests, "cluster").withColumn("all", F.col("blocks") * 2)
    left = grid.join(rest.select("id"), "id", "left_semi").withColumn("i", part("rests", 1)).select("cluster", "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).alias("j"), "id", "sets")
    right = grid.withColumn("j", part("all", 2)).select("cluster", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rests") - 1)).alias("i"), "j", "id", "sets")
    return links.union(left.union(right).groupBy("cluster", "i", "j").applyInPandas(compare, "u long, v long"))


def near_copies(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """key, th, component of each row of docs: key, th, text. component: an id that near copies share.

    Two texts are linked if the sets of their shingles (lower-cased words) are similar by similarity or
    more; texts of fewer words than a shingle are one shingle, and all without words are copies of each
    other. Texts with the same set are one node, by 63 bits of a hash of it. A pair at the least similarity
    is missed by all tables with a probability of 1 - RECALL, the less the more similar it is.
    """
    tables, bits = tables_for(docs.count(), similarity)
    rows = cut(sketches(docs, tables, bits, shingle))
    nodes = cut(rows.groupBy("id").agg(*[F.first(c).alias(c) for c in ("size", "tables", "c1", "c2", "key", "th")]))
    of = components(loose_links(nodes, bits))
    known = cut(nodes.join(of, nodes["id"] == of["node"]).select("id", F.col("component").alias("cluster"), "size", "key", "th"))
    texts = docs.join(checked_broadcast(known.select("id", "key", "th"), known.count()), ["key", "th"]).select("id", "text").dropDuplicates(["id"])
    linked = components(verified_links(texts, known.select("id", "cluster", "size"), similarity, shingle))
    out = rows.join(linked, rows["id"] == linked["node"], "left").select("key", "th", F.coalesce("component", "id").alias("component"))
    forget(nodes)
    return out


def keep_one(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """The rows of docs that stay: of each group of near copies the one with the smallest doc_id.

    Of rows that repeat a doc_id, each is judged by its own text; of equal rows one stays, and of near copies
    with the same doc_id the one with the smaller hash. A row without doc_id stays if no row with one is near
    it. Rows are told apart by doc_id and a hash of the text; those that go are broadcast if they are few.
    """
    keyed = packed(docs, row_key().alias("key"), F.xxhash64("text").alias("th"))
    found = cut(near_copies(keyed.select("key", "th", "row.text"), similarity, shingle))
    best = found.groupBy("component").agg(F.min(F.struct("key", "th")).alias("best"), F.count("*").alias("n")).where("n > 1")
    several = cut(join_hot(found, best, "component", found.count()).select("key", "th", (F.struct("key", "th") == F.col("best")).alias("stays")))
    gone = several.where("not stays").select("key", "th").distinct()
    twice = several.where("stays").groupBy("key", "th").agg(F.count("*").alias("n")).where("n > 1").select("key", "th")
    left = keyed.join(checked_broadcast(gone, gone.count()), ["key", "th"], "left_anti")
    n = twice.count()
    if not n:
        return left.select("row.*")
    twice = checked_broadcast(twice, n)
    one = left.join(twice, ["key", "th"], "left_semi").dropDuplicates(["key", "th"])
    return left.join(twice, ["key", "th"], "left_anti").unionByName(one).select("row.*")
