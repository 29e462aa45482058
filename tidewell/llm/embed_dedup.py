"""Embedding near-duplicates by product quantisation.

Each distinct vector is filed in the inverted list of its nearest coarse centroid, with its residual as
codes of subspaces. A query probes all lists that can hold a vector y within the radius: for y to be nearer
to centroid c than to c0, the query's nearest, y - x must cross the plane between the two, and y is no
farther from c than the farthest vector filed there. Both bounds are exact: no list that holds a partner is
left out. Lists near each other form bins, and a query is sent once to each bin it probes. In a list,
codes are looked up in the tables of codewords, and the distances of the queries as they are from what the
codes stand for come from one product of matrices; as |y - code(y)| is added to the radius, no vector is
lost by them. What remains is compared by cosine in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import cut, join_hot, read
from tidewell.llm.components import components, local_roots

#: Vectors on which centroids and codes are fitted at most, vectors of a block, subspaces and codes of each.
SAMPLE, BLOCK, SUBSPACES, CODES, LISTS = 4096, 256, 16, 64, 1024
PAIRS_AT_ONCE, PAIRS_KEPT = 50_000, 500_000
#: Bytes of the vectors filed in a bin at most, and fewest bins.
BIN_BYTES, BINS = 4 << 20, 6
SLIP, SINGLE_SLIP = 1e-9, 1e-4  # what rounding may take from a bound, and from one in single precision


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """At most k centroids of the rows of x."""
    rng = np.random.default_rng(seed)
    centre = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = _square(x, centre).argmin(axis=1)
        n = np.bincount(near, minlength=len(centre))
        total = np.zeros_like(centre)
        np.add.at(total, near, x)
        centre[n > 0] = total[n > 0] / n[n > 0, None]
    return centre


def _square(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum(0, (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)[None])


class Quantiser:
    """Coarse centroids and the codewords of each subspace."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.coarse = kmeans(sample, lists)
        rest = sample - self.coarse[_square(sample, self.coarse).argmin(axis=1)]
        self.parts = np.array_split(np.arange(sample.shape[1]), min(SUBSPACES, sample.shape[1]))
        self.words = [kmeans(rest[:, p], CODES) for p in self.parts]

    def file(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row its list and how far it is from the centroid."""
        near = _square(x, self.coarse).argmin(axis=1)
        rest = x - self.coarse[near]
        return near, np.linalg.norm(rest, axis=1)

    def code(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each residual its codes and how far it is from them."""
        codes = np.stack([_square(rest[:, p], w).argmin(axis=1) for p, w in zip(self.parts, self.words)], axis=1)
        back = np.concatenate([w[codes[:, k]] for k, w in enumerate(self.words)], axis=1)
        return codes.astype(np.uint8), np.linalg.norm(rest - back, axis=1)

    def probes(self, x: np.ndarray, radius: float, far: np.ndarray) -> np.ndarray:
        """For each row and list whether the list, whose vectors are up to far from its centroid, can hold one within the radius."""
        d = _square(x, self.coarse)
        near = d.argmin(axis=1)
        apart = np.sqrt(_square(self.coarse, self.coarse))[near]
        crosses = d - d[np.arange(len(x)), near][:, None] <= 2 * apart * (radius + SLIP) + SLIP
        return crosses & (np.sqrt(d) <= far + radius + 1e-6)

    def decoded(self, of: int, codes: np.ndarray) -> np.ndarray:
        """The vectors that codes in the list of stand for, looked up in the tables of codewords."""
        return np.concatenate([w[codes[:, k]] for k, w in enumerate(self.words)], axis=1) + self.coarse[of]


class Bins:
    """Blocks of about BLOCK vectors, each of one list, dealt to at least BINS bins, lists near each other together."""

    def __init__(self, q: Quantiser, sizes: dict[int, int], dim: int):
        of = np.zeros(len(q.coarse), dtype=np.int64)
        of[list(sizes)] = list(sizes.values())
        self.blocks = -(-of // BLOCK)
        self.n = max(BINS, -(-int(of.sum()) * 4 * dim // BIN_BYTES))
        middle = kmeans(q.coarse, self.n)
        order = np.argsort(_square(q.coarse, middle).argmin(axis=1), kind="stable")
        self.first = np.zeros(len(of), dtype=np.int64)
        self.first[order] = np.cumsum(self.blocks[order]) - self.blocks[order]
        lists = np.repeat(np.arange(len(of)), self.blocks)
        at = np.repeat(self.first, self.blocks) + np.arange(len(lists)) - np.repeat(np.cumsum(self.blocks) - self.blocks, self.blocks)
        rows = np.repeat(of / np.maximum(1, self.blocks), self.blocks)
        self.bin = np.zeros(len(lists), dtype=np.int64)
        by = np.argsort(at)
        self.bin[at[by]] = np.minimum(self.n - 1, (np.cumsum(rows[by]) - rows[by]) * self.n / max(1, of.sum()))
        self.has = np.zeros((len(of), self.n), dtype=np.float32)
        self.has[lists, self.bin[at]] = 1

    def of(self, lists: np.ndarray, rep: np.ndarray) -> np.ndarray:
        """The bin in which a vector of the list is filed."""
        return self.bin[self.first[lists] + _mixed(rep) % self.blocks[lists]]


def _mixed(rep: np.ndarray) -> np.ndarray:
    h = rep.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)).astype(np.int64)


def _forest(n: int, pairs: list[np.ndarray]) -> np.ndarray:
    pair = np.concatenate(pairs)
    return local_roots(n, pair >> 32, pair & 0xFFFFFFFF)


def _search(pdf: pd.DataFrame, q: Quantiser, least: float, radius: float, far: np.ndarray, dim: int, kind: str) -> pd.DataFrame:
    """rep, n (vectors linked), root: of the queries and filed vectors of one bin."""
    pdf = pdf.sort_values(["rep", "filed"])
    raw = np.frombuffer(b"".join(pdf["vec"]), dtype=kind).reshape(-1, dim).astype(float)
    unit = raw / np.linalg.norm(raw, axis=1, keepdims=True)
    rep, filed, lists = pdf["rep"].to_numpy(), pdf["filed"].to_numpy(), pdf["list"].to_numpy()
    ids, at = np.unique(rep, return_inverse=True)
    ask, copies = np.flatnonzero(~filed), pdf["copies"].to_numpy()
    held = {}
    for of in np.unique(lists[filed]):
        y = np.flatnonzero(filed & (lists == of))
        codes, off = q.code(unit[y] - q.coarse[of])
        back = q.decoded(of, codes)
        least_dot = (1 + (back**2).sum(axis=1) - (radius + off + SINGLE_SLIP) ** 2) / 2  # |x - back| <= radius + off, for |x| = 1
        held[int(of)] = (y, back.astype(np.float32), least_dot.astype(np.float32))
    single = unit.astype(np.float32)
    linked = np.zeros(len(ids), dtype=np.int64)
    pairs, kept = [np.zeros(0, dtype=np.int64)], 0
    for start in range(0, len(ask), BLOCK):
        some = ask[start : start + BLOCK]
        probed = q.probes(unit[some], radius, far)
        for of, (y, back, least_dot) in held.items():
            a = some[probed[:, of]]
            if not len(a):
                continue
            for low in range(0, len(y), 4096):
                i, j = np.nonzero(single[a] @ back[low : low + 4096].T >= least_dot[low : low + 4096])
                for s in range(0, len(i), PAIRS_AT_ONCE):
                    u, v = a[i[s : s + PAIRS_AT_ONCE]], y[low + j[s : s + PAIRS_AT_ONCE]]
                    on = (np.einsum("ij,ij->i", unit[u], unit[v]) >= least) & (rep[u] != rep[v])
                    linked += np.bincount(at[u[on]], copies[v[on]], minlength=len(ids)).astype(np.int64)
                    pairs.append(np.unique(at[u[on]] << 32 | at[v[on]]))
                    kept += len(pairs[-1])
                    if kept > PAIRS_KEPT:
                        root, nodes = _forest(len(ids), pairs), np.arange(len(ids))
                        pairs, kept = [(nodes << 32 | root)[root != nodes]], 0
    root = _forest(len(ids), pairs)
    on = (linked > 0) | (root != np.arange(len(ids)))
    return pd.DataFrame({"rep": ids[on], "n": linked[on], "root": ids[root[on]]})


def near_duplicates(vectors: DataFrame, least: float = 0.95) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row of vectors: vec_id, embedding.

    Two vectors are linked at a cosine of least or more. A null or zero vector and one with null or
    non-finite components link with nothing: their component is themselves. Vectors of different lengths are
    not linked; each length that occurs is searched by itself. Copies are compared once: a class stands for
    all rows with its components (by 128 bits of hash), and each row counts the others of its class. A row
    without vec_id counts as a vector; its component is the smallest vec_id reachable, null if there is none.
    Rows that repeat a vec_id count each, and are linked by their vectors only.
    """
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.typeName() == "float" else "<f8"  # as the rows have it: exact
    e = F.transform("embedding", lambda v: v.cast("double"))
    good = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("e", lambda v: v != 0)
    rows = vectors.select("vec_id", e.alias("e")).withColumn("good", F.coalesce(good, F.lit(False)))
    rows = rows.select("vec_id", F.when(F.col("good"), F.col("e")).alias("e")).withColumn("h1", F.xxhash64("e")).withColumn("h2", F.xxhash64(F.lit(1), "e"))
    by_class = rows.where("e is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("e").alias("e"))
    classes = cut(by_class.withColumn("rep", F.xxhash64("h1", "h2")).withColumn("dim", F.size("e")))  # a class's name has nothing to do with vec_id, which may repeat
    sizes = {r["dim"]: r["n"] for r in classes.groupBy("dim").agg(F.count("*").alias("n")).toLocalIterator()}  # one row a length
    if not sizes:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = reduce(DataFrame.union, [_found(classes.where(F.col("dim") == dim), n, dim, least, kind) for dim, n in sorted(sizes.items())])
    links = found.groupBy("rep").agg(F.sum("n").alias("n"))
    of = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    found_of = classes.select("h1", "h2", "copies", "rep", "least").join(links, "rep", "left").join(of, F.col("rep") == F.col("node"), "left")
    named = cut(found_of.select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("c"), "least"))
    smallest = named.groupBy("c").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    linked = join_hot(named, smallest, "c", named.count()).select("h1", "h2", "n_links", "component_id")
    out = rows.select("vec_id", "h1", "h2", F.col("e").isNotNull().alias("valid")).join(linked, ["h1", "h2"], "left").withColumn("linked", F.col("valid") & F.col("n_links").isNotNull())
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("vec_id"))
    return out.select("vec_id", F.when(F.col("linked"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _found(classes: DataFrame, n: int, dim: int, least: float, kind: str) -> DataFrame:
    """rep, n (vectors of other classes linked), root of the n classes, whose vectors have dim components."""
    spark = classes.sparkSession
    lists = int(min(LISTS, max(1, n**0.5)))
    share = min(1.0, SAMPLE / n)
    sample = classes.where(F.pmod("h2", F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("e").toArrow()
    x = sample["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if sample.num_rows else np.ones((1, dim))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    q = Quantiser(x, lists)
    sent = spark.sparkContext.broadcast(q)
    radius = float(np.sqrt(max(0.0, 2 - 2 * least)))

    def unit_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        return raw, raw / np.linalg.norm(raw, axis=1, keepdims=True)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                raw, unit = unit_of(b.column(2))
                near, away = sent.value.file(unit)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in raw.astype(kind)]), pa.array(near, pa.int32()), pa.array(away)], names=["rep", "copies", "vec", "list", "away"])

    filed = cut(classes.select("rep", "copies", "e").mapInArrow(file, "rep long, copies long, vec binary, list int, away double"))
    stats = list(filed.groupBy("list").agg(F.count("*").alias("n"), F.max("away").alias("far")).toLocalIterator())  # one row a list
    far = np.full(len(q.coarse), -np.inf)
    far[[r["list"] for r in stats]] = [r["far"] for r in stats]
    bins = Bins(q, {r["list"]: r["n"] for r in stats}, dim)
    placed = spark.sparkContext.broadcast((bins, far))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each vector as filed in its bin for each share of the queries, and as a query to each bin that it probes."""
        bins, far = placed.value
        for b in batches:
            for start in range(0, b.num_rows, BLOCK):
                c = b.slice(start, BLOCK)
                raw = np.frombuffer(b"".join(c.column(2).to_pylist()), kind).reshape(-1, dim).astype(float)
                rep, of = c.column(0).to_numpy(), c.column(3).to_numpy()
                probed = sent.value.probes(raw / np.linalg.norm(raw, axis=1, keepdims=True), radius, far)
                i, k = np.nonzero(probed.astype(np.float32) @ bins.has > 0)
                share = _mixed(~rep) % bins.n
                at = np.concatenate([np.repeat(np.arange(len(rep)), bins.n), i])
                bin_ = np.concatenate([np.repeat(bins.of(of, rep), bins.n), k])
                part = np.concatenate([np.tile(np.arange(bins.n), len(rep)), share[i]])
                is_filed = np.arange(len(at)) < len(rep) * bins.n
                cols = [c.column(m).take(pa.array(at)) for m in range(4)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(bin_, pa.int32()), pa.array(part, pa.int32()), pa.array(is_filed)], names=["rep", "copies", "vec", "list", "bin", "part", "filed"])

    dealt = filed.mapInArrow(deal, "rep long, copies long, vec binary, list int, bin int, part int, filed boolean")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        return _search(pdf, sent.value, least, radius, placed.value[1], dim, kind)

    return cut(dealt.groupBy("bin", "part").applyInPandas(search, "rep long, n long, root long"))


def op4_embed_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector of the table."""
    return near_duplicates(read(spark, sf_dir, "embeddings"))


OP4_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum([x * x FOR x IN e]) > 0),
link AS (SELECT a.vec_id AS u, b.vec_id AS w FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach(s, t) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.s, l.w FROM reach r JOIN link l ON l.u = r.t)
SELECT v.vec_id, (SELECT count(*) FROM link WHERE u = v.vec_id) AS n_links, min(r.t) AS component_id, min(r.t) = v.vec_id AS kept
FROM v JOIN reach r ON r.s = v.vec_id GROUP BY v.vec_id
"""
