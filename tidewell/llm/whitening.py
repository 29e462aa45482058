"""Embedding whitening by a matrix-free block Lanczos iteration.

The covariance is never built. A round sends a block of directions to all tasks, each returns its part of
Xc'(Xc Q) for its centred rows Xc, and Spark adds the parts up by dimension: dim rows of a block's width a
task. The driver keeps an orthonormal basis, held against all of it twice at each round (full
reorthogonalisation), and the images of the basis, so the residuals of the Ritz vectors are what they are
and decide when to stop. Directions that a block has lost are replaced by random ones; a basis of COLUMNS is
shortened to its best Ritz vectors.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import cut, read, small_batches

#: Steps of a vector's entries in 1, and what is added to them.
STEPS, OFFSET = 64, 1_000_000
#: Components, further directions of a block, columns of a basis at most (or two blocks, if they are more).
COMPONENTS, EXTRA, COLUMNS = 32, 8, 1024
#: Greatest residual and least eigenvalue of a component, both as shares of the greatest eigenvalue; rounds at most.
RESIDUAL, RANK, ROUNDS = 1e-13, 1e-12, 2000
#: Entries beyond this count as it; whole numbers of 64 bits hold sums below SAFE.
MOST, SAFE = 1 << 62, 1 << 62

WHITENED = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _independent(block: np.ndarray, basis: np.ndarray, least: float) -> np.ndarray:
    """An orthonormal basis of what block adds to basis, but for what is at most least."""
    for _ in range(2):
        block = block - basis @ (basis.T @ block)
    u, size, _ = np.linalg.svd(block, full_matrices=False)
    u = u[:, size > least]
    for _ in range(2):
        u = u - basis @ (basis.T @ u)
    return np.linalg.qr(u)[0]


def block_lanczos(apply: Callable[[np.ndarray], np.ndarray], dim: int, want: int, columns: int = COLUMNS, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The want greatest eigenvalues, falling, and unit eigenvectors of a symmetric matrix of dim rows, of which apply(q) tells the product with q.

    Ends when each residual is at most RESIDUAL of the greatest eigenvalue, or the basis spans the space.
    """
    want = min(want, dim)
    width = min(dim, want + EXTRA)
    columns = max(columns, 2 * width + want)
    rng = np.random.default_rng(seed)
    basis = image = np.zeros((dim, 0))
    block = np.linalg.qr(rng.normal(size=(dim, width)))[0]
    for _ in range(ROUNDS):
        basis, image = np.hstack([basis, block]), np.hstack([image, apply(block)])
        inner = basis.T @ image
        values, s = np.linalg.eigh((inner + inner.T) / 2)
        values, s = values[::-1], s[:, ::-1]
        ritz = basis @ s[:, :want]
        residual = np.linalg.norm(image @ s[:, :want] - ritz * values[:want], axis=0)
        if basis.shape[1] == dim or residual.max(initial=0) <= RESIDUAL * abs(values).max(initial=0):
            return values[:want], ritz / np.linalg.norm(ritz, axis=0)
        least = RESIDUAL * abs(values).max()
        ahead = _independent(image[:, -block.shape[1] :], basis, least)
        if basis.shape[1] + width > columns:  # the residuals of all Ritz vectors lie in the next block, whatever is left out
            basis, image = basis @ s[:, : want + width], image @ s[:, : want + width]
        missing = min(width, dim - basis.shape[1]) - ahead.shape[1]
        if missing > 0:  # a breakdown: go on in directions not met so far
            both = np.hstack([basis, ahead])
            ahead = np.hstack([ahead, _independent(rng.normal(size=(dim, missing)), both, 0.0)])
        block = ahead[:, : dim - basis.shape[1]]
    raise RuntimeError(f"block Lanczos did not settle in {ROUNDS} rounds")


def stepped(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array<long>): the vectors in whole steps, without those that are null, empty or hold null or non-finite entries."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    good = F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & (F.size("e") > 0)
    step = F.transform("e", lambda v: F.greatest(F.least(F.floor(v * STEPS), F.lit(MOST)), F.lit(-MOST)) + F.lit(OFFSET))
    return vectors.select("vec_id", e.alias("e")).where(good).select("vec_id", step.alias("x"))


def _flat(col: pa.Array, dim: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summed(x: DataFrame, dim: int, of: Callable[[np.ndarray], np.ndarray], rows: int, width: int) -> np.ndarray:
    """The sum over all tasks of of(vectors): so many rows and columns of numbers. Spark adds them up row by row."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((rows, width))
        for b in batches:
            if b.num_rows:
                total += of(_flat(b.column(0), dim))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows), pa.int32()), *(pa.array(c) for c in total.T)], names=["i", *(f"v{k}" for k in range(width))])

    parts = x.select("x").mapInArrow(part, ", ".join(["i int", *(f"v{k} double" for k in range(width))]))
    out = np.zeros((rows, width))
    for r in parts.groupBy("i").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(width))).collect():  # one job; toLocalIterator() starts one a partition
        out[r[0]] = r[1:]
    return out


def _sums(x: DataFrame, dim: int) -> list[int]:
    """The exact sum of each dimension."""

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * dim
        for b in batches:
            v = _flat(b.column(0), dim)
            if len(v):
                exact = v if int(np.abs(v).max()) * len(v) < SAFE else v.astype(object)
                total = [a + int(s) for a, s in zip(total, exact.sum(axis=0))]
        yield pa.RecordBatch.from_pydict({"i": pa.array(range(dim), pa.int32()), "s": pa.array([str(t) for t in total])})

    rows = x.select("x").mapInArrow(part, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return [int(s) for _, s in sorted((r["i"], r["s"]) for r in rows)]


@dataclass
class Whitening:
    """What the vectors of one length are whitened by. directions: unit eigenvectors as columns, by falling eigenvalue."""

    n: int
    sums: list[int]
    directions: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def differences(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        safe = self.n * max(int(np.abs(x).max(initial=0)), 1) < SAFE
        return self.n * x - np.array(self.sums) if safe else self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (self.differences(x) / self.n).astype(float)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of the squared differences of each vector; null if it is no number of 64 bits."""
        d = self.differences(x)
        exact = d if d.dtype != object and d.shape[1] * int(np.abs(d).max(initial=0)) ** 2 < SAFE else d.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (exact * exact).sum(axis=1)]

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """A column for each component."""
        return self.centred(x) @ self.directions / np.sqrt(self.values)

    def rows(self, vectors: DataFrame) -> DataFrame:
        """vec_id and the columns of WHITENED for each row of vectors (vec_id, x) and component."""
        k, dim = len(self.values), len(self.sums)
        share = self.values / self.trace if k else self.values

        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows and k:
                    x, m = _flat(b.column(1), dim), b.num_rows * k
                    at = pa.array(np.repeat(np.arange(b.num_rows), k))
                    columns = [
                        b.column(0).take(at),
                        pa.array(np.tile(np.arange(1, k + 1), b.num_rows), pa.int32()),
                        pa.array(np.full(m, self.n)),
                        pa.array(self.deviations(x), pa.int64()).take(at),
                        pa.array(self.whiten(x).ravel()),
                        pa.array(np.tile(share, b.num_rows)),
                        pa.array(np.full(m, self.identity_error)),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, names=["vec_id", *(c.split()[0] for c in WHITENED.split(", "))])

        return vectors.mapInArrow(of, f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, {WHITENED}")


def fit(x: DataFrame, n: int, dim: int, components: int = COMPONENTS) -> Whitening:
    """The whitening of the n vectors of x (x: array<long> of dim entries), by passes over all of them.

    A component whose eigenvalue is at most RANK of the greatest is none: vectors in fewer dimensions, or
    fewer vectors than components, have fewer. Equal vectors have none at all.
    """
    w = Whitening(n, _sums(x, dim), np.zeros((dim, 0)), np.zeros(0), 0.0, 0.0)
    w.trace = float(_summed(x, dim, lambda v: np.array([[(w.centred(v) ** 2).sum()]]), 1, 1)[0, 0]) / n
    if not w.trace:
        return w

    def product(q: np.ndarray) -> np.ndarray:
        def of(v: np.ndarray) -> np.ndarray:
            c = w.centred(v)
            return c.T @ (c @ q)

        return _summed(x, dim, of, dim, q.shape[1]) / n

    values, directions = block_lanczos(product, dim, components)
    directions = directions[:, values > RANK * values[0]]
    k = directions.shape[1]

    def moments(v: np.ndarray) -> np.ndarray:
        y = w.centred(v) @ directions
        return np.vstack([y.T @ y, y.sum(axis=0)])

    found = _summed(x, dim, moments, k + 1, k) / n  # of the projections themselves: small eigenvalues lose nothing to great ones
    covariance = found[:k] - np.outer(found[k], found[k])
    values = np.diag(covariance)
    error = np.abs(covariance / np.sqrt(np.outer(values, values)) - np.eye(k)).max()
    order = np.argsort(-values, kind="stable")
    w.directions, w.values, w.identity_error = directions[:, order], values[order], float(error)
    return w


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id and the columns of WHITENED for each row of vectors (vec_id, embedding) and component.

    Rows whose vector is null, empty or holds null or non-finite entries are left out. Vectors of each length
    are fitted and whitened by themselves; n counts those of a row's length. Rows that repeat a vec_id, or
    have none, count and are returned each. Entries beyond 2 ** 62 steps count as that.
    """
    table = cut(stepped(vectors))
    sizes = {r["dim"]: r["n"] for r in table.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n")).collect()}  # one row a length
    parts = [(table.where(F.size("x") == dim), n, dim) for dim, n in sorted(sizes.items())]
    out = [fit(x, n, dim, components).rows(x) for x, n, dim in parts]
    return reduce(DataFrame.union, out) if out else table.sparkSession.createDataFrame([], f"vec_id {table.schema['vec_id'].dataType.simpleString()}, {WHITENED}")


def op11_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of every vector and component of the table."""
    small_batches(spark)
    return whitened(read(spark, sf_dir, "embeddings"))
