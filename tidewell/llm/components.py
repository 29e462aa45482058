"""Connected components by alternating large-star and small-star rounds; few links go to one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.common import cut, forget, join_hot


#: Distinct links (16 bytes each) up to which one task joins them; beyond, rounds over all tasks do. The result is the same.
ONE_TASK = 500_000


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links (a, b) reach, itself included."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        while True:
            jumped = root[root]
            if np.array_equal(jumped, root):
                break
            root = jumped
        if np.array_equal(before, root):
            break
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    return root


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.union(edges.select("v", "u"))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count("*").alias("n"))
    return join_hot(both.where("v > u"), low, "u", 2 * total).select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    turned = join_hot(edges, low, "u", total).where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return turned.union(low.select("u", F.col("m").alias("v")))


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, component of all links of a task."""
    parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    u, v = (np.concatenate([p[k] for p in parts] or [np.zeros(0, dtype=np.int64)]) for k in (0, 1))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    root = local_roots(len(ids), at[: len(u)], at[len(u) :])
    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[root])], names=["node", "component"])


def components(links: DataFrame, max_rounds: int = 60, one_task: int | None = None) -> DataFrame:
    """node, component of every node of links (u, v): long; component is the smallest node reachable.

    Each round is two aggregations, whose partial sums take up hot nodes, and two joins, which hot nodes
    meet by broadcast. Links are held as a table in the shared folder from round to round. Links that are
    counted to be at most one_task (by default ONE_TASK) go to one task instead. Null ends and loops are
    ignored; repeated links count once.
    """
    edges = cut(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.count() <= (ONE_TASK if one_task is None else one_task):
        return edges.coalesce(1).mapInArrow(_joined, "node long, component long")
    state = None
    for _ in range(max_rounds):
        now = edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)")), F.max("v")).first()
        if now == state or not now[0]:
            break
        state = now
        large = cut(_large_star(edges, now[0]))
        forget(edges)
        edges = cut(_small_star(large, now[0]).distinct())
        forget(large)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
