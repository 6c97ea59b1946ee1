"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, small, written


#: Edge tables within BROADCAST_ROWS (16 MB) are worked on in so few tasks.
FEW_TASKS = 8


def _star(edges: DataFrame, fold: Callable) -> DataFrame:
    """edges (u, v) with the least neighbour m of each u (u itself included).

    The minimum is pre-aggregated in each task and written. If it is small it is broadcast; else both sides of the join
    are shuffled by u, and a hot u (the hub of a large group) can be split by Spark's skew handling.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(small(written(fold(least))), "u")


def large_star(edges: DataFrame, fold: Callable = lambda df: df) -> DataFrame:
    """Each node connects its larger neighbours to the least node around it (an edge may come twice)."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both, fold).where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def small_star(edges: DataFrame, fold: Callable = lambda df: df) -> DataFrame:
    """Each node connects itself and its smaller neighbours to the least of them; edges run from larger u to smaller v."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    near = _star(down, fold)
    own = near.select("u", F.col("m").alias("v"))
    rest = near.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return own.union(rest).distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Rows (node, component_id) for every node that has an edge; component_id is the least node reachable.

    edges has long columns u and v in either direction; self-loops, repeated rows and nulls are ignored.
    Each round is written to the shared folder. Rounds end when the edges, all from a larger u to a smaller v, are stars:
    no node is both a u and a v, and no u has two edges. An empty edge table gives no rows.
    """
    now = written(edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    fold = (lambda df: df.coalesce(FEW_TASKS)) if now.count() <= BROADCAST_ROWS else (lambda df: df)
    for _ in range(rounds):
        inner = now.select(F.col("u").alias("v")).join(small(now.select("v")), "v", "left_semi")
        if inner.isEmpty() and now.groupBy("u").count().where("count > 1").isEmpty():
            break
        now = written(fold(small_star(written(fold(large_star(now, fold))), fold)))
    else:
        raise RuntimeError(f"components not stable after {rounds} rounds")
    leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component_id"))
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component_id")).distinct()
    return written(fold(leaves.union(roots)))


def forest(n: int, batches: Iterable[tuple[np.ndarray, np.ndarray]], add: Callable | None = None) -> np.ndarray:
    """Roots (least positions) of n rows joined by all batches of pairs, within a task; add(p, q) sees each batch."""
    root = np.arange(n)
    for p, q in batches:
        if add:
            add(p, q)
        while True:
            rp, rq = root[p], root[q]
            apart = rp != rq
            if not apart.any():
                break
            p, q, rp, rq = p[apart], q[apart], rp[apart], rq[apart]
            np.minimum.at(root, np.maximum(rp, rq), np.minimum(rp, rq))
            while (root[root] != root).any():
                root = root[root]
    return root
