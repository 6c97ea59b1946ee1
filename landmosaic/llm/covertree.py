"""Exact cosine links by cover trees: nested levels with halving radii and a dual traversal of node pairs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_batches, written
from .graph import components, forest

RADII = (2.0, 1.0, 0.5, 0.25, 0.125, 0.0)
EPS = 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


@cache
def _turn(dim: int) -> np.ndarray:
    """A random orthogonal matrix that depends on the dimension alone."""
    return np.linalg.qr(np.random.default_rng(17).standard_normal((dim, dim)))[0]


def _distance(cos: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cos))


def net(x: np.ndarray, radius: float, start: np.ndarray) -> np.ndarray:
    """Positions of a net of x: the start positions stay, and every row is within the radius of a chosen one."""
    if radius <= 0:
        return np.arange(len(x))
    best = np.full(len(x), np.inf)
    for i in range(0, len(start), 512):
        best = np.minimum(best, _distance(x @ x[start[i : i + 512]].T).min(axis=1))
    chosen = list(start)
    for i in range(len(x)):
        if best[i] > radius:
            chosen.append(i)
            best = np.minimum(best, _distance(x @ x[i]))
        if i == 511 and len(chosen) > 480 < 0.9 * len(x):  # hardly two rows this near: every row is its own centre
            return np.concatenate([start, np.setdiff1d(np.arange(len(x)), start)])
    return np.array(chosen, int)


class CoverTree:
    """Levels of centres, each nested in the next finer one; every node knows its parent and its covering radius.

    A node of the last level is one row (radius 0). A level is left out if it has as many nodes as the next one.
    """

    def __init__(self, x: np.ndarray):
        self.x = x
        front = max(1, -(-x.shape[1] // 4))
        turned = x @ _turn(x.shape[1])
        self.front = np.hstack([turned[:, :front], np.sqrt((turned[:, front:] ** 2).sum(axis=1))[:, None]])
        levels = [np.zeros(1, int)]
        for radius in RADII[1:]:
            levels.append(net(x, radius, levels[-1]))
            if len(levels[-1]) > 0.8 * len(x):
                levels[-1] = np.concatenate([levels[-2], np.setdiff1d(np.arange(len(x)), levels[-2])])
                break
        self.levels = levels
        self.parents = [np.zeros(1, int)]
        for coarse, fine in zip(levels, levels[1:]):
            parent = np.empty(len(fine), int)
            for i in range(0, len(fine), 1024):
                parent[i : i + 1024] = (x[fine[i : i + 1024]] @ x[coarse].T).argmax(axis=1)
            parent[: len(coarse)] = np.arange(len(coarse))
            self.parents.append(parent)
        # from the rows upwards: which node of each level holds a row, and how far its farthest row is
        at = np.empty(len(x), int)
        at[levels[-1]] = np.arange(len(levels[-1]))
        self.node_of, self.radius = [at], [np.zeros(len(levels[-1]))]
        for depth in range(len(levels) - 1, 0, -1):
            at = self.parents[depth][at]
            far = _distance((x * x[levels[depth - 1][at]]).sum(axis=1))
            radius = np.zeros(len(levels[depth - 1]))
            np.maximum.at(radius, at, far)
            self.node_of.insert(0, at)
            self.radius.insert(0, radius)


def _close(a: CoverTree, p: np.ndarray, b: CoverTree, q: np.ndarray, cosine: float, seen: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Which of the pairs (p of a, q of b) have a cosine of at least the threshold, 65,536 at a time."""
    if seen is not None:
        seen[1] += len(p)
    hit = np.concatenate([np.zeros(0, bool)] + [(a.x[p[i : i + 65536]] * b.x[q[i : i + 65536]]).sum(axis=1) >= cosine for i in range(0, len(p), 65536)])
    return p[hit], q[hit]


def dual(a: CoverTree, b: CoverTree, cosine: float, same: bool, rows: int = 1024, seen: list | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row positions (i of a, j of b) with a cosine of at least the threshold, in bounded batches.

    Node pairs go down level by level; a pair is pruned once its centres are farther apart than the link distance
    plus both covering radii, since no row below it can link. Pairs of rows that are left are bounded first by a quarter of
    the rotated columns: the cosine is at most their dot product plus the product of the norms of the rest. Only pairs
    over that bound are computed whole. `seen` counts [pairs of rows bounded, pairs computed]. If a and b are the same tree, i < j.
    """
    reach = np.sqrt(2 - 2 * cosine)
    depth = max(len(a.levels), len(b.levels))
    at = lambda t, d: min(d, len(t.levels) - 1)
    alive = np.ones((1, 1), bool)
    for d in range(depth):
        i, j = at(a, d), at(b, d)
        left = a.parents[i] if d and at(a, d - 1) != i else np.arange(len(a.levels[i]))
        right = b.parents[j] if d and at(b, d - 1) != j else np.arange(len(b.levels[j]))
        last = d == depth - 1
        grown = None if last else np.zeros((len(left), len(right)), bool)
        y = b.x[b.levels[j]]
        for s in range(0, len(left), rows):
            parents = alive[left[s : s + rows]]
            live = np.flatnonzero(parents.any(axis=0)[right])
            if not len(live):
                continue
            if last:
                own, other = a.levels[i][s : s + rows], b.levels[j][live]
                bound = a.front[own] @ b.front[other].T
                if seen is not None:
                    seen[0] += bound.size
                p, q = np.nonzero(bound >= cosine - EPS)
                there = parents[p, right[live][q]]
                p, q = own[p[there]], other[q[there]]
                if same:
                    p, q = p[p < q], q[p < q]
                p, q = _close(a, p, b, q, cosine, seen)
                if len(p):
                    yield p, q
            else:
                cos = a.x[a.levels[i][s : s + rows]] @ y[live].T
                near = _distance(cos) <= reach + a.radius[i][s : s + rows, None] + b.radius[j][live] + EPS
                grown[s : s + rows, live] = near & parents[:, right[live]]
        if not last:
            alive = grown
            if not alive.any():
                return


def _matrix(blob: bytes, dim: int, kind: str) -> np.ndarray:
    return unit(np.frombuffer(blob, kind).reshape(-1, dim))


def _traverse(cosine: float, kind: str):
    """For each pair of blocks: how many linked vectors each row has in the other block, and a spanning forest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees: dict[str, CoverTree] = {}

        def tree(key: str, vec: bytes, dim: int) -> CoverTree:
            if key not in trees:
                if len(trees) >= 12:
                    trees.pop(next(iter(trees)))
                trees[key] = CoverTree(_matrix(vec, dim, kind))
            return trees[key]

        for pdf in batches:
            for key_a, key_b, ids_a, ids_b, many_a, many_b, vec_a, vec_b, dim in zip(*(pdf[c] for c in ("key_a", "key_b", "ids_a", "ids_b", "many_a", "many_b", "vec_a", "vec_b", "dim"))):
                ids_a, ids_b = np.asarray(ids_a), np.asarray(ids_b)
                many_a, many_b = np.asarray(many_a), np.asarray(many_b)
                same = key_a == key_b
                tree_a, tree_b = tree(key_a, vec_a, dim), tree(key_b, vec_b, dim)
                n = len(ids_a)
                count_a, count_b = np.zeros(n, np.int64), np.zeros(len(ids_b), np.int64)

                def add(p, q):
                    at, to = (q, count_a) if same else (q - n, count_b)
                    count_a[:] += np.bincount(p, many_b[at], n).astype(np.int64)
                    to[:] += np.bincount(at, many_a[p], len(to)).astype(np.int64)

                pairs = dual(tree_a, tree_b, cosine, same)
                root = forest(n if same else n + len(ids_b), pairs if same else ((p, q + n) for p, q in pairs), add)
                ids = ids_a if same else np.concatenate([ids_a, ids_b])
                count = count_a if same else np.concatenate([count_a, count_b])
                found = np.flatnonzero(count)
                yield pd.DataFrame({"vec_id": ids[found], "links": count[found], "root": ids[root[found]]})

    return run


def _centres(sample: np.ndarray, most: int) -> np.ndarray:
    """The coarsest levels of a cover tree of the sample, as long as they have at most so many nodes."""
    chosen = np.zeros(1, int)
    for radius in (1.4, 1.2, 1.0, 0.7, 0.5, 0.25):
        finer = net(sample, radius, chosen)
        if len(finer) > most:
            break
        chosen = finer
    return sample[chosen]


def usable(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is neither null, empty or zero nor holds null or non-finite components."""
    v = F.col(column).cast("array<double>")
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(v.isNotNull() & finite & F.exists(v, lambda x: x != 0))


def sampled(df: DataFrame, number: Column, total: int, sample: int) -> DataFrame:
    """About `sample` of the `total` rows, those whose number (a 64-bit hash) is under a threshold; at most twice as many."""
    share = min(1.0, sample / max(1, total))
    return df.where(F.pmod(number, F.lit(1 << 30)) < int(share * (1 << 30))).limit(2 * sample) if share < 1 else df.limit(2 * sample)


def embedding_links(df: DataFrame, cosine: float = 0.95, block: int = 4096, sample: int = 8192) -> DataFrame:
    """One row per row of df (vec_id, embedding): vec_id, n_links, component_id, kept.

    Vectors link if their cosine in double precision is at least the threshold.

    1. Equal vectors are collapsed to one with a multiplicity, so copies are never paired.
    2. The coarse levels of a cover tree over a bounded sample (about `sample` vectors by a threshold on a hash) give cell
       centres (as many as blocks, at most a quarter of the sample; broadcast). Each vector goes to its nearest centre; each cell has a covering radius.
       Large cells are dealt into blocks of about `block` vectors, so no task holds a whole cell.
    3. Cell pairs are pruned by the covering-radius bound; the blocks of the others are joined pair by pair.
    4. Each block pair is traversed by two cover trees (nested levels, halving radii). It returns counts and
       a spanning forest, at most one row per vector, never the pairs themselves.
    5. Counts are summed; star components join the forests; both are joined back to all rows.

    Vectors of different lengths never link. Unusable vectors (see usable()): 0 links, own component. A null vec_id:
    not linked, component_id null, kept. Rows that repeat a vec_id with equal vectors count once. Empty table: no rows.
    """
    spark = df.sparkSession
    kind = "<f4" if "float" in df.schema["embedding"].dataType.simpleString() else "<f8"
    rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = usable(rows.where("vec_id is not null"), "v").select("vec_id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))
    distinct = good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.countDistinct("vec_id").alias("many"))
    distinct = written(distinct.withColumn("dim", F.size("v")))

    total = distinct.count()
    picked = sampled(distinct, F.xxhash64("v"), total, sample).select("v").toPandas()["v"]
    by_dim: dict[int, list] = {}
    for v in picked:
        by_dim.setdefault(len(v), []).append(v)
    most = int(min(sample // 4, max(1, total // block)))
    centres = {d: _centres(unit(np.array(vs)), most) for d, vs in by_dim.items()}

    def assign(batches):
        for pdf in batches:
            cell, far = np.zeros(len(pdf), np.int64), np.full(len(pdf), 2.0)
            for d, at in pdf.groupby("dim").indices.items():
                if d in centres:
                    x = unit(np.stack(pdf["v"].to_numpy()[at]))
                    cos = x @ centres[d].T
                    cell[at], far[at] = cos.argmax(axis=1), _distance(cos.max(axis=1))
            yield pdf.drop(columns="v").assign(blob=[np.asarray(v, kind).tobytes() for v in pdf["v"]], cell=cell, far=far)

    placed = written(in_batches(distinct, assign, "rep long, many long, dim int, blob binary, cell long, far double"))
    cells = placed.groupBy("dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).toPandas()
    cells["blocks"] = np.maximum(1, -(-cells["n"] // block))
    reach = np.sqrt(2 - 2 * cosine)
    pairs, tasks = [], 0
    for d, part in cells.groupby("dim"):
        c = part["cell"].to_numpy()
        x = centres[d][c] if d in centres else np.zeros((len(c), d))
        gap = _distance(x @ x.T)
        far = part["far"].to_numpy()
        near = (gap <= reach + far[:, None] + far + EPS) if d in centres else np.ones_like(gap, bool)
        for i, j in zip(*np.nonzero(np.triu(near))):
            pairs.append((int(d), int(c[i]), int(c[j]), int(part["blocks"].iloc[i]), int(part["blocks"].iloc[j])))
            tasks += pairs[-1][3] * pairs[-1][4]
    names = spark.createDataFrame([(int(r.dim), int(r.cell), int(r.blocks)) for r in cells.itertuples()], "dim int, cell long, blocks long")
    key = F.concat_ws("-", "dim", "cell", F.pmod(F.xxhash64("rep"), "blocks"))
    keyed = placed.join(F.broadcast(names), ["dim", "cell"]).select(key.alias("key"), "dim", "rep", "many", "blob")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        return pd.DataFrame({"key": [pdf["key"].iloc[0]], "dim": [pdf["dim"].iloc[0]], "ids": [pdf["rep"].to_numpy()], "many": [pdf["many"].to_numpy()], "vec": [b"".join(pdf["blob"])]})

    blocks = written(keyed.groupBy("key").applyInPandas(pack, "key string, dim int, ids array<long>, many array<long>, vec binary"))
    cell_pairs = spark.createDataFrame(pairs or [], "dim int, ca long, cb long, na long, nb long")
    grid = cell_pairs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("na") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).where("ca != cb or i <= j")
    grid = grid.select(F.concat_ws("-", "dim", "ca", "i").alias("key_a"), F.concat_ws("-", "dim", "cb", "j").alias("key_b"))
    side = lambda s: blocks.select(F.col("key").alias(f"key_{s}"), F.col("ids").alias(f"ids_{s}"), F.col("many").alias(f"many_{s}"), F.col("vec").alias(f"vec_{s}"), *([F.col("dim")] if s == "a" else []))
    matched = grid.join(side("a"), "key_a").join(side("b"), "key_b").repartition(min(100_000, tasks // 4 + 1), "key_a", "key_b")
    found = written(in_batches(matched, _traverse(cosine, kind), "vec_id long, links long, root long"))

    sums = written(found.groupBy("vec_id").agg(F.sum("links").alias("links")))
    label = components(found.where("vec_id != root").select(F.col("vec_id").alias("u"), F.col("root").alias("v")))
    known = distinct.select("v", "rep", "many").join(sums.withColumnRenamed("vec_id", "rep"), "rep", "left").join(label.withColumnRenamed("node", "rep"), "rep", "left")
    known = known.select("v", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id"))
    known = written(known.withColumn("mark", F.sha2(F.col("v").cast("string"), 256)).drop("v"))
    marked = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("mark", F.sha2(F.col("v").cast("string"), 256)).select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("mark")).alias("mark"))
    out = marked.join(known, "mark", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
