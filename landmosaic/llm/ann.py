"""Nearest neighbours by an adaptive dimension scan: probed lists, rotated column blocks, early hypothesis tests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, written
from .covertree import sampled, unit, usable

SLACK = 1e-9


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix that depends on the dimension and the seed alone."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def spherical_kmeans(x: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit rows; an empty list takes the row that is farthest from its own centroid."""
    c = x[np.random.default_rng(3).choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(rounds):
        cos = x @ c.T
        home = cos.argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, home, x)
        size = np.sqrt((sums * sums).sum(axis=1))
        empty = np.flatnonzero(size < 1e-12)
        far = np.argsort(cos.max(axis=1))[: len(empty)]
        sums[empty], size[empty] = x[far], 1
        c = sums / size[:, None]
    return c


def probes_for(x: np.ndarray, c: np.ndarray, k: int, target: float, held_out: int = 512) -> int:
    """How many lists a query must probe so that the target share of its k nearest lies in them, on the sample."""
    q = x[:held_out]
    cos = q @ x.T
    cos[np.arange(len(q)), np.arange(len(q))] = -2
    near = np.argsort(-cos, axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort(-(q @ c.T), axis=1).argsort(axis=1)
    home = (x @ c.T).argmax(axis=1)
    ranks = np.sort(np.take_along_axis(order, home[near], axis=1).ravel())
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1 if len(ranks) else 1


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two each, so that squares of very large or small components stay finite; cosines don't change."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def adaptive_scan(x: np.ndarray, q: np.ndarray, tau: np.ndarray, steps: int = 4, z: float = 2.6, seen: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) whose distance may be within the query's threshold tau (a distance).

    x and q are rows rotated at random. Of a squared distance, the part in m of D random directions is a Beta(m/2, (D-m)/2)
    share: mean m/D, variance 2m(D-m) / (D^2 (D+2)). After each block of columns, pairs whose partial squared distance is over
    tau^2 times the mean and z deviations are abandoned: the hypothesis that they are within tau is rejected. The last
    block decides by the whole distance. `seen` gets the number of pairs left after each block.
    """
    dim = x.shape[1]
    cuts = np.unique(np.linspace(0, dim, steps + 1).astype(int))
    part = np.zeros((len(q), len(x)))
    pairs = None
    for lo, hi in zip(cuts, cuts[1:]):
        a, b = q[:, lo:hi], x[:, lo:hi]
        bound = tau**2 * (hi / dim + z * np.sqrt(2 * hi * (dim - hi) / (dim + 2)) / dim) + SLACK
        if pairs is None:
            part += (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
            keep = part <= bound[:, None]
            if hi == dim or keep.mean() < 0.3:
                i, j = np.nonzero(keep)
                pairs, rest = (i, j), part[i, j]
            left = int(keep.sum())
        else:
            i, j = pairs
            d = a[i] - b[j]
            rest = rest + (d * d).sum(axis=1)
            keep = rest <= bound[i]
            pairs, rest = (i[keep], j[keep]), rest[keep]
            left = len(rest)
        if seen is not None:
            seen.append(left)
    return pairs


def _cosines(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the pairs (row i of q, row j of x), 65,536 pairs at a time."""
    out = np.empty(len(i))
    nq, nx = np.sqrt((q * q).sum(axis=1)), np.sqrt((x * x).sum(axis=1))
    for p in range(0, len(i), 65536):
        a, b = i[p : p + 65536], j[p : p + 65536]
        out[p : p + 65536] = (q[a] * x[b]).sum(axis=1) / (nq[a] * nx[b])
    return out


def _best(i: np.ndarray, j: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query i, ties to the smaller id, in order of query and rank."""
    order = np.lexsort((ids[j], -score, i))
    i, j, score = i[order], j[order], score[order]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[top], j[top], score[top]


def _scan(k: int, dim: int, kind: str, rows: int = 1024, queries: int = 256):
    turn = rotation(dim)

    def found(ids, x, ux, qids, q, uq, tau):
        """The k best rows of each query; the threshold shrinks to the k-th best so far after each `rows` rows."""
        tau, best = tau.copy(), (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        for s in range(0, len(x), rows):
            i, j = adaptive_scan(ux[s : s + rows], uq, tau)
            j = j + s
            other = qids[i] != ids[j]
            i, j = i[other], j[other]
            best = _best(*(np.concatenate(c) for c in zip(best, (i, j, _cosines(q, x, i, j)))), ids, k)
            i, _, score = best
            full = np.flatnonzero(np.arange(len(i)) - np.searchsorted(i, i) == k - 1)
            tau[i[full]] = np.minimum(tau[i[full]], np.sqrt(np.maximum(0, 2 - 2 * score[full])))
        return best

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ids, vec, qids, qvec, tau in zip(pdf["ids"], pdf["vec"], pdf["qids"], pdf["qvec"], pdf["tau"]):
                ids, qids, tau = np.asarray(ids), np.asarray(qids), np.asarray(tau)
                x, q = (scaled(np.frombuffer(v, kind).reshape(-1, dim).astype(float)) for v in (vec, qvec))
                ux, uq = unit(x) @ turn, unit(q) @ turn
                for s in range(0, len(q), queries):
                    part = slice(s, s + queries)
                    i, j, score = found(ids, x, ux, qids[part], q[part], uq[part], tau[part])
                    yield pd.DataFrame({"query_id": qids[part][i], "vec_id": ids[j], "score": score})

    return run


def nearest(df: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096, chunk: int = 512, list_rows: int = 512, most_lists: int = 2048, sample: int = 8192, target: float = 0.98) -> DataFrame:
    """The k nearest rows of df (vec_id, embedding) for each row of queries (query_id, embedding), by cosine.

    Returns query_id, rank (from 1), vec_id, score: the cosine in double precision on the original vectors,
    best first, ties to the smaller vec_id. A row whose vec_id is the query_id is no candidate.

    1. A bounded sample (about `sample` vectors by a threshold on a hash, at most twice as many) gives about N / list_rows centroids (at most most_lists,
       broadcast) and, measured on the sample, the number of lists to probe for the target recall.
    2. Every vector goes to its list; lists are dealt into blocks of about `block` rows, so a hot list has many blocks.
       Queries go to the lists that they probe, in chunks of about `chunk`.
    3. Each block and chunk of a list meet once. Vectors are rotated and scanned in column blocks; a hypothesis test on
       the partial distance abandons candidates early (adaptive_scan). The threshold starts as the k-th best distance
       among at most 512 seeds of the sample, an upper bound of the true one, and shrinks to the k-th best found as a
       block is scanned; the k best seeds are candidates too.
    4. The k best of each block are merged by a ranked window, pre-ranked within tasks.

    Unusable vectors (null, zero, non-finite) take no part on either side; nor do null ids or lengths other than
    the commonest of the sample. Rows that repeat an id count once. Fewer than k candidates: all of those found.
    Empty tables give no rows.
    """
    spark = df.sparkSession
    kind = "<f4" if "float" in df.schema["embedding"].dataType.simpleString() else "<f8"
    rows = usable(df.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where("vec_id is not null"))
    asked = usable(queries.select(F.col("query_id").cast("long").alias("query_id"), "embedding").where("query_id is not null")).dropDuplicates(["query_id"])
    out = "query_id long, rank int, vec_id long, score double"

    total = rows.count()
    picked = sampled(rows, F.xxhash64("vec_id"), total, sample).toPandas()
    if not total:
        return spark.createDataFrame([], out)
    dim = int(picked["embedding"].map(len).mode()[0])
    picked = picked[picked["embedding"].map(len) == dim].drop_duplicates("vec_id")
    rows, asked = (x.where(F.size("embedding") == dim) for x in (rows, asked))
    x = unit(np.stack(picked["embedding"].to_numpy()))
    lists = int(min(most_lists, -(-total // list_rows), max(1, len(x) // 4)))
    centroids = spherical_kmeans(x, lists)
    probes = probes_for(x, centroids, k, target)
    seeds = min(len(x), 512, max(4 * k, total // 16))
    near_ids, near, plain = picked["vec_id"].to_numpy()[:seeds], x[:seeds], scaled(np.stack(picked["embedding"].to_numpy()[:seeds]).astype(float))

    def assign(batches):
        for pdf in batches:
            v = np.stack(pdf["embedding"].to_numpy()) if len(pdf) else np.zeros((0, dim))
            home = (unit(v) @ centroids.T).argmax(axis=1) if len(pdf) else []
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "vec": [a.astype(kind).tobytes() for a in v], "list": home})

    def probe(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            v = np.stack(pdf["embedding"].to_numpy())
            u = unit(v)
            order = np.argsort(-(u @ centroids.T), axis=1)[:, :probes]
            cos = u @ near.T
            cos[pdf["query_id"].to_numpy()[:, None] == near_ids] = -1
            kth = np.sort(cos, axis=1)[:, -k] if cos.shape[1] >= k else np.full(len(v), -1.0)
            tau = np.sqrt(np.maximum(0, 2 - 2 * kth))
            n = order.shape[1]
            yield pd.DataFrame({"query_id": np.repeat(pdf["query_id"].to_numpy(), n), "qvec": np.repeat(np.array([a.astype(kind).tobytes() for a in v], object), n), "tau": np.repeat(tau, n), "list": order.ravel()})

    def seeded(batches):
        """Each query's k best seeds: where the tests abandon true neighbours, it still gets k rows."""
        for pdf in batches:
            for s in range(0, len(pdf), 256):
                part = pdf.iloc[s : s + 256]
                v = np.stack(part["embedding"].to_numpy()).astype(float)
                i, j = np.nonzero(part["query_id"].to_numpy()[:, None] != near_ids)
                i, j, score = _best(i, j, _cosines(scaled(v), plain, i, j), near_ids, k)
                yield pd.DataFrame({"query_id": part["query_id"].to_numpy()[i], "vec_id": near_ids[j], "score": score})

    placed = written(in_batches(rows, assign, "vec_id long, vec binary, list long"))
    probed = written(in_batches(asked, probe, "query_id long, qvec binary, tau double, list long"))
    sizes = placed.groupBy("list").agg(F.count("*").alias("n")).join(probed.groupBy("list").agg(F.count("*").alias("q")), "list").toPandas()
    grid = [(int(r.list), int(-(-r.n // block)), int(-(-r.q // chunk))) for r in sizes.itertuples()]
    names = spark.createDataFrame(grid, "list long, nb long, nc long")
    tasks = sum(b * c for _, b, c in grid)

    def pack_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates(["vec_id", "vec"]).sort_values("vec_id")
        return pd.DataFrame({"key_b": [pdf["key"].iloc[0]], "ids": [pdf["vec_id"].to_numpy()], "vec": [b"".join(pdf["vec"])]})

    def pack_queries(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id")
        return pd.DataFrame({"key_c": [pdf["key"].iloc[0]], "qids": [pdf["query_id"].to_numpy()], "qvec": [b"".join(pdf["qvec"])], "tau": [pdf["tau"].to_numpy()]})

    salt = lambda col, n: F.concat_ws("-", "list", F.pmod(F.xxhash64(col), n)).alias("key")
    blocks = placed.join(F.broadcast(names), "list").select(salt("vec_id", "nb"), "vec_id", "vec").groupBy("key").applyInPandas(pack_rows, "key_b string, ids array<long>, vec binary")
    chunks = probed.join(F.broadcast(names), "list").select(salt("query_id", "nc"), "query_id", "qvec", "tau").groupBy("key").applyInPandas(pack_queries, "key_c string, qids array<long>, qvec binary, tau array<double>")
    meet = names.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("nc") - 1)))
    meet = meet.select(F.concat_ws("-", "list", "i").alias("key_b"), F.concat_ws("-", "list", "j").alias("key_c"))
    pairs = meet.join(blocks, "key_b").join(chunks, "key_c").repartition(min(100_000, tasks // 4 + 1), "key_b", "key_c")
    found = in_batches(pairs.select("ids", "vec", "qids", "qvec", "tau"), _scan(k, dim, kind), "query_id long, vec_id long, score double")
    found = found.union(in_batches(asked, seeded, "query_id long, vec_id long, score double"))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
