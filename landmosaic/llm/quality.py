"""Quality classifier: attention-based multiple-instance learning over the passages of a document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batched, in_batches, written
from .shingles import stream, word_hashes

PASSAGE_WORDS = 64
_BUCKETS = 48
_BUCKET = (stream(41, 65536) % np.uint64(_BUCKETS)).astype(np.int64)
_KIND = np.full(256, 6, np.int64)  # 0 lower, 1 upper, 2 digit, 3 space, 4 line end, 5 other ASCII, 6 beyond ASCII
_KIND[:128] = 5
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[[9, 11, 12, 13, 32]], _KIND[10] = 0, 1, 2, 3, 4
_SPACE = (_KIND == 3) | (_KIND == 4)
WIDTH = 7 + _BUCKETS + 7


def encode(text: str | None) -> np.ndarray:
    """One row of WIDTH features for each passage of PASSAGE_WORDS words, over the whole text.

    Shares of character kinds, shares of hashed byte pairs (square roots), and word figures: mean and deviation of the
    length, share of distinct words, of words equal to the one before, of words seen in earlier passages, fullness.
    A text without words has one passage, whose last feature (the mark of emptiness) alone is 1.
    """
    words = word_hashes(text) if text else []
    if not len(words):
        out = np.zeros((1, WIDTH))
        out[0, -1] = 1
        return out
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    gap = _SPACE[raw]
    first = ~gap
    first[1:] &= gap[:-1]
    word = np.maximum(np.cumsum(first) - 1, 0)
    place = word // PASSAGE_WORDS
    n = int(place[-1]) + 1
    kinds = np.bincount(place * 7 + _KIND[raw], minlength=n * 7).reshape(n, 7)
    pair = raw[:-1].astype(np.int64) << 8 | raw[1:]
    pairs = np.bincount(place[1:] * _BUCKETS + _BUCKET[pair], minlength=n * _BUCKETS).reshape(n, _BUCKETS)
    size = np.bincount(word[~gap], minlength=len(words)).astype(float)
    at = np.arange(len(words)) // PASSAGE_WORDS
    count = np.bincount(at, minlength=n)
    mean = np.bincount(at, np.minimum(size, 50), n) / count
    square = np.bincount(at, np.minimum(size, 50) ** 2, n) / count
    order = np.lexsort((np.arange(len(words)), words))
    fresh = np.ones(len(words), bool)
    same = words[order][1:] == words[order][:-1]
    fresh[order[1:][same]] = False
    inside = np.ones(len(words), bool)
    inside[order[1:][same & (at[order][1:] == at[order][:-1])]] = False
    twice = np.concatenate([[False], words[1:] == words[:-1]])
    share = lambda x: np.bincount(at, x, n) / count
    figures = np.stack([mean / 10, np.sqrt(np.maximum(0, square - mean**2)) / 5, share(inside), share(twice), share(~fresh), count / PASSAGE_WORDS, np.zeros(n)], axis=1)
    return np.hstack([kinds / kinds.sum(axis=1, keepdims=True), np.sqrt(pairs / np.maximum(1, pairs.sum(axis=1, keepdims=True))), figures])


class GatedAttention:
    """h = tanh(xW); a = softmax over a bag of w . (tanh(hV) * sigmoid(hU)); score = sigmoid(c . sum(a h) + d)."""

    def __init__(self, width: int = WIDTH, hidden: int = 24, gate: int = 16, seed: int = 1):
        r = np.random.default_rng(seed)
        self.p = {"W": r.normal(0, width**-0.5, (width, hidden)), "b": np.zeros(hidden), "V": r.normal(0, hidden**-0.5, (hidden, gate)), "U": r.normal(0, hidden**-0.5, (hidden, gate)), "w": r.normal(0, gate**-0.5, gate), "c": r.normal(0, hidden**-0.5, hidden), "d": np.zeros(1)}
        self.mean, self.scale, self.constant = np.zeros(width), np.ones(width), None

    def _forward(self, x: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> dict:
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-h @ p["U"]))
        e = (v * u) @ p["w"]
        top = np.repeat(np.maximum.reduceat(e, starts), sizes)
        a = np.exp(e - top)
        a /= np.repeat(np.add.reduceat(a, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts)
        return {"h": h, "v": v, "u": u, "a": a, "z": z, "y": 1 / (1 + np.exp(-(z @ p["c"] + p["d"][0])))}

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if not bags or self.constant is not None:
            return np.full(len(bags), self.constant if self.constant is not None else 0.5)
        sizes = np.array([len(b) for b in bags])
        return self._forward((np.vstack(bags) - self.mean) / self.scale, np.cumsum(sizes) - sizes, sizes)["y"]

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.01, decay: float = 1e-4) -> GatedAttention:
        """Adam on the cross entropy of the bags' labels; the seed and the order of the bags fix the result."""
        if not len(labels) or len(set(labels)) < 2:
            self.constant = float(np.mean(labels)) if len(labels) else 0.5
            return self
        n = sum(map(len, bags))
        self.mean = sum(b.sum(axis=0, dtype=float) for b in bags) / n
        self.scale = np.sqrt(sum(((b - self.mean) ** 2).sum(axis=0) for b in bags) / n) + 1e-3
        one, two = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        r, t = np.random.default_rng(2), 0
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for s in range(0, len(order), batch):
                pick = order[s : s + batch]
                sizes = np.array([len(bags[i]) for i in pick])
                g, t = self._gradient((np.vstack([bags[i] for i in pick]) - self.mean) / self.scale, np.cumsum(sizes) - sizes, sizes, labels[pick]), t + 1
                for k, v in self.p.items():
                    grad = g[k] + decay * v
                    one[k] = 0.9 * one[k] + 0.1 * grad
                    two[k] = 0.999 * two[k] + 0.001 * grad * grad
                    v -= rate * (1 - epoch / epochs) * (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-8)
        return self

    def _gradient(self, x, starts, sizes, labels) -> dict:
        p, f = self.p, self._forward(x, starts, sizes)
        out = (f["y"] - labels) / len(labels)
        dz = np.repeat(out[:, None] * p["c"], sizes, axis=0)
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, starts), sizes))
        gate = de[:, None] * p["w"]
        dv, du = gate * f["u"] * (1 - f["v"] ** 2), gate * f["v"] * f["u"] * (1 - f["u"])
        dh = f["a"][:, None] * dz + dv @ p["V"].T + du @ p["U"].T
        pre = dh * (1 - f["h"] ** 2)
        return {"W": x.T @ pre, "b": pre.sum(axis=0), "V": f["h"].T @ dv, "U": f["h"].T @ du, "w": (f["v"] * f["u"]).T @ de, "c": f["z"].T @ out, "d": np.array([out.sum()])}


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, passages: int = 200_000) -> GatedAttention:
    """Fit on a bounded sample: the `sample` labelled documents that are first by a hash of their doc_id, with all their passages.

    Of these, documents of over a hundredth of `passages` (2,000, or 128,000 words) are left out of the fit, and the others are taken by
    that hash until they have `passages` in all (4 * WIDTH bytes each on the driver), so long texts can't fill its memory. labels has doc_id and quality; rows with
    other values than 0 and 1 don't count, and of several labels of a document the lower one does; of rows that repeat a doc_id, the
    least encoded one. Without labels the score is 0.5, with labels of one kind their mean.
    """
    good = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picked = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def bags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "quality": pdf["quality"], "bag": [encode(t).astype("<f4").tobytes() for t in pdf["text"]]})

    rows = in_batches(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"), bags, "doc_id long, quality int, bag binary")
    rows = written(rows.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("bag").alias("bag")))
    sizes = rows.select("doc_id", (F.length("bag") / (4 * WIDTH)).alias("n_")).where(F.col("n_") * 100 <= passages)
    running = F.sum("n_").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most `sample` rows of two numbers
    taken = sizes.withColumn("run_", running).where(F.col("run_") <= passages).select("doc_id")
    chosen = rows.join(F.broadcast(taken), "doc_id").toPandas().sort_values("doc_id")
    return GatedAttention().fit([np.frombuffer(b, "<f4").reshape(-1, WIDTH) for b in chosen["bag"]], chosen["quality"].to_numpy(float))


def scored(docs: DataFrame, model: GatedAttention) -> DataFrame:
    """docs with a double column `score` (0 to 1, higher: label 1 likelier; it replaces a column of that name).

    Reads every passage of every text; null and empty texts are scored as texts without words. Rows are kept as they are.
    Only the texts go to the Python workers, in batches bounded by bytes; the other columns stay in the JVM.
    """

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            score = np.zeros(len(texts))
            for s in range(0, len(texts), 64):
                score[s : s + 64] = model.score([encode(t) for t in texts.iloc[s : s + 64]])
            yield pd.Series(score)

    batched(docs.sparkSession)
    return docs.drop("score").withColumn("score", F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)("text"))
