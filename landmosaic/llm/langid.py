"""Language identification by rank-order profiles of character n-grams and the out-of-place distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import in_batches, written

UNKNOWN = "und"
#: Profiles of up to so many rows are sent to all tasks (12 MB); larger ones are joined.
SENT_ROWS = 1_000_000


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def ngrams(text: str | None, longest: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the n-grams (1 to longest, at most 3) of the letter runs of the lower-cased text, padded by a space.

    A code packs 21 bits for each character; it has no space inside, and isn't the space alone.
    """
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[raw]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[True], letter[:-1]])
    s = np.where(letter, raw, 1)[letter | before].astype(np.int64)  # 1: the space
    s = np.concatenate([[1], s, [1]])
    found = [s[s > 1]]
    if longest >= 2:
        found.append((s[:-1] | s[1:] << 21)[(s[:-1] > 1) | (s[1:] > 1)])
    if longest >= 3:
        found.append((s[:-2] | s[1:-1] << 21 | s[2:] << 42)[s[1:-1] > 1])
    return np.unique(np.concatenate(found), return_counts=True)


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The top most frequent codes, ties to the smaller code."""
    return codes[np.lexsort((codes, -counts))[:top]]


def profiles(docs: DataFrame, top: int = 400) -> DataFrame:
    """lang, code, rank (from 0): the most frequent n-grams of all texts of each lang; rows without lang don't count.

    Each task sums its own counts for each lang, so that what is shuffled grows with the n-grams, not with the texts.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, list] = {}

        def merged(parts: list) -> list:
            codes, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            return [(codes, np.bincount(at, np.concatenate([n for _, n in parts])).astype(np.int64))]

        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                parts = kept.setdefault(lang, [])
                parts.append(ngrams(text))
                if len(parts) > 500:
                    kept[lang] = merged(parts)
        for lang, parts in kept.items():
            for codes, n in merged(parts):
                yield pd.DataFrame({"lang": lang, "code": codes, "n": n})

    counts = in_batches(docs.where("lang is not null and text is not null").select("lang", "text"), count, "lang string, code long, n long")
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "code")
    return counts.groupBy("lang", "code").agg(F.sum("n").alias("n")).withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top).select("lang", "code", "rank")


def identify(docs: DataFrame, profile: DataFrame, top: int = 400) -> DataFrame:
    """docs' other columns but text, with lang_pred and score (columns of these names are replaced).

    The language with the least out-of-place distance between the text's ranked n-grams and its profile (a missing
    n-gram costs `top`), ties to the first in alphabetical order. score is that language's share of all languages'
    closeness (1 - distance / greatest distance). No letter or null text: 'und', score 0. No profile at all: the same.
    """
    docs = docs.drop("lang_pred", "score")
    rows = profile.limit(SENT_ROWS + 1).toPandas()
    if len(rows) > SENT_ROWS:
        return _joined(docs, profile, top)
    langs = sorted(rows["lang"].unique())
    codes = np.unique(rows["code"].to_numpy(np.int64))
    ranks = np.full((len(codes) + 1, len(langs)), -1, np.int32)
    ranks[np.searchsorted(codes, rows["code"].to_numpy(np.int64)), [langs.index(x) for x in rows["lang"]]] = rows["rank"]
    keep = [c for c in docs.columns if c != "text"]

    def best(text: str | None) -> tuple[str, float]:
        got = ranked(*ngrams(text), top)
        if not len(got) or not langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(codes, got), len(codes) - 1)
        known = np.where((codes[at] == got)[:, None], ranks[at], -1)
        away = np.where(known >= 0, np.abs(known - np.arange(len(got))[:, None]), top).sum(axis=0)
        close = 1 - away / (top * len(got))
        i = int(away.argmin())
        return langs[i], float(close[i] / close.sum()) if close.sum() > 0 else 0.0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [best(t) for t in pdf["text"]]
            yield pdf[keep].assign(lang_pred=[f[0] for f in found], score=[f[1] for f in found])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return in_batches(docs, run, f"{kinds}, lang_pred string, score double")


def _joined(docs: DataFrame, profile: DataFrame, top: int) -> DataFrame:
    """identify() for profiles of any size: the ranked n-grams of the documents are joined to the profiles by code.

    A language's closeness is the sum of top - |difference of ranks| over the n-grams that it shares with the text, over top
    times their number; languages that share none are 0 close.
    """

    def ranks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [ranked(*ngrams(t), top) for t in pdf["text"]]
            sizes = [len(g) for g in got]
            yield pd.DataFrame({"at": np.repeat(pdf["at"].to_numpy(), sizes), "of": np.repeat(sizes, sizes), "code": np.concatenate([np.zeros(0, np.int64), *got]), "place": np.concatenate([np.zeros(0, np.int64), *(np.arange(n) for n in sizes)])})

    numbered = written(docs.select(F.struct("*").alias("doc"), F.monotonically_increasing_id().alias("at")))
    grams = in_batches(numbered.select("at", F.col("doc.text").alias("text")), ranks, "at long, of long, code long, place long")
    near = grams.join(profile, "code").groupBy("at", "of", "lang").agg(F.sum(top - F.abs(F.col("rank") - F.col("place"))).alias("n"))
    best = near.groupBy("at", "of").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang")).alias("best"), F.sum("n").alias("n"))
    first = profile.agg(F.min("lang").alias("first"))
    has = F.col("doc.text").rlike(r"\p{L}")
    out = numbered.join(best, "at", "left").crossJoin(F.broadcast(first))
    none = F.col("best").isNull() | (F.col("n") == 0)
    pred = F.when(~F.coalesce(has, F.lit(False)), F.lit(UNKNOWN)).when(none, F.coalesce("first", F.lit(UNKNOWN))).otherwise(F.col("best.lang"))
    score = F.when(none, F.lit(0.0)).otherwise(-F.col("best.n") / F.col("n"))
    return out.select(*(F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c != "text"), pred.alias("lang_pred"), score.alias("score"))
