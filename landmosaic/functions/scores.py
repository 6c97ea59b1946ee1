"""Probabilities, losses and array patches."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def probability(logit: Column, temperature: float | Column = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-logit / temperature))


def cross_entropy(logit: Column, y: Column) -> Column:
    """Numerically stable binary cross entropy of a logit."""
    return F.greatest(logit, F.lit(0.0)) - logit * y + F.log1p(F.exp(-F.abs(logit)))


def focal_loss(logit: Column, y: Column, alpha: float = 0.25, gamma: float = 2.0) -> Column:
    """The hit probability is exp(-cross entropy), with the target as it is: smoothed, if it is smoothed."""
    entropy = cross_entropy(logit, y)
    share = F.when(y > 0.5, F.lit(alpha)).otherwise(F.lit(1 - alpha))
    return share * F.pow(1 - F.exp(-entropy), F.lit(gamma)) * entropy


def training_loss(logit: Column, y: Column, weight: Column, smoothing: float = 0.05, band: float = 0.75) -> Column:
    """Smoothed label, logit shifted by the strict band's margin against the label, loss times weight."""
    margin = math.log(band / (1 - band))
    shifted = logit - F.when(y > 0.5, margin).otherwise(-margin)
    return focal_loss(shifted, y * (1 - smoothing) + 0.5 * smoothing) * F.coalesce(weight, F.lit(1.0))


def rotated(patch: Column, side: int, quarter: int, flip: bool = False) -> Column:
    """A flat side x side patch turned by quarter turns (anticlockwise), then mirrored left to right."""
    last = side - 1

    def source(i: Column) -> Column:
        r, c = F.floor(i / side), i % side
        c = last - c if flip else c
        for _ in range(quarter % 4):
            r, c = c, last - r
        return F.element_at(patch, (r * side + c + 1).cast("int"))

    return F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), source)


def cropped(patch: Column, side: int, size: int, row: int, col: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), lambda i: F.element_at(patch, ((F.floor(i / size) + row) * side + i % size + col + 1).cast("int")))


def weighted_pool(patch: Column, weights: list[float]) -> Column:
    total = sum(weights)
    return F.aggregate(F.zip_with(patch, F.array(*(F.lit(w / total) for w in weights)), lambda v, w: v.cast("double") * w), F.lit(0.0), lambda a, b: a + b)


def mean_weights(side: int) -> list[float]:
    return [1.0] * (side * side)


def centre_weights(side: int) -> list[float]:
    middle = (side // 2 - 1, side // 2)
    return [1.0 if r in middle and c in middle else 0.0 for r in range(side) for c in range(side)]


def gaussian_weights(side: int) -> list[float]:
    s, m = side / 4, (side - 1) / 2
    return [math.exp(-((r - m) ** 2 + (c - m) ** 2) / (2 * s * s)) for r in range(side) for c in range(side)]


def attention_pool(patch: Column) -> Column:
    """Mean of the patch weighted by the softmax of its own values."""
    top = F.array_max(patch)
    return F.aggregate(
        patch,
        F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b")),
        lambda s, v: F.struct((s["a"] + v * F.exp((v - top).cast("double"))).alias("a"), (s["b"] + F.exp((v - top).cast("double"))).alias("b")),
        lambda s: s["a"] / s["b"],
    )
