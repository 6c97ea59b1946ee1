"""Quantile and fixed-edge labels, envelope ids, class and weight rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentinels, class codes and terms of non-vegetated ground, weight limits, selection limits.
SENTINELS = (-9999, -32768, 32767, -1111)
NONVEG_CLASSES = (111, 112, 120, 132, 180)
NONVEG_TERMS = ("Developed", "Open Water", "Agricultur", "Barren", "Snow")
WEIGHT_FLOOR, WEIGHT_CAP, NEUTRAL, NONVEG_WEIGHT = 0.1, 10.0, 1.0, 10.0
MIN_AVAILABLE, HIGH, LOW = 15, 2.0, 0.5
LANDSCAPE_RARE = "Landscape-Rare (availability too low to judge)"


def unmasked(value: Column, *nodata: int) -> Column:
    """NULL for the layer's nodata value and the sentinels."""
    return F.when(~value.isin(*SENTINELS, *nodata), value)


def inner_edges(column: str, parts: int, weight: str | None = None) -> Column:
    """Aggregate: the distinct inner quantile edges (linear interpolation), an ascending array; weight: how many rows a row stands for."""
    return F.array_sort(F.array_distinct(F.percentile(column, F.array(*(F.lit(i / parts) for i in range(parts + 1))), F.col(weight) if weight else F.lit(1))))


def right_closed(value: Column, edges: Column, missing: str = "nan", prefix: str = "Q") -> Column:
    """Q1..Qn of edges' intervals (lo, hi]; the outer edges count as infinite."""
    inner = F.slice(edges, F.lit(2), F.greatest(F.size(edges) - 2, F.lit(0)))
    return F.when(value.isNull(), missing).otherwise(F.concat(F.lit(prefix), (F.size(F.filter(inner, lambda e: value > e)) + 1).cast("string")))


def self_binned(df: DataFrame, column: str, parts: int, name: str, missing: str = "NA", weight: str | None = None) -> DataFrame:
    """df with the label of its own quantile bin; duplicate edges are dropped. Edges are one broadcast row. weight: how many rows a row stands for."""
    edges = df.agg(inner_edges(column, parts, weight).alias("edges_"))
    return df.crossJoin(F.broadcast(edges)).withColumn(name, right_closed(F.col(column), F.col("edges_"), missing)).drop("edges_")


def fixed_bin(value: Column, edges: tuple[float, ...], labels: tuple[str, ...], missing: str = "NA") -> Column:
    """Right-closed bins with fixed edges; labels has one more entry than edges."""
    out = F.when(value.isNull(), missing)
    for edge, label in zip(edges, labels):
        out = out.when(value <= edge, label)
    return out.otherwise(labels[-1])


def disturbance(value: Column) -> Column:
    return F.when(value <= 0, "None").otherwise("Disturbed")


def nonvegetated(code: Column, physiognomy: Column) -> Column:
    return F.coalesce(code.isin(*NONVEG_CLASSES), F.lit(False)) | F.coalesce(physiognomy.rlike("(?i)" + "|".join(NONVEG_TERMS)), F.lit(False))


def envelope_id(parts: dict[str, Column]) -> Column:
    return F.concat_ws("|", *(F.concat(F.lit(f"{name.upper()}:"), label.cast("string")) for name, label in parts.items()))


def selection_class(available: Column, ratio: Column) -> Column:
    return F.when(available < MIN_AVAILABLE, LANDSCAPE_RARE).when(ratio >= HIGH, "Selected").when(ratio <= LOW, "Avoided").otherwise("Proportional")


def env_zone(classification: Column) -> Column:
    """The zone of a record by its envelope's class; records of unknown envelopes count as proportional."""
    name = F.when(classification == LANDSCAPE_RARE, "Landscape-Rare").when(classification.isin("Selected", "Avoided"), classification).otherwise("Proportional")
    return F.concat(name, F.lit(" Envelope"))


def inverse_weight(nonveg: Column, ratio: Column) -> tuple[Column, Column]:
    """Weight and its basis: non-vegetated ground, unknown ratio, or the clipped inverse of the selection ratio."""
    weight = F.when(nonveg, NONVEG_WEIGHT).when(ratio.isNull(), NEUTRAL).otherwise(1.0 / F.least(F.greatest(ratio, F.lit(WEIGHT_FLOOR)), F.lit(WEIGHT_CAP)))
    return weight, F.when(nonveg, "nonveg").when(ratio.isNull(), "neutral").otherwise("inverse_selection")


def zone(density: Column, cuts: Column) -> Column:
    """Hot from the upper decile on, then Cold up to the lower one, else Moderate; Moderate without a density."""
    return F.when(density >= cuts[1], "Hot").when(density <= cuts[0], "Cold").otherwise("Moderate")


def clamped(value: Column, size: int) -> Column:
    return F.greatest(F.least(value, F.lit(size - 1)), F.lit(0))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
