"""Sums of a Gaussian over all points within a cutoff, without a row for each pair of points in crowded cells."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from .shared import few, saved

#: Nodes a side of a crowded cell, half a bandwidth wide: interpolated there, the Gaussian is off by less than 1e-14 of its greatest value.
SIDE = 12
#: A cell with at least so many points is crowded: two sets of nodes meet in less time than the pairs of so many points.
CROWDED = 64
#: A cell's points are dealt to so many groups.
SALTS = 16
CELL = ("gx", "gy")

_AT = np.cos((2 * np.arange(SIDE) + 1) * np.pi / (2 * SIDE))
_MIX = np.cos(np.outer(np.arange(SIDE), np.arccos(_AT))) * np.where(np.arange(SIDE) == 0, 1, 2)[:, None] / SIDE


def basis(v: np.ndarray, cell: int, side: float) -> np.ndarray:
    """A row for each coordinate of one cell: the values there of the polynomials that are 1 at one Chebyshev node and 0 at the others."""
    u = np.clip((v - (cell + 0.5) * side) / (side / 2), -1, 1)
    return np.cos(np.outer(np.arccos(u), np.arange(SIDE))) @ _MIX


def _charges(side: float, keys: list[str]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The points of a cell as weights at its nodes: any Gaussian sum over the nodes is that over the points."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = (basis(pdf[c].to_numpy(float), int(pdf[g].iloc[0]), side) for c, g in zip("xy", CELL))
        w = x.T @ (pdf["many"].to_numpy(float)[:, None] * y)
        return pd.DataFrame({k: [pdf[k].iloc[0]] * SIDE * SIDE for k in keys} | {"node": np.arange(SIDE * SIDE, dtype=np.int32), "many": w.ravel()})[[*keys, "node", "many"]]

    return run


def _met(side: float, bandwidth: float, keys: list[str], axes: list[str], reach: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The sums at the nodes of one cell over the nodes of all cells it meets."""
    d = np.arange(-reach, reach + 1)[:, None, None] * side + side / 2 * (_AT[:, None] - _AT[None, :])
    line = np.exp(-(d**2) / (2 * bandwidth**2))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        far = sum(((pdf[a] - pdf[f"s_{a}"]).to_numpy(float) ** 2 for a in axes), np.zeros(len(pdf)))
        w = np.array(pdf["w"].tolist()).reshape(-1, SIDE, SIDE) * np.exp(-far / (2 * bandwidth**2))[:, None, None]
        kx, ky = (line[(pdf[g] - pdf[f"s_{g}"]).to_numpy(int) + reach] for g in CELL)
        s = (kx @ w @ ky.transpose(0, 2, 1)).sum(0)
        return pd.DataFrame({k: [pdf[k].iloc[0]] * SIDE * SIDE for k in keys} | {"node": np.arange(SIDE * SIDE, dtype=np.int32), "s_": s.ravel()})[[*keys, "node", "s_"]]

    return run


def _interpolated(side: float, where: list[str]) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The sums at a cell's points from those at its nodes."""

    def run(points: pd.DataFrame, nodes: pd.DataFrame) -> pd.DataFrame:
        if points.empty or nodes.empty:
            return pd.DataFrame(columns=[*where, "s_"])
        x, y = (basis(points[c].to_numpy(float), int(points[g].iloc[0]), side) for c, g in zip("xy", CELL))
        v = np.array(nodes["v"].iloc[0]).reshape(SIDE, SIDE)
        return points[where].assign(s_=((x @ v) * y).sum(1))

    return run


def summed(spots: DataFrame, strata: tuple[str, ...], axes: list[str], bandwidth: float, cutoff: float) -> DataFrame | None:
    """strata, x, y, axes, s_: for each spot the sum of many * exp(-d^2 / 2 bandwidth^2) over the spots of its stratum within `cutoff`
    bandwidths on the plane, d with the further axes. None if no cell is crowded: then pairs are cheap.

    spots: written, a row for each strata, x, y, axes, and many. The points of a crowded cell stand as weights at its nodes for cells wholly
    within the cutoff, and take their sums from the nodes; the cutoff itself is no smooth function, so cells that it crosses
    meet point by point, and so do cells that aren't crowded. Crowded cells cost their number, not that of their points.
    Points and nodes are shuffled: written tables look small enough to be sent through the driver, and are several times as large there.
    """
    side, radius, reach = bandwidth / 2, cutoff * bandwidth, int(2 * cutoff) + 1
    keys, where = [*strata, *axes, *CELL], [*strata, "x", "y", *axes]
    placed = spots.withColumns({g: F.floor(F.col(c) / side) for c, g in zip("xy", CELL)})
    cells = saved(placed.groupBy(*keys).agg((F.count("*") >= CROWDED).alias("crowded")))
    if cells.where("crowded").isEmpty():
        return None
    crowded = few(saved(cells.where("crowded").select(*keys)))
    thick, thin = placed.join(crowded, keys, "left_semi"), placed.join(crowded, keys, "left_anti")
    salt = F.pmod(F.xxhash64("x", "y"), F.lit(SALTS)).cast("int")
    fields = [placed.schema[k] for k in keys]
    node_of = StructType([*fields, StructField("node", IntegerType()), StructField("many", DoubleType())])
    parts = thick.withColumn("salt", salt).groupBy(*keys, "salt").applyInPandas(_charges(side, keys), node_of)
    charges = saved(parts.groupBy(*keys, "node").agg(F.sum("many").alias("many")))
    at = lambda g, i: (F.col(g) + 0.5 + F.element_at(F.array(*(F.lit(float(t) / 2) for t in _AT)), (i + 1).cast("int"))) * side
    nodes = charges.withColumns({"x": at("gx", F.floor(F.col("node") / SIDE)), "y": at("gy", F.col("node") % SIDE)})
    as_row = [*keys, "x", "y", "many"]
    slim = nodes.select(*as_row, "node").unionByName(thin.select(*as_row, F.lit(None).cast("int").alias("node")))

    block = {b: F.floor(F.col(g) / reach) for b, g in (("bx", "gx"), ("by", "gy"))}
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    mine = cells.withColumns(block)
    others = cells.withColumns(block).withColumn("o", around).withColumns({"bx": F.col("bx") + F.col("o.i"), "by": F.col("by") + F.col("o.j")})
    named = lambda df, *more: df.select(*strata, *(F.col(c).alias(f"s_{c}") for c in (*axes, *CELL, *more)), *(c for c in df.columns if c not in (*keys, *more)))
    gap = [F.abs(F.col(g) - F.col(f"s_{g}")) for g in CELL]
    nearest = reduce(lambda a, b: a + b, (F.pow(F.greatest(g - 1, F.lit(0)) * side, F.lit(2.0)) for g in gap))
    farthest = reduce(lambda a, b: a + b, (F.pow((g + 1) * side, F.lit(2.0)) for g in gap))
    both = mine.join(named(others.drop("o"), "crowded").hint("merge"), [*strata, "bx", "by"]).where(nearest <= radius * radius)
    pairs = saved(both.select(*keys, *(f"s_{c}" for c in (*axes, *CELL)), F.col("crowded").alias("t"), F.col("s_crowded").alias("s"), (farthest <= radius * radius).alias("inside")))

    source = [*strata, *(f"s_{c}" for c in (*axes, *CELL))]
    flat = (F.col("x") - F.col("s_x")) ** 2 + (F.col("y") - F.col("s_y")) ** 2
    whole = reduce(lambda a, b: a + b, ((F.col(a) - F.col(f"s_{a}")) ** 2 for a in axes), flat)

    def rows(which: DataFrame, points: DataFrame, *more: str) -> DataFrame:
        near = which.drop("t", "s", "inside").join(points.select(*keys, "x", "y", *more).hint("merge"), keys).join(named(points.select(*as_row), "x", "y", "many").hint("merge"), source)
        return near.where(flat <= radius * radius).groupBy(*keys, "x", "y", *more).agg(F.sum(F.col("s_many") * F.exp(-whole / (2 * bandwidth**2))).alias("s_"))

    pointwise = rows(pairs.where("not inside"), placed)
    mixed = saved(rows(pairs.where("inside and not (t and s)"), slim, "node"))
    weights = charges.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("node", "many"))).alias("n")).select(*keys, F.col("n.many").alias("w"))
    heavy = pairs.where("inside and t and s").drop("t", "s", "inside").join(named(weights).hint("merge"), source)
    met = heavy.groupBy(*keys).applyInPandas(_met(side, bandwidth, keys, axes, reach), StructType([*fields, StructField("node", IntegerType()), StructField("s_", DoubleType())]))
    held = met.unionByName(mixed.where("node is not null").select(*keys, "node", "s_")).groupBy(*keys, "node").agg(F.sum("s_").alias("s_"))
    values = held.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("node", "s_"))).alias("n")).select(*keys, F.col("n.s_").alias("v"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    out = StructType([*(placed.schema[c] for c in where), StructField("s_", DoubleType())])
    inner = thick.withColumn("salt", salt).groupBy(*keys, "salt").cogroup(saved(values).groupBy(*keys, "salt")).applyInPandas(_interpolated(side, where), out)
    every = pointwise.select(*where, "s_").unionByName(mixed.where("node is null").select(*where, "s_")).unionByName(inner)
    return every.groupBy(*where).agg(F.sum("s_").alias("s_"))
