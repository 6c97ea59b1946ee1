"""Layers that each have a projection and a grid of their own: points to pixels, boxes to windows, pixels back to the map.

A grid table has a row for each layer: feature; p1, p2, lat0, lon0 (degrees: parallels and origin of its Albers projection; all NULL for a
grid in degrees); x_left, y_top, res (corner and width of a pixel in its own units); n_rows, n_cols.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import albers_terms, from_albers, to_albers
from .shared import few, saved

GRID = "feature string, p1 double, p2 double, lat0 double, lon0 double, x_left double, y_top double, res double, n_rows int, n_cols int"
TERMS = ("n_", "c_", "rho0_")
#: A grid table up to so many layers is broadcast, beyond it Spark joins by the feature.
FEW_LAYERS = 100_000


def with_terms(grids: DataFrame) -> DataFrame:
    """grids with the constants of each projection, worked out once a layer."""
    return grids.withColumns(albers_terms(F.col("p1"), F.col("p2"), F.col("lat0")))


def _sent(grids: DataFrame) -> DataFrame:
    ready = saved(with_terms(grids))
    return F.broadcast(ready) if ready.limit(FEW_LAYERS + 1).count() <= FEW_LAYERS else ready


def _on_map(lon: Column, lat: Column) -> tuple[Column, Column]:
    x, y = to_albers(lon, lat, *(F.col(t) for t in TERMS), F.col("lon0"))
    flat = F.col("n_").isNull()
    return F.when(flat, lon).otherwise(x), F.when(flat, lat).otherwise(y)


def _row(y: Column) -> Column:
    return F.floor((F.col("y_top") - y) / F.col("res")).cast("int")


def _col(x: Column) -> Column:
    return F.floor((x - F.col("x_left")) / F.col("res")).cast("int")


def located(points: DataFrame, grids: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A row for each point (lon, lat) and layer: x, y in the layer's own projection, row_id, col_id of its pixel, inside.

    With `by`, layers and points also meet by these columns only (a region's own layers).
    """
    sent = _sent(grids)
    both = points.join(sent, list(by)) if by else points.crossJoin(sent)
    x, y = _on_map(F.col("lon"), F.col("lat"))
    placed = both.withColumns({"x": x, "y": y}).withColumns({"row_id": _row(F.col("y")), "col_id": _col(F.col("x"))})
    inside = F.col("row_id").between(0, F.col("n_rows") - 1) & F.col("col_id").between(0, F.col("n_cols") - 1)
    return placed.withColumn("inside", inside).select(*points.columns, *(c for c in ("feature",) if c not in points.columns), "x", "y", "row_id", "col_id", "inside")


def windows(boxes: DataFrame, grids: DataFrame, pad: int = 100, least: int = 64) -> DataFrame:
    """A row for each box (min_lon, min_lat, max_lon, max_lat) and layer: the padded, clamped window r_start, r_end, c_start, c_end (ends exclusive) and
    whether it is `large` enough for one patch. The four corners are projected, since a box in degrees isn't one in metres.
    """
    corners = [_on_map(F.col(lon), F.col(lat)) for lon in ("min_lon", "max_lon") for lat in ("min_lat", "max_lat")]
    xs, ys = zip(*corners)
    at = boxes.crossJoin(_sent(grids)).withColumns({"r0_": _row(F.greatest(*ys)), "r1_": _row(F.least(*ys)), "c0_": _col(F.least(*xs)), "c1_": _col(F.greatest(*xs))})
    low = lambda c: F.greatest(F.lit(0), F.col(c) - pad)
    high = lambda c, n: F.least(F.col(n), F.col(c) + pad)
    out = at.select(*boxes.columns, "feature", low("r0_").alias("r_start"), high("r1_", "n_rows").alias("r_end"), low("c0_").alias("c_start"), high("c1_", "n_cols").alias("c_end"))
    return out.withColumn("large", (F.col("r_end") - F.col("r_start") >= least) & (F.col("c_end") - F.col("c_start") >= least))


def centres(pixels: DataFrame, grids: DataFrame) -> DataFrame:
    """pixels (feature, row_id, col_id) with lon, lat of their centres."""
    at = pixels.join(_sent(grids), "feature")
    x, y = F.col("x_left") + (F.col("col_id") + 0.5) * F.col("res"), F.col("y_top") - (F.col("row_id") + 0.5) * F.col("res")
    lon, lat = from_albers(x, y, *(F.col(t) for t in TERMS), F.col("lon0"))
    flat = F.col("n_").isNull()
    return at.select(*(pixels[c] for c in pixels.columns if c != "feature"), "feature", F.when(flat, x).otherwise(lon).alias("lon"), F.when(flat, y).otherwise(lat).alias("lat"))


def sampled_by_grid(points: DataFrame, grids: DataFrame, values: DataFrame, key: tuple[str, ...], features: tuple[str, ...]) -> DataFrame:
    """key and a column per feature: the value of each layer's own pixel under a point (values: feature, row_id, col_id, value).

    Points that share a layer's pixel look it up once; the values asked for are picked out before any shuffle as long as they are few. NULL outside a layer or without data.
    """
    at = saved(located(points.select(*key, "lon", "lat"), grids).where("inside").select(*key, "feature", "row_id", "col_id"))
    spots = few(saved(at.select("feature", "row_id", "col_id").distinct()))
    found = saved(values.join(spots, ["feature", "row_id", "col_id"], "left_semi").groupBy("feature", "row_id", "col_id").agg(F.max("value").alias("value")))
    wide = at.join(found, ["feature", "row_id", "col_id"]).groupBy(*key).agg(*(F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features))
    return points.select(*key).distinct().join(wide, list(key), "left")
