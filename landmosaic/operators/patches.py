"""Windows round points: summed-area tables of tiles, class shares, pooled values, scored grids."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binning import unmasked
from ..functions.scores import probability
from .shared import few, saved

#: Pixels a side of the tiles in which windows are summed.
TILE = 128
SUMS = "row_id int, col_id int, feature string, code int, n long, total double"


def _on_tiles(spots: DataFrame, before: int, after: int, tile: int) -> DataFrame:
    """A row for each tile that the rows and columns from `before` up to `after` pixels round a spot touch."""
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - before) / tile), F.floor((F.col(c) + after) / tile)))
    return spots.withColumn("tile_r", reach("row_id")).withColumn("tile_c", reach("col_id"))


def _with_tile(pixels: DataFrame, tile: int) -> DataFrame:
    return pixels.withColumn("tile_r", F.floor(F.col("row_id") / tile)).withColumn("tile_c", F.floor(F.col("col_id") / tile))


def area_table(grid: np.ndarray) -> np.ndarray:
    """The summed-area table with a first row and column of zeros: the sum of any rectangle is four look-ups."""
    out = np.zeros((grid.shape[0] + 1, grid.shape[1] + 1), np.float64 if grid.dtype.kind == "f" else np.int64)
    out[1:, 1:] = grid.cumsum(0).cumsum(1)
    return out


def rectangles(table: np.ndarray, r0, r1, c0, c1) -> np.ndarray:
    return table[r1, c1] - table[r0, c1] - table[r1, c0] + table[r0, c0]


def scattered(rows: pd.DataFrame, column: str, r0: int, c0: int, height: int, width: int) -> np.ndarray:
    """The column as a grid from (r0, c0) on; NaN without a value; of a repeated pixel the greatest value."""
    grid = np.full((height, width), -np.inf)
    np.fmax.at(grid, (rows.row_id.to_numpy() - r0, rows.col_id.to_numpy() - c0), rows[column].to_numpy(float))
    return np.where(np.isinf(grid), np.nan, grid)


def _summed(categorical: tuple[str, ...], continuous: tuple[str, ...], side: int, tile: int) -> Callable:
    half = side // 2

    def run(key: tuple, pixels: pd.DataFrame, spots: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pixels) and len(spots):
            top, left = int(key[0]) * tile, int(key[1]) * tile
            start = lambda c, o: np.clip(spots[c].to_numpy() - half - o, 0, tile)
            end = lambda c, o: np.clip(spots[c].to_numpy() - half + side - o, 0, tile)
            box = start("row_id", top), end("row_id", top), start("col_id", left), end("col_id", left)

            def add(feature: str, code: int | None, n: np.ndarray, total: np.ndarray) -> None:
                some = n > 0
                part = spots.loc[some, ["row_id", "col_id"]].assign(feature=feature, n=n[some], total=total[some])
                out.append(part.assign(code=pd.array([code] * len(part), "Int32")))

            for f in categorical:
                grid = scattered(pixels, f, top, left, tile, tile)
                for code in np.unique(grid[~np.isnan(grid)]):
                    n = rectangles(area_table((grid == code).astype(np.int32)), *box)
                    add(f, int(code), n, n.astype(float))
            for f in continuous:
                grid = scattered(pixels, f, top, left, tile, tile)
                add(f, None, rectangles(area_table((~np.isnan(grid)).astype(np.int32)), *box), rectangles(area_table(np.nan_to_num(grid)), *box))
        columns = [c.split()[0] for c in SUMS.split(", ")]
        return pd.concat(out)[columns] if out else pd.DataFrame(columns=columns)

    return run


def window_sums(spots: DataFrame, pixels: DataFrame, categorical: tuple[str, ...], continuous: tuple[str, ...], side: int = 64, tile: int = TILE) -> DataFrame:
    """row_id, col_id, feature, code, n, total over the side x side window of each spot (row_id, col_id): pixels of each class; valid
    pixels and their sum for continuous features (code NULL). The window reaches side // 2 up and left; outside there is nothing.

    Spots are distinct pixels, so a tile meets a bounded number of them, however many points lie on one pixel. A tile's
    pixels become one summed-area table for each class; a window is four look-ups in each of the tiles (mostly one to four) that it
    touches. Only tiles under some window are read; no row stands for a pixel of a window. Of a repeated pixel the greatest value counts.
    """
    half = side // 2
    at = _on_tiles(spots.select(F.col("row_id").cast("int").alias("row_id"), F.col("col_id").cast("int").alias("col_id")).distinct(), half, side - half - 1, tile)
    at = saved(at)
    used = few(saved(at.select("tile_r", "tile_c").distinct()))
    values = _with_tile(pixels, tile).join(used, ["tile_r", "tile_c"], "left_semi").select("tile_r", "tile_c", "row_id", "col_id", *(unmasked(F.col(f)).alias(f) for f in (*categorical, *continuous)))
    key = ("tile_r", "tile_c")
    parts = values.groupBy(*key).cogroup(at.groupBy(*key)).applyInPandas(_summed(categorical, continuous, side, tile), SUMS)
    return parts.groupBy("row_id", "col_id", "feature", "code").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def class_shares(points: DataFrame, sums: DataFrame, side: int = 64) -> DataFrame:
    """points (row_id, col_id) with feature, code, share of each class in their window; what is missing from 1 has no data."""
    shares = sums.where("code IS NOT NULL").select("row_id", "col_id", "feature", "code", (F.col("n") / (side * side)).alias("share"))
    return points.join(shares, ["row_id", "col_id"])


def pooled(points: DataFrame, sums: DataFrame, features: tuple[str, ...], side: int = 64, suffix: str = "_mean") -> DataFrame:
    """points with the mean of each continuous feature over the whole window; pixels without data count as 0."""
    mean = lambda f: F.max(F.when(F.col("feature") == f, F.col("total") / (side * side)))
    wide = sums.where("code IS NULL").groupBy("row_id", "col_id").agg(*(mean(f).alias(f"{f}{suffix}") for f in features))
    out = points.join(wide, ["row_id", "col_id"], "left")
    return out.withColumns({f"{f}{suffix}": F.coalesce(f"{f}{suffix}", F.lit(0.0)) for f in features})


def centre_codes(points: DataFrame, pixels: DataFrame, categorical: tuple[str, ...]) -> DataFrame:
    """points with the codes of their own pixel, 0 where there is none."""
    codes = pixels.groupBy("row_id", "col_id").agg(*(F.max(unmasked(F.col(f))).alias(f"{f}_centre") for f in categorical))
    spots = few(saved(points.select("row_id", "col_id").distinct()))
    own = codes.join(spots, ["row_id", "col_id"], "left_semi")
    return points.join(own, ["row_id", "col_id"], "left").withColumns({f"{f}_centre": F.coalesce(f"{f}_centre", F.lit(0)) for f in categorical})


#: For each quarter turn and flip, which pixel of the centre's 2 x 2 lies at the patch's centre; each of the four twice.
VIEWS = tuple((k, flip) for k in range(4) for flip in (False, True))


def centre_of_view(k: int, flip: bool) -> tuple[int, int]:
    """Row and column offset (0 or -1) from the centre pixel of the pixel that a turned (anticlockwise) and flipped even patch has there."""
    r, c = 1, 1
    c = 1 - c if flip else c
    for _ in range(k % 4):
        r, c = c, 1 - r
    return r - 1, c - 1


def _scored(side: int, tile: int, stride: int, origin: tuple[int, int], centre_weight: float) -> Callable:
    half = side // 2
    offsets = [centre_of_view(k, flip) for k, flip in VIEWS]

    def run(key: tuple, pixels: pd.DataFrame) -> pd.DataFrame:
        top, left = int(key[0]) * tile - half, int(key[1]) * tile - half
        size = tile + side
        grid = scattered(pixels, "logit", top, left, size, size)
        first = lambda start, o: start + half + (o - start - half) % stride
        rows, cols = np.arange(first(top, origin[0]), top + half + tile, stride), np.arange(first(left, origin[1]), left + half + tile, stride)
        r, c = (x.ravel() for x in np.meshgrid(rows - top, cols - left, indexing="ij"))
        held = ~np.isnan(grid[r, c])
        r, c = r[held], c[held]
        whole = np.nan_to_num(grid)
        window = rectangles(area_table(whole), r - half, r - half + side, c - half, c - half + side) / (side * side)
        views = [centre_weight * whole[r + dr, c + dc] + (1 - centre_weight) * window for dr, dc in offsets]
        return pd.DataFrame({"row_id": r + top, "col_id": c + left, "logit": np.mean(views, 0) if len(r) else np.zeros(0)})

    return run


def scored_grid(pixels: DataFrame, stride: int, side: int = 64, origin: tuple[int, int] = (0, 0), centre_weight: float = 0.5, temperature: float = 1.0, tile: int = TILE) -> DataFrame:
    """row_id, col_id, logit, p of every `stride`-th pixel (counted from the origin) that has data (pixels: row_id, col_id, logit).

    A centre's logit is that of its window's mean (nothing counts as 0) and of its central pixel, averaged over the eight views of the patch, over the
    temperature. Every tile gets the pixels of its neighbours' borders once (half a window wide), so each window lies in one
    task and is four look-ups; a tile's task has (tile + side)^2 pixels at most.
    """
    half = side // 2
    mine = _on_tiles(pixels.select(F.col("row_id").cast("int").alias("row_id"), F.col("col_id").cast("int").alias("col_id"), "logit"), half, half, tile)
    parts = mine.groupBy("tile_r", "tile_c").applyInPandas(_scored(side, tile, stride, origin, centre_weight), "row_id int, col_id int, logit double")
    return parts.withColumn("p", probability(F.col("logit"), temperature))


def write_surface(grid: DataFrame, path: str, stride: int, origin: tuple[int, int] = (0, 0), top: float = 48.0, left: float = -74.0, res: float = 0.01) -> DataFrame:
    """The grid sink: partitioned by region, with each cell's place in the grid, its centre on the map and the grid's affine (a, c, e, f) in every row; read back."""
    place = lambda c, o: F.floor((F.col(c) - o) / stride).cast("int")
    at: dict[str, Column] = {"grid_row": place("row_id", origin[0]), "grid_col": place("col_id", origin[1])}
    at |= {"x": left + (F.col("col_id") + 0.5) * res, "y": top - (F.col("row_id") + 0.5) * res}
    at |= {"a": F.lit(res * stride), "c": F.lit(left + (origin[1] + 0.5) * res), "e": F.lit(-res * stride), "f": F.lit(top - (origin[0] + 0.5) * res)}
    grid.withColumns(at).repartition("region").write.mode("overwrite").partitionBy("region").parquet(path)
    return grid.sparkSession.read.parquet(path)
