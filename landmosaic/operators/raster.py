"""Raster layers as pixel or tile tables: sampling, year choice, health, gaps, patches and scoring grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.binning import unmasked
from ..functions.geo import pixel_col, pixel_row
from .ranks import quantiles
from .shared import few, saved

FEATURES = ("evt", "evh", "evc", "sclass", "fdist", "ch", "cc")
REQUIRED = ("evt", "evh", "evc", "sclass", "ch", "cc")
#: Blocks of 8 x 8 asked pixels are broadcast up to so many (some 10 MB on the driver).
ASKED_BLOCKS = 100_000


def dense(df: DataFrame, keys: tuple[str, ...], row: Column, col: Column, value: Column, side: int, fill=None) -> DataFrame:
    """keys, data: a flat side x side array per key, `fill` where there's no row; first rows of the array, then the whole. Of a repeated pixel the greatest value counts."""
    line = F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.coalesce(F.col("m_")[i], F.lit(fill).cast("int")))
    rows = df.select(*keys, row.cast("int").alias("r_"), col.cast("int").alias("c_"), value.cast("int").alias("v_"))
    each = F.array_sort(F.collect_set(F.struct("c_", "v_")))
    lines = rows.groupBy(*keys, "r_").agg(each.alias("e_")).withColumn("m_", F.map_from_entries(F.expr("filter(e_, (e, i) -> i = size(e_) - 1 OR e_[i + 1].c_ <> e.c_)"))).select(*keys, "r_", line.alias("line_"))
    blank = F.array_repeat(F.lit(fill).cast("int"), side)
    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(side - 1)), lambda i: F.coalesce(F.col("m_")[i], blank)))
    return lines.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("r_", "line_"))).alias("m_")).select(*keys, whole.alias("data"))


def tiled(pixels: DataFrame, features: tuple[str, ...] = FEATURES, size: int = 64) -> DataFrame:
    """Long tile table: feature, tile_r, tile_c, data (array of size * size, NULL where there is no pixel)."""
    long = pixels.select("row_id", "col_id", F.posexplode(F.array(*(F.col(f).cast("int") for f in features))).alias("f", "value"))
    keyed = long.withColumns({"tile_r": F.floor(F.col("row_id") / size), "tile_c": F.floor(F.col("col_id") / size)})
    flat = dense(keyed, ("f", "tile_r", "tile_c"), F.col("row_id") % size, F.col("col_id") % size, F.col("value"), size)
    name = F.element_at(F.array(*(F.lit(f) for f in features)), F.col("f") + 1)
    return flat.select(name.alias("feature"), "tile_r", "tile_c", "data")


def as_rows(tiles: DataFrame, size: int = 64) -> DataFrame:
    """feature, row_id, col_id, value of a tile table."""
    flat = tiles.select("feature", "tile_r", "tile_c", F.posexplode("data").alias("i", "value"))
    return flat.select("feature", (F.col("tile_r") * size + F.floor(F.col("i") / size)).cast("int").alias("row_id"), (F.col("tile_c") * size + F.col("i") % size).cast("int").alias("col_id"), "value")


def sampled_from_tiles(points: DataFrame, tiles: DataFrame, key: str, features: tuple[str, ...] = FEATURES, size: int = 64) -> DataFrame:
    """key and one column per feature: the pixel under each point (row_id, col_id), an equi-join on the tile."""
    at = points.select(key, F.floor(F.col("row_id") / size).alias("tile_r"), F.floor(F.col("col_id") / size).alias("tile_c"), ((F.col("row_id") % size) * size + F.col("col_id") % size + 1).cast("int").alias("place"))
    hits = at.join(tiles.where(F.col("feature").isin(*features)), ["tile_r", "tile_c"]).select(key, "feature", F.element_at("data", F.col("place")).alias("value"))
    return hits.groupBy(key).agg(*(F.max(F.when(F.col("feature") == f, unmasked(F.col("value")))).alias(f) for f in features))


def indexed(points: DataFrame, top: float = 48.0, left: float = -74.0, res: float = 0.01) -> DataFrame:
    """points with row_id and col_id of the pixel that holds (lon, lat)."""
    return points.withColumn("row_id", pixel_row(F.lit(top), F.col("lat"), res)).withColumn("col_id", pixel_col(F.lit(left), F.col("lon"), res))


def asked(points: DataFrame, rows: DataFrame, keys: tuple[str, ...] = ("row_id", "col_id")) -> DataFrame:
    """The rows (pixels, or tiles by other keys) that some point asks for, marked so that a join shuffles them.

    Only these are shuffled, not the raster. Spark takes rows made by explode() for as small as the table they come from
    and would send the whole raster through the driver. What is sent instead is a row for every 8 x 8 keys asked in, their places
    as the bits of one number; beyond ASKED_BLOCKS such rows both sides are shuffled.
    """
    block = [F.shiftright(F.col(k), 3).cast("long").alias(f"{k}_block_") for k in keys]
    bit = (F.col(keys[0]).bitwiseAND(F.lit(7)) * 8 + F.col(keys[1]).bitwiseAND(F.lit(7))).cast("int")
    bits = F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits_")
    blocks = few(saved(points.select(*keys).dropna().groupBy(*block).agg(bits)), ASKED_BLOCKS)
    met = rows.select("*", *block).join(blocks, [f"{k}_block_" for k in keys])
    return met.where(F.getbit("bits_", bit) == 1).select(*rows.columns).hint("merge")


def sampled(points: DataFrame, pixels: DataFrame, features: tuple[str, ...] = FEATURES) -> DataFrame:
    """points inside the raster with the masked features of their pixel; required features must be there, fdist is -1 if missing."""
    values = asked(points, pixels.select("row_id", "col_id", *(unmasked(F.col(f)).alias(f) for f in features)))
    out = points.join(values, ["row_id", "col_id"]).dropna(subset=[f for f in features if f in REQUIRED])
    return out.withColumn("fdist", F.coalesce("fdist", F.lit(-1))) if "fdist" in features else out


def classified(df: DataFrame, crosswalk: DataFrame, default: str = "Unmapped") -> DataFrame:
    """df with evt_phys from the crosswalk (value, evt_phys; the last row of a value wins by `ord` if there is one)."""
    if "ord" in crosswalk.columns:
        crosswalk = crosswalk.groupBy("value").agg(F.max_by("evt_phys", "ord").alias("evt_phys"))
    joined = df.join(crosswalk.select(F.col("value").alias("value_"), "evt_phys"), F.col("evt") == F.col("value_"), "left")
    return joined.withColumn("evt_phys", F.coalesce("evt_phys", F.lit(default))).drop("value_")


def nearest_year(wanted: DataFrame, available: DataFrame, group: tuple[str, ...] = ("region",)) -> DataFrame:
    """wanted (group, year, feature) with layer_year: the nearest year that the group has of the feature, the earlier one in a tie.

    Only keys are joined; what a group has no year of drops out.
    """
    keys = [*group, "feature"]
    pairs = wanted.select(*keys, "year").distinct().join(available.select(*keys, F.col("year").alias("y_")).distinct(), keys)
    return pairs.groupBy(*keys, "year").agg(F.min_by("y_", F.struct(F.abs(F.col("y_") - F.col("year")), "y_")).alias("layer_year"))


def write_tiles(tiles: DataFrame, path: str) -> DataFrame:
    """The tile table (region, feature, year, tile_r, tile_c, data), partitioned by layer and read back."""
    keys = ("region", "feature", "year")
    tiles.repartition(*keys).write.mode("overwrite").partitionBy(*keys).parquet(path)
    return tiles.sparkSession.read.schema(tiles.schema).parquet(path)


def sampled_by_year(points: DataFrame, tiles: DataFrame, layers: DataFrame, features: tuple[str, ...], size: int = 64) -> DataFrame:
    """points (region, year, row_id, col_id) with a column per feature: the pixel of the region's layer nearest to the point's year.

    tiles: as write_tiles() gives them; layers: region, feature, year. Points that share region, year and pixel are looked up once, so a
    tile meets at most size * size of them for each year. Which layers and tiles are asked for is a small table that prunes
    the partitions at run time. NULL where the region has no such layer, the pixel has no data or lies outside.
    """
    keys = ["region", "year", "row_id", "col_id"]
    spots = saved(points.select(*keys).distinct())
    wanted = spots.select("region", "year").distinct().join(layers.where(F.col("feature").isin(*features)).select("region", "feature").distinct(), "region")
    chosen = saved(nearest_year(wanted, layers))
    at = spots.join(F.broadcast(chosen), ["region", "year"]).withColumns({"tile_r": F.floor(F.col("row_id") / size), "tile_c": F.floor(F.col("col_id") / size)})
    at = at.withColumn("place", ((F.pmod("row_id", F.lit(size))) * size + F.pmod("col_id", F.lit(size)) + 1).cast("int"))
    tile = ["region", "feature", "layer_year", "tile_r", "tile_c"]
    asked = saved(at.select(*tile).distinct())
    read = tiles.withColumnRenamed("year", "layer_year")
    if asked.limit(1_000_001).count() <= 1_000_000:  # the comparison lets Spark turn the keys into a filter on partitions
        read = read.join(F.broadcast(asked.where(F.col("layer_year") > -1_000_000)), tile, "left_semi")
    hits = at.join(read, tile).select(*keys, "feature", unmasked(F.element_at("data", F.col("place"))).alias("value"))
    wide = hits.groupBy(*keys).agg(*(F.max(F.when(F.col("feature") == f, F.col("value"))).alias(f) for f in features))
    return points.join(wide, keys, "left")


def valid_year(chosen: DataFrame, health: DataFrame) -> DataFrame:
    """chosen with layer_year replaced by the feature's latest valid year where its own choice is invalid (health: feature, year, valid)."""
    latest = health.where("valid").groupBy("feature").agg(F.max("year").alias("latest_"))
    joined = chosen.join(F.broadcast(health.select("feature", F.col("year").alias("layer_year"), "valid")), ["feature", "layer_year"], "left").join(F.broadcast(latest), "feature", "left")
    return joined.withColumn("layer_year", F.when(F.col("valid"), F.col("layer_year")).otherwise(F.col("latest_"))).drop("valid", "latest_")


def newest_usable(samples: DataFrame, least: float = 0.05) -> DataFrame:
    """feature and the newest year in which at least this share of the sampled values is valid (samples: feature, year, value)."""
    share = samples.groupBy("feature", "year").agg(F.avg(unmasked(F.col("value")).isNotNull().cast("double")).alias("share"))
    return share.where(F.col("share") >= least).groupBy("feature").agg(F.max("year").alias("year"))


def health(rows: DataFrame, keys: tuple[str, ...] = ("feature",), least: float = 0.01) -> DataFrame:
    """Size, valid count and share, distinct values and an empty flag (share below `least`) of each layer."""
    value = unmasked(F.col("value"))
    out = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(value).alias("n_valid"), F.countDistinct(value).alias("n_distinct"))
    return out.withColumn("share", F.col("n_valid") / F.col("n")).withColumn("empty", F.col("n_valid") / F.col("n") < least)


def gaps(regions: DataFrame, years: DataFrame, features: DataFrame, present: DataFrame, unavailable: DataFrame, static: tuple[str, ...] = (), base_year: int = 2016) -> DataFrame:
    """Expected (region, year, feature) that are neither known to be unavailable nor present; static features only in the base year."""
    expected = regions.crossJoin(years).crossJoin(features).where(~F.col("feature").isin(*static) | (F.col("year") == base_year) if static else F.lit(True))
    return expected.join(unavailable, ["year", "feature"], "left_anti").join(present, ["region", "year", "feature"], "left_anti")


def carried_forward(layers: DataFrame, years: DataFrame, base_year: int, static: tuple[str, ...]) -> DataFrame:
    """layers and, for years without a static layer, its base-year rows."""
    base = layers.where((F.col("year") == base_year) & F.col("feature").isin(*static)).drop("year").crossJoin(F.broadcast(years))
    keys = ["region", "year", "feature"]
    return layers.unionByName(base.join(layers.select(*keys).distinct(), keys, "left_anti").select(*layers.columns))


def common_features(present: DataFrame) -> DataFrame:
    """Features that every region has."""
    n = present.agg(F.count_distinct("region").alias("n_"))
    return present.groupBy("feature").agg(F.count_distinct("region").alias("k_")).crossJoin(F.broadcast(n)).where("k_ = n_").select("feature")


def patches(centres: DataFrame, pixels: DataFrame, key: str, value: str, side: int, fill: int = 0) -> DataFrame:
    """key, patch: the flat side x side window of `value` around each centre (row_id, col_id), row by row, `fill` outside.

    A centre goes to the (at most four) tiles of the window's own size that it overlaps; tiles and centres meet by key.
    """
    half = side // 2
    top, left = F.col("row_id") - half, F.col("col_id") - half
    at = centres.select(key, top.alias("top_"), left.alias("left_"))
    tiles = lambda c: F.sequence(F.floor(F.col(c) / side), F.floor((F.col(c) + side - 1) / side))
    at = at.withColumn("tr_", F.explode(tiles("top_"))).withColumn("tc_", F.explode(tiles("left_")))
    cells = pixels.select(F.floor(F.col("row_id") / side).alias("tr_"), F.floor(F.col("col_id") / side).alias("tc_"), "row_id", "col_id", F.coalesce(unmasked(F.col(value)), F.lit(fill)).alias("v_"))
    inside = F.col("row_id").between(F.col("top_"), F.col("top_") + side - 1) & F.col("col_id").between(F.col("left_"), F.col("left_") + side - 1)
    found = dense(at.join(cells, ["tr_", "tc_"]).where(inside), (key,), F.col("row_id") - F.col("top_"), F.col("col_id") - F.col("left_"), F.col("v_"), side, fill)
    whole = centres.select(key).join(found, key, "left")
    return whole.select(key, F.coalesce("data", F.array_repeat(F.lit(fill), side * side)).alias("patch"))


def aligned(reference: DataFrame, source: DataFrame, scale: float, row_shift: float = 0.0, col_shift: float = 0.0) -> DataFrame:
    """reference pixels with the value of the source pixel under their centre; a source pixel is `scale` reference pixels wide.

    Source pixels outside the reference's extent (one row) stay out of the shuffle; both sides are dealt by the source pixel.
    """
    at = lambda c, s: F.floor((F.col(c) + 0.5 - s) / scale)
    keyed = reference.withColumn("sr_", at("row_id", row_shift)).withColumn("sc_", at("col_id", col_shift))
    kept = source.select(F.col("row_id").alias("sr_"), F.col("col_id").alias("sc_"), "value")
    span = keyed.agg(*(f(c).alias(f"{n}_{c}") for n, f in (("lo", F.min), ("hi", F.max)) for c in ("sr_", "sc_")))
    kept = kept.join(F.broadcast(span), F.col("sr_").between(F.col("lo_sr_"), F.col("hi_sr_")) & F.col("sc_").between(F.col("lo_sc_"), F.col("hi_sc_"))).select("sr_", "sc_", "value")
    return keyed.join(kept.hint("merge"), ["sr_", "sc_"], "left").drop("sr_", "sc_")


def window(lon: tuple[float, float], lat: tuple[float, float], rows: int, cols: int, pad: int = 32, top: float = 48.0, left: float = -74.0, res: float = 0.01) -> tuple[int, int, int, int]:
    """Padded row and column range of a box, clamped to the raster: first and last row, first and last column."""
    r = [int((top - y) // res) for y in lat]
    c = [int((x - left) // res) for x in lon]
    return max(0, min(r) - pad), min(rows - 1, max(r) + pad), max(0, min(c) - pad), min(cols - 1, max(c) + pad)


def centre_grid(pixels: DataFrame, stride: int, bounds: tuple[int, int, int, int] | None = None, value: str = "evt", top: float = 48.0, left: float = -74.0, res: float = 0.01) -> DataFrame:
    """Scoring centres every `stride` pixels whose own pixel has data, with their place in the grid and on the map."""
    r0, r1, c0, c1 = bounds or (0, 2**31 - 1, 0, 2**31 - 1)
    on = pixels.where(F.col("row_id").between(r0, r1) & F.col("col_id").between(c0, c1) & ((F.col("row_id") - r0) % stride == 0) & ((F.col("col_id") - c0) % stride == 0))
    on = on.where(unmasked(F.col(value)).isNotNull())
    grid = lambda c, o: ((F.col(c) - o) / stride).cast("int")
    return on.withColumns({"grid_row": grid("row_id", r0), "grid_col": grid("col_id", c0), "lon": left + (F.col("col_id") + 0.5) * res, "lat": top - (F.col("row_id") + 0.5) * res})


def stretched(df: DataFrame, column: str, low: float = 0.02, high: float = 0.98, power: float = 3.0, floor: float | None = None) -> DataFrame:
    """df with `shade` (0 to 1): percentile stretch, then a power; NULL below `floor`."""
    cut = quantiles(df, column, (low, high)).withColumnRenamed("cuts_", "cut_")
    span = F.greatest(F.col("cut_")[1] - F.col("cut_")[0], F.lit(1e-12))
    shade: Column = F.pow(F.greatest(F.least((F.col(column) - F.col("cut_")[0]) / span, F.lit(1.0)), F.lit(0.0)), F.lit(power))
    shown = F.col(column).isNotNull() & (F.lit(True) if floor is None else F.col(column) >= floor)
    return df.crossJoin(F.broadcast(cut)).withColumn("shade", F.when(shown, shade)).drop("cut_")


def last_first(df: DataFrame, key: tuple[str, ...], order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("rn_", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(order)))).where("rn_ = 1").drop("rn_")
