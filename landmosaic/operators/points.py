"""Point records: region clipping, repeat visits, distance joins, thinning and kernel density."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.binning import zone
from ..functions.geo import cells
from .kernel import summed
from .nearest import closest
from .ranks import quantiles
from .shared import saved, shared_folder

BANDWIDTH = 3000.0
CUTOFF = 6.0


def regions(spark: SparkSession) -> DataFrame:
    """The region boxes (fixed values); they overlap, so a point may be in several."""
    rows = [("ME", -71.158, 42.889, -66.852, 47.555), ("NH", -72.626, 42.605, -70.600, 45.398), ("VT", -73.510, 42.632, -71.422, 45.112)]
    return spark.createDataFrame(rows, "region string, min_lon double, min_lat double, max_lon double, max_lat double")


def _inside(lon, lat):
    return lon.between(F.col("min_lon"), F.col("max_lon")) & lat.between(F.col("min_lat"), F.col("max_lat"))


def sign_repaired(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """All longitudes negated if over 90 % are positive and a negated one hits some box. One broadcast row decides."""
    hit = df.join(F.broadcast(boxes), _inside(-F.col("lon"), F.col("lat"))).limit(1).agg((F.count("*") > 0).alias("hit_"))
    share = df.agg(F.avg((F.col("lon") > 0).cast("double")).alias("share_"))
    flag = share.crossJoin(hit).select((F.coalesce(F.col("share_") > 0.9, F.lit(False)) & F.col("hit_")).alias("flip_"))
    return df.crossJoin(F.broadcast(flag)).withColumn("lon", F.when(F.col("flip_"), -F.col("lon")).otherwise(F.col("lon"))).drop("flip_")


def clipped(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """A row for each box (inclusive) that holds the point."""
    return df.dropna(subset=["lon", "lat"]).join(F.broadcast(boxes), _inside(F.col("lon"), F.col("lat"))).drop("min_lon", "min_lat", "max_lon", "max_lat")


def clip_diagnostics(df: DataFrame, boxes: DataFrame) -> DataFrame:
    """By region: how many points lie inside as they are, with the sign flipped, and with the axes swapped."""
    many = lambda lon, lat: F.sum(F.when(_inside(lon, lat), 1).otherwise(0)).alias
    lon, lat = F.col("lon"), F.col("lat")
    return df.crossJoin(F.broadcast(boxes)).groupBy("region").agg(many(lon, lat)("as_is"), many(-lon, lat)("flipped"), many(lat, lon)("swapped"), F.min("lon").alias("lo_lon"), F.max("lon").alias("hi_lon"))


def collapsed(df: DataFrame, key: tuple[str, ...] = ("region",), places: int = 5) -> DataFrame:
    """One row per rounded location: the latest year's first row, with n_visits, first_year, last_year; one shuffle.

    An aggregation, not a window, so the records of a much used pin are combined within tasks before the shuffle.
    """
    counts = {"n_visits": F.count("*"), "first_year": F.min("year"), "last_year": F.max("year")}
    row = F.struct(*(c for c in df.columns if c not in counts))
    order = F.struct(F.col("year").isNull(), -F.col("year"), "sid")  # years descending, those without one last
    at = [*(F.col(c).alias(f"at_{c}") for c in key), F.round("lon", places).alias("at_lon"), F.round("lat", places).alias("at_lat")]
    return df.groupBy(*at).agg(F.min_by(row, order).alias("row_"), *(v.alias(c) for c, v in counts.items())).select("row_.*", *counts)


def _finite():
    """Whether x and y are there and finite."""
    return F.coalesce((F.abs("x") < float("inf")) & (F.abs("y") < float("inf")), F.lit(False))


def pairs_within(a: DataFrame, b: DataFrame, radius: float, same: tuple[str, ...] = ()) -> DataFrame:
    """Rows of a joined to rows of b at most radius away (distance) that agree in `same`, by grid cells; other columns of both need distinct names but x, y."""
    left = cells(a, radius)
    right = cells(b.withColumnsRenamed({"x": "bx", "y": "by"}).withColumns({"x": F.col("bx"), "y": F.col("by")}), radius, neighbours=True).drop("x", "y")
    d = F.sqrt((F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2)
    return left.join(right, [*same, "cx", "cy"]).withColumn("distance", d).where(F.col("distance") <= radius).drop("cx", "cy", "bx", "by")


def nearest_within(a: DataFrame, b: DataFrame, key: str, radius: float) -> DataFrame:
    """a with the distance of its nearest row of b within the radius, NULL where there is none."""
    return a.join(_nearest(a, b, key, radius), key, "left")


def _nearest(a: DataFrame, b: DataFrame, key: str, radius: float) -> DataFrame:
    """key, distance of the rows of a that have a row of b within the radius, the least of a repeated key.

    A cell's rows of a meet the distinct locations of b in and around it in one task, boxes before points, so the work
    doesn't grow with the number of pairs.
    """
    size = 3 * radius  # b goes to the cells that its circle's box touches, one to four
    cell = lambda c, by=0.0: F.floor((F.col(c) + by) / size)
    reach = lambda c: F.explode(F.sequence(cell(c, -radius), cell(c, radius)))
    there = _finite()
    left = a.select(key, "x", "y").where(there).withColumns({"cx": cell("x"), "cy": cell("y")}).groupBy("cx", "cy")
    right = b.select("x", "y").where(there).distinct().withColumn("cx", reach("x")).withColumn("cy", reach("y")).groupBy("cx", "cy")

    def run(mine: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found = closest(*(df[c].to_numpy() for df in (mine, others) for c in "xy"), radius)
        near = found <= radius
        return pd.DataFrame({key: mine[key][near], "distance": found[near]})

    out = StructType([a.schema[key], StructField("distance", DoubleType())])
    return left.cogroup(right).applyInPandas(run, out).groupBy(key).agg(F.min("distance").alias("distance"))


def buffered_out(a: DataFrame, b: DataFrame, key: str, radius: float = 300.0) -> DataFrame:
    """Rows of a that are farther than the radius from every row of b."""
    return a.join(_nearest(a, b, key, radius), key, "left_anti")


def thinned(df: DataFrame, key: str, spacing: float, priority=None) -> DataFrame:
    """A maximal subset whose members are at least `spacing` apart: what taking rows in order of priority would keep.

    Rounds in parallel: a row that comes first among its undecided neighbours stays and removes them. Cells are so small that all
    rows of one are neighbours, so only a cell's first row can stay: it meets the first rows of the 25 cells around it, and if it comes before
    them, all rows there. Neighbour pairs are never kept or shuffled; each round is written. Ties in priority go by the key.
    """
    if spacing <= 0:
        return df
    side = spacing / 1.5
    rank = F.struct((F.xxhash64(key) if priority is None else priority).alias("p"), F.col(key).alias("k"))
    placed = _finite()
    points = df.withColumn("rank_", rank).select(key, "rank_", "x", "y")
    kept = points.where(~placed).select(key)
    left = saved(points.where(placed).withColumns({"cx": F.floor(F.col("x") / side), "cy": F.floor(F.col("y") / side)}))
    shift = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3))))
    moved = {"cx": F.col("cx") + F.col("o.i"), "cy": F.col("cy") + F.col("o.j")}
    d = F.sqrt((F.col("x") - F.col("fx")) ** 2 + (F.col("y") - F.col("fy")) ** 2)

    def around(first: DataFrame, others: DataFrame) -> DataFrame:
        """first's rows (first_, first_rank_) and the others closer than the spacing, themselves included."""
        spread = first.select(F.col(key).alias("first_"), F.col("rank_").alias("first_rank_"), F.col("x").alias("fx"), F.col("y").alias("fy"), "cx", "cy", shift.alias("o")).withColumns(moved).drop("o")
        return others.join(spread, ["cx", "cy"]).where(d < spacing)

    def unbeaten(first: DataFrame, others: DataFrame) -> DataFrame:
        beaten = around(first, others).where(F.col("rank_") < F.col("first_rank_")).select(F.col("first_").alias(key)).distinct()
        return saved(first.join(beaten, key, "left_anti"))

    while not left.isEmpty():
        first = saved(left.groupBy("cx", "cy").agg(F.min_by(F.struct(key, "rank_", "x", "y"), "rank_").alias("f")).select("f.*", "cx", "cy"))
        stay = unbeaten(unbeaten(first, first), left)
        gone = around(stay, left).select(key).distinct()
        kept = kept.union(stay.select(key))
        left = saved(left.join(gone, key, "left_anti"))
    return df.join(saved(kept), key, "left_semi")


def _paired(spots: DataFrame, strata: tuple[str, ...], axes: list[str], bandwidth: float) -> DataFrame:
    """kernel.summed() pair by pair."""
    radius = CUTOFF * bandwidth
    left = cells(spots.drop("many"), radius)
    right = cells(spots, radius, neighbours=True).select(*strata, F.col("x").alias("bx"), F.col("y").alias("by"), *(F.col(a).alias(f"b{a}") for a in axes), "many", "cx", "cy")
    flat = (F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("by")) ** 2
    whole = flat
    for a in axes:
        whole = whole + (F.col(a) - F.col(f"b{a}")) ** 2
    pairs = left.join(right.hint("merge"), [*strata, "cx", "cy"]).where(flat <= radius * radius)
    return pairs.groupBy(*strata, "x", "y", *axes).agg(F.sum(F.col("many") * F.exp(-whole / (2 * bandwidth**2))).alias("s_"))


def density(df: DataFrame, key: str, strata: tuple[str, ...] = (), extra: tuple[str, ...] = (), bandwidth: float = BANDWIDTH, least: int = 30) -> DataFrame:
    """df with a Gaussian kernel density at its points, within the cutoff of 6 bandwidths.

    strata: densities within classes, NULL in classes under `least` rows. extra: further axes standardised within the
    classes (population deviation, 0 counts as 1), scaled by the bandwidth. Equal locations are one weighted point before the join, so a hot
    pin isn't joined with itself row by row; pairs meet by cell, and crowded cells by their nodes (kernel.summed). No point goes through the driver.
    """
    scaled = df
    if extra:
        stats = df.groupBy(*strata).agg(*(F.avg(c).alias(f"m_{c}") for c in extra), *(F.when(F.stddev_pop(c) == 0, 1.0).otherwise(F.stddev_pop(c)).alias(f"s_{c}") for c in extra))
        scaled = (df.join(F.broadcast(stats), list(strata)) if strata else df.crossJoin(F.broadcast(stats))).withColumns({f"z_{c}": (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}") * bandwidth for c in extra})
    axes = [f"z_{c}" for c in extra]
    where = [*strata, "x", "y", *axes]
    spots = saved(scaled.groupBy(*where).agg(F.count("*").alias("many")))
    totals = spots.groupBy(*strata).agg(F.sum("many").alias("n_")) if strata else spots.agg(F.sum("many").alias("n_"))
    sums = summed(spots, strata, axes, bandwidth, CUTOFF)
    if sums is None:
        sums = _paired(spots, strata, axes, bandwidth)
    norm = (2 * math.pi) ** ((2 + len(extra)) / 2) * bandwidth ** (2 + len(extra))
    sums = sums.join(F.broadcast(totals), list(strata)) if strata else sums.crossJoin(F.broadcast(totals))
    value = F.col("s_") / (F.col("n_") * norm)
    sums = sums.withColumn("density", F.when(F.col("n_") >= least, value) if strata else value).select(*where, "density")
    same = [scaled[c].eqNullSafe(sums[c]) for c in where]
    return scaled.join(sums.hint("merge"), same, "left").select(*(scaled[c] for c in df.columns), sums["density"])


def zoned(df: DataFrame, strata: tuple[str, ...] = ()) -> DataFrame:
    """df with spatial_zone by the deciles of its density, of all rows or within strata (exact, by selection); without a density Moderate.

    df is written, as the selection reads it twice and the zones once more; else a plan holds three copies of what made it.
    """
    df = saved(df)
    edges = quantiles(df, "density", (0.1, 0.9), strata).withColumnsRenamed({c: f"at_{c}" for c in strata})
    same = [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in strata]
    joined = df.join(F.broadcast(edges), same, "left") if strata else df.crossJoin(F.broadcast(edges))
    return joined.withColumn("spatial_zone", zone(F.col("density"), F.col("cuts_"))).drop("cuts_", *(f"at_{c}" for c in strata))


def visit_verdict(df: DataFrame, flag: str, group: tuple[str, ...] = (), more: float = 1.3, less: float = 0.7) -> DataFrame:
    """group, n, mean_visits, median_visits, multi_pct of the flagged records, others and mean_others of the rest, verdict (visited more, visited less, inconclusive).

    One aggregate of n_visits for both sides; the median is that of integers. A group without one of the sides has no row.
    """
    yes, v = F.col(flag), F.col("n_visits")
    mine = lambda c: F.when(yes, c)
    out = df.groupBy(*group).agg(
        F.count(mine(v)).alias("n"), F.avg(mine(v)).alias("mean_visits"), F.percentile(mine(v), F.lit(0.5)).alias("median_visits"), (100 * F.avg(mine((v > 1).cast("double")))).alias("multi_pct"),
        F.count(F.when(~yes, v)).alias("others"), F.avg(F.when(~yes, v)).alias("mean_others"),
    )
    verdict = F.when(F.col("mean_visits") > F.col("mean_others") * more, "visited more").when(F.col("mean_visits") < F.col("mean_others") * less, "visited less").otherwise("inconclusive")
    return out.where("n > 0 and others > 0").withColumn("verdict", verdict)
