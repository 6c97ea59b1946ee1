"""Queries over point records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geo import albers_sql, block_id, hash_share, projected
from ..operators import points as P
from ..operators import sampling as S
from ..operators.ranks import running
from .fixtures import FX, fx, with_fx
from .registry import query

X, Y = albers_sql("lon", "lat")
REG = with_fx("fx_regions", "fx_sightings")
IN_BOX = "lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat"
CLIP = f"{REG}, clip AS (SELECT s.*, region FROM fx_sightings s JOIN fx_regions ON {IN_BOX})"
COLLAPSED = f"""{CLIP}, w AS (SELECT *, row_number() OVER (k ORDER BY year DESC, sid) AS rn, count(*) OVER k AS n_visits, min(year) OVER k AS first_year, max(year) OVER k AS last_year
  FROM clip WINDOW k AS (PARTITION BY region, round(lon, 5), round(lat, 5))), coll AS (SELECT * EXCLUDE (rn) FROM w WHERE rn = 1)"""
PROJ = f"{COLLAPSED}, proj AS (SELECT *, {X} AS x, {Y} AS y FROM coll)"


def clipped(spark, sf):
    return P.clipped(fx(spark, sf, "fx_sightings"), fx(spark, sf, "fx_regions"))


def habitat_points(spark, sf):
    return projected(P.collapsed(clipped(spark, sf)))


@query(f"{CLIP} SELECT region, count(*) AS n, min(sid) AS lo, max(sid) AS hi FROM clip GROUP BY region")
def clip_regions(spark, sf):
    """Sign repair, then the inclusive clip; a point may fall into several regions."""
    boxes = fx(spark, sf, "fx_regions")
    turned = fx(spark, sf, "fx_sightings").withColumn("lon", -F.col("lon"))
    return P.clipped(P.sign_repaired(turned, boxes), boxes).groupBy("region").agg(F.count("*").alias("n"), F.min("sid").alias("lo"), F.max("sid").alias("hi"))


@query(f"""{REG} SELECT region, CAST(count(*) FILTER ({IN_BOX}) AS BIGINT) AS as_is, CAST(count(*) FILTER (-lon BETWEEN min_lon AND max_lon AND lat BETWEEN min_lat AND max_lat) AS BIGINT) AS flipped,
  CAST(count(*) FILTER (lat BETWEEN min_lon AND max_lon AND lon BETWEEN min_lat AND max_lat) AS BIGINT) AS swapped, min(lon) AS lo_lon, max(lon) AS hi_lon FROM fx_sightings CROSS JOIN fx_regions GROUP BY region""")
def clip_diagnostics(spark, sf):
    """B4."""
    return P.clip_diagnostics(fx(spark, sf, "fx_sightings"), fx(spark, sf, "fx_regions"))


@query(f"{COLLAPSED} SELECT region, sid, year, n_visits, first_year, last_year FROM coll")
def collapse_visits(spark, sf):
    """D1, C7."""
    return P.collapsed(clipped(spark, sf)).select("region", "sid", "year", "n_visits", "first_year", "last_year")


@query(f"{PROJ} SELECT region, sid, round(x, 3) AS x, round(y, 3) AS y FROM proj")
def albers_projection(spark, sf):
    """B11."""
    return habitat_points(spark, sf).select("region", "sid", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"))


@query(f"{CLIP} SELECT region, round(min(lon) - 0.1, 6) AS min_lon, round(min(lat) - 0.1, 6) AS min_lat, round(max(lon) + 0.1, 6) AS max_lon, round(max(lat) + 0.1, 6) AS max_lat FROM clip GROUP BY region")
def region_extent(spark, sf):
    """Observed extent plus a margin."""
    side = lambda f, c, m, n: F.round(f(c) + m, 6).alias(n)
    return clipped(spark, sf).groupBy("region").agg(side(F.min, "lon", -0.1, "min_lon"), side(F.min, "lat", -0.1, "min_lat"), side(F.max, "lon", 0.1, "max_lon"), side(F.max, "lat", 0.1, "max_lat"))


BLOCKS = f"""{PROJ}, org AS (SELECT region, min(x) AS x0, min(y) AS y0 FROM proj GROUP BY region),
blk AS (SELECT p.*, CAST(floor((x - x0) / 3000e0) AS BIGINT) || '_' || CAST(floor((y - y0) / 3000e0) AS BIGINT) AS block_id FROM proj p JOIN org USING (region))"""


def blocked(spark, sf):
    pts = habitat_points(spark, sf)
    origin = pts.groupBy("region").agg(F.min("x").alias("x0"), F.min("y").alias("y0"))
    return pts.join(F.broadcast(origin), "region").withColumn("block_id", block_id(F.col("x"), F.col("y"), F.col("x0"), F.col("y0")))


@query(f"{BLOCKS} SELECT region, block_id, count(*) AS n FROM blk GROUP BY region, block_id")
def spatial_blocks(spark, sf):
    """B20."""
    return blocked(spark, sf).groupBy("region", "block_id").agg(F.count("*").alias("n"))


HASH = """CAST(((('0x' || substr(md5('42:' || block_id), 1, 16))::UBIGINT % 10000) * 1616 + ('0x' || substr(md5('42:' || block_id), 17, 16))::UBIGINT % 10000) % 10000 AS INT)"""


HOLDOUT = f"""{BLOCKS}, cnt AS (SELECT region, block_id, count(*) AS c FROM blk GROUP BY region, block_id),
hold AS (SELECT region, block_id, CASE WHEN coalesce(sum(c) OVER (PARTITION BY region ORDER BY md5('42:' || block_id), block_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < round_even(sum(c) OVER (PARTITION BY region) * 0.2, 0) THEN 'val' ELSE 'train' END AS split FROM cnt)"""


@query(f"{HOLDOUT} SELECT region, block_id, split FROM hold")
def block_holdout(spark, sf):
    """E3, G5, within each region."""
    return S.block_holdout(blocked(spark, sf), group=("region",))


@query(f"{BLOCKS} SELECT DISTINCT region, block_id, {HASH} AS share FROM blk")
def hash_split(spark, sf):
    """The md5 remainder that splits blocks without positives, by region and block."""
    return blocked(spark, sf).select("region", "block_id").distinct().withColumn("share", hash_share(42, F.col("block_id")))


CANDIDATES = FX["fx_candidates"]


@query(f"""{HOLDOUT}, cand AS (SELECT region, {X} AS x, {Y} AS y FROM ({CANDIDATES}) JOIN fx_regions ON {IN_BOX}),
b AS (SELECT DISTINCT region, CAST(floor((x - x0) / 3000e0) AS BIGINT) || '_' || CAST(floor((y - y0) / 3000e0) AS BIGINT) AS block_id FROM cand JOIN org USING (region) UNION SELECT region, block_id FROM blk),
part AS (SELECT region, avg(CASE WHEN split = 'val' THEN 1e0 ELSE 0e0 END) AS val FROM hold GROUP BY region)
SELECT b.region, b.block_id, coalesce(hold.split, CASE WHEN {HASH.replace("block_id", "b.block_id")} < part.val * 10000 THEN 'val' ELSE 'train' END) AS split FROM b JOIN part USING (region) LEFT JOIN hold ON hold.region = b.region AND hold.block_id = b.block_id""")
def split_lookup(spark, sf):
    """C15 within each region: the blocks of sightings and of candidates, which may have no sighting and are then drawn by hash."""
    pts = habitat_points(spark, sf)
    origin = F.broadcast(pts.groupBy("region").agg(F.min("x").alias("x0"), F.min("y").alias("y0")))
    named = lambda df: df.join(origin, "region").select("region", block_id(F.col("x"), F.col("y"), F.col("x0"), F.col("y0")).alias("block_id"))
    mine = named(pts)
    others = named(projected(P.clipped(fx(spark, sf, "fx_candidates"), fx(spark, sf, "fx_regions"))))
    return S.with_split(mine.unionByName(others).distinct(), S.block_holdout(mine, group=("region",)), group=("region",)).select("region", "block_id", "split")


@query(f"""{CLIP}, tag AS (SELECT c.*, unnest(['all', CASE WHEN year >= 2020 THEN 'recent' END, CASE WHEN sid % 4 = 0 THEN 'quarter' END]) AS subset FROM clip c),
g AS (SELECT region, subset, round(lon, 5) AS a, round(lat, 5) AS b, count(*) AS n FROM tag WHERE subset IS NOT NULL GROUP BY ALL)
SELECT region, subset, CAST(sum(n) AS BIGINT) AS records, count(*) AS locations, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS repeated, max(n) AS most FROM g GROUP BY region, subset""")
def duplicate_summary(spark, sf):
    """Repeat locations of several subsets in one pass."""
    tags = F.array(F.lit("all"), F.when(F.col("year") >= 2020, "recent"), F.when(F.col("sid") % 4 == 0, "quarter"))
    g = clipped(spark, sf).withColumn("subset", F.explode(F.filter(tags, lambda t: t.isNotNull()))).groupBy("region", "subset", F.round("lon", 5), F.round("lat", 5)).agg(F.count("*").alias("n"))
    return g.groupBy("region", "subset").agg(F.sum("n").alias("records"), F.count("*").alias("locations"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"), F.max("n").alias("most"))


@query(f"{CLIP} SELECT region, round(lon, 5) AS lon, round(lat, 5) AS lat, count(*) AS n, min(year) AS first_year, max(year) AS last_year FROM clip GROUP BY 1, 2, 3 ORDER BY n DESC, region, lon, lat LIMIT 20")
def top_reused_locations(spark, sf):
    """the feature is a top-k report."""
    g = clipped(spark, sf).groupBy("region", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat")).agg(F.count("*").alias("n"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return g.orderBy(F.desc("n"), "region", "lon", "lat").limit(20)


@query(f"{COLLAPSED} SELECT sid % 7 = 0 AS exotic, median(n_visits) AS median_visits, round(avg(n_visits), 9) AS mean_visits, round(100e0 * avg(CASE WHEN n_visits > 1 THEN 1e0 ELSE 0e0 END), 9) AS multi_pct FROM coll GROUP BY 1")
def visit_concentration(spark, sf):
    """D16."""
    multi = F.round(100 * F.avg((F.col("n_visits") > 1).cast("double")), 9)
    return P.collapsed(clipped(spark, sf)).groupBy((F.col("sid") % 7 == 0).alias("exotic")).agg(F.percentile("n_visits", F.lit(0.5)).alias("median_visits"), F.round(F.avg("n_visits"), 9).alias("mean_visits"), multi.alias("multi_pct"))


def kde_sql(extra: str = "0e0", dims: int = 2, where: str = "true", strata: str = "") -> str:
    norm = f"pow(2 * pi(), {dims / 2!r}) * pow(3000e0, {dims})"
    by = f"PARTITION BY region{strata and ', ' + strata}"
    same = "AND a.region = b.region" + (f" AND a.{strata} = b.{strata}" if strata else "")
    return f"""dens AS (SELECT a.region, a.sid, sum(exp(-((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + {extra}) / (2 * 9e6))) / (any_value(b.n) * {norm}) AS density, any_value(b.n) AS n
      FROM pts a JOIN (SELECT *, count(*) OVER ({by}) AS n FROM pts) b ON abs(a.x - b.x) <= 18000 AND abs(a.y - b.y) <= 18000 {same} AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 324e6 WHERE {where} GROUP BY a.region, a.sid)"""


PTS = f"{PROJ}, pts AS (SELECT *, sid % 3 AS phys FROM proj)"


def classed(spark, sf):
    return habitat_points(spark, sf).withColumn("phys", F.col("sid") % 3)


ZONES = "CASE WHEN density >= quantile_cont(density, 0.9) OVER (PARTITION BY region) THEN 'Hot' WHEN density <= quantile_cont(density, 0.1) OVER (PARTITION BY region) THEN 'Cold' ELSE 'Moderate' END"


def shown(df):
    return df.select("region", "sid", F.round(F.col("density") * 1e12, 3).alias("density"))


@query(f"{PTS}, {kde_sql()} SELECT region, sid, round(density * 1e12, 3) AS density FROM dens")
def kde_spatial(spark, sf):
    """D7, within each region."""
    return shown(P.density(classed(spark, sf), "sid", strata=("region",), least=0))


@query(f"{PTS}, {kde_sql()} SELECT region, zone AS spatial_zone, count(*) AS n FROM (SELECT region, {ZONES} AS zone FROM (SELECT region, round(density * 1e12, 3) AS density FROM dens)) GROUP BY ALL")
def kde_zones(spark, sf):
    """Records in each zone; densities are rounded before the deciles, as they are shown."""
    dens = shown(P.density(classed(spark, sf), "sid", strata=("region",), least=0))
    return P.zoned(dens, strata=("region",)).groupBy("region", "spatial_zone").agg(F.count("*").alias("n"))


@query(f"{PTS}, {kde_sql(strata='phys')} SELECT region, sid, round(CASE WHEN n >= 30 THEN density * 1e12 END, 3) AS density FROM dens")
def kde_stratified(spark, sf):
    """D9."""
    return shown(P.density(classed(spark, sf), "sid", strata=("region", "phys")))


Z = "((a.year - b.year) / a.dev * 3000e0)"
PTS_DEV = f"{PROJ}, pts AS (SELECT *, CASE WHEN stddev_pop(year) OVER (PARTITION BY region) = 0 THEN 1 ELSE stddev_pop(year) OVER (PARTITION BY region) END AS dev FROM proj)"


@query(f"{PTS_DEV}, {kde_sql(extra=f'{Z} * {Z}', dims=3)} SELECT region, sid, round(density * 1e15, 3) AS density FROM dens")
def kde_joint(spark, sf):
    """With a standardised third axis."""
    return P.density(classed(spark, sf), "sid", strata=("region",), extra=("year",), least=0).select("region", "sid", F.round(F.col("density") * 1e15, 3).alias("density"))


def _surface(by: str) -> str:
    same = " AND ".join(f"g.{c} = p.{c}" for c in by.split(", "))
    return f"""grid AS (SELECT {by}, i, j, x0 + i * (x1 - x0) / 149 AS x, y0 + j * (y1 - y0) / 149 AS y FROM (SELECT {by}, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM pts GROUP BY {by} HAVING count(*) >= 20), (SELECT unnest(range(150)) AS i), (SELECT unnest(range(150)) AS j)),
    s AS (SELECT {', '.join('g.' + c for c in by.split(', '))}, i, j, sum(exp(-((g.x - p.x) * (g.x - p.x) + (g.y - p.y) * (g.y - p.y)) / (2 * 9e6))) AS d FROM grid g JOIN pts p ON {same} AND (g.x - p.x) * (g.x - p.x) + (g.y - p.y) * (g.y - p.y) <= 324e6 GROUP BY ALL),
    top AS (SELECT *, max(d) OVER (PARTITION BY {by}) AS top FROM s)"""


#: Nodes a side of a density surface.
NODES = 150


def surface(points, by, n=NODES, least=20):
    """For each class with enough points a regular grid over their extent and the density summed at its nodes, with the class's greatest (top)."""
    box = points.groupBy(*by).agg(F.count("*").alias("many"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    at = lambda lo, hi, k: F.col(lo) + F.col(k) * (F.col(hi) - F.col(lo)) / (n - 1)
    grid = box.where(F.col("many") >= least).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    grid = grid.select(*by, "i", "j", at("x0", "x1", "i").alias("x"), at("y0", "y1", "j").alias("y"))
    near = P.pairs_within(grid, points.select(*by, "x", "y"), P.CUTOFF * P.BANDWIDTH, same=by)
    s = P.saved(near.groupBy(*by, "i", "j").agg(F.sum(F.exp(-(F.col("distance") ** 2) / (2 * P.BANDWIDTH**2))).alias("d")))
    return s.join(F.broadcast(s.groupBy(*by).agg(F.max("d").alias("top"))), list(by))


@query(f"""{PTS}, {_surface('region')}, ranked AS (SELECT *, 22500 - count(*) OVER (PARTITION BY region) + row_number() OVER (PARTITION BY region ORDER BY round(d, 6), i, j) - 1 AS pos FROM top)
SELECT region, CAST(i AS INT) AS i, CAST(j AS INT) AS j, round(d, 6) AS d, round(100e0 * pos / 22499, 6) AS pct FROM ranked WHERE d >= 0.005 * top""")
def density_surface(spark, sf):
    """Percentile rank (0 to 100) of the density over all nodes, those without any come first, with the mask at half a percent of the greatest value."""
    s = surface(classed(spark, sf), ("region",)).withColumn("shown", F.round("d", 6))
    ranked = running(s, ["shown", "i", "j"], ("region",)).join(F.broadcast(s.groupBy("region").agg(F.count("*").alias("some"))), "region")
    pct = 100.0 * (NODES * NODES - F.col("some") + F.col("pos_") - 1) / (NODES * NODES - 1)
    return ranked.where("d >= 0.005 * top").select("region", "i", "j", F.col("shown").alias("d"), F.round(pct, 6).alias("pct"))


@query(f"{PTS}, cnt AS (SELECT region, CAST(floor(x / 3000e0) AS BIGINT) AS bx, count(*) AS n FROM pts GROUP BY 1, 2) SELECT region, bx, n, round(100e0 * (row_number() OVER (PARTITION BY region ORDER BY n, bx) - 1) / greatest(count(*) OVER (PARTITION BY region) - 1, 1), 9) AS pct FROM cnt")
def percentile_rank(spark, sf):
    """Rank 0 to 100 within the region, with the cell's id as tie-break."""
    cnt = classed(spark, sf).groupBy("region", F.floor(F.col("x") / 3000).alias("bx")).agg(F.count("*").alias("n"))
    ranked = running(cnt, ["n", "bx"], ("region",))
    total = cnt.groupBy("region").agg(F.count("*").alias("t"))
    pct = 100 * (F.col("pos_") - 1) / F.greatest(F.col("t") - 1, F.lit(1))
    return ranked.join(F.broadcast(total), "region").select("region", "bx", "n", F.round(pct, 9).alias("pct"))


@query(f"{PTS}, {_surface('region, phys')} SELECT region, phys, level, count(*) AS nodes FROM top, (SELECT unnest([0.35e0, 0.6e0, 0.85e0]) AS level) WHERE d >= level * top GROUP BY ALL")
def rare_contours(spark, sf):
    """The surface of each class with at least 20 records and its contour levels."""
    s = surface(classed(spark, sf), ("region", "phys"))
    levels = F.explode(F.array(*(F.lit(x) for x in (0.35, 0.6, 0.85))))
    return s.withColumn("level", levels).where("d >= level * top").groupBy("region", "phys", "level").agg(F.count("*").alias("nodes"))


@query(None)
def thin_by_spacing(spark, sf):
    """C14: maximal subset at least 30 m apart (a record in several regions counts once); tests compare it with taking records in order."""
    return P.thinned(habitat_points(spark, sf).select("sid", "year", "x", "y").dropDuplicates(["sid"]), "sid", 30.0).select("sid", "year")
