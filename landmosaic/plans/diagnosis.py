"""Queries that judge the data: visits of exotic cover, reused pins by flag, balance of classes, missing years."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import envelopes as E
from ..operators import points as P
from ..operators import raster as R
from ..operators import sampling as S
from ..operators.shared import few
from .fixtures import FX, fx, with_fx
from .habitat import LABELLED, GOOD, PIX, SIGHT, SPATIAL, USED, pixels, spatially_zoned, used
from .negatives import drawn
from .points import IN_BOX, PROJ, clipped, habitat_points
from .registry import ORACLE_SQL, query


@query(f"""{USED}, v AS (SELECT region, phys ILIKE '%exotic%' OR evt = 7007 AS exotic, n_visits FROM used WHERE NOT nonveg OR evt = 7007), g AS (SELECT region, exotic, count(*) AS n, avg(n_visits) AS mean, median(n_visits) AS med, 100e0 * avg(CASE WHEN n_visits > 1 THEN 1e0 ELSE 0e0 END) AS multi FROM v GROUP BY 1, 2)
SELECT region, e.n, round(e.mean, 9) AS mean_visits, e.med AS median_visits, round(e.multi, 9) AS multi_pct, o.n AS others, round(o.mean, 9) AS mean_others, CASE WHEN e.mean > o.mean * 1.3 THEN 'visited more' WHEN e.mean < o.mean * 0.7 THEN 'visited less' ELSE 'inconclusive' END AS verdict
FROM (SELECT * FROM g WHERE exotic) e JOIN (SELECT * FROM g WHERE NOT exotic) o USING (region)""")
def visit_verdict(spark, sf):
    """Visits of a class of cover (by its meaning or code) against all other habitat records of the region, with the verdict."""
    rows = used(spark, sf).where("not nonveg or evt = 7007").withColumn("exotic", F.col("evt_phys").ilike("%exotic%") | (F.col("evt") == 7007))
    return P.visit_verdict(rows, "exotic", ("region",)).select("region", "n", F.round("mean_visits", 9).alias("mean_visits"), "median_visits", F.round("multi_pct", 9).alias("multi_pct"), "others", F.round("mean_others", 9).alias("mean_others"), "verdict")


FLAGS = """flagged AS (SELECT c.region, c.sid, c.year, round(c.lon, 5) AS lon, round(c.lat, 5) AS lat, a.nonveg FROM clip c LEFT JOIN avl a ON a.row_id = CAST(floor((48e0 - lat) / 0.01e0) AS INT) AND a.col_id = CAST(floor((lon + 74e0) / 0.01e0) AS INT))"""
FLAGGED = f"{PIX}, {SIGHT}, {GOOD}, {LABELLED}, {FLAGS}"


def flagged(spark, sf):
    """Every clipped sighting with its rounded location and nonveg (NULL without a layer there)."""
    at = R.indexed(clipped(spark, sf))
    spots = at.select("row_id", "col_id").distinct()
    flags = E.with_nonveg(R.classified(R.sampled(spots, pixels(spark, sf)), fx(spark, sf, "fx_crosswalk"))).groupBy("row_id", "col_id").agg(F.max("nonveg").alias("nonveg"))
    return at.join(few(P.saved(flags)), ["row_id", "col_id"], "left").select("region", "sid", "year", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), "nonveg")


@query(f"{FLAGGED} SELECT region, lon, lat, count(*) AS n, CAST(count(*) FILTER (nonveg) AS BIGINT) AS n_nonveg, min(year) AS first_year, max(year) AS last_year FROM flagged GROUP BY 1, 2, 3 HAVING count(*) > 1")
def reused_pins(spark, sf):
    """every location with several records, how many of these are flagged as non-vegetated, and its years."""
    g = flagged(spark, sf).groupBy("region", "lon", "lat").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("nonveg"), F.lit(False)).cast("long")).alias("n_nonveg"), F.min("year").alias("first_year"), F.max("year").alias("last_year"))
    return g.where("n > 1")


@query(f"""{FLAGGED}, tag AS (SELECT f.*, unnest(['all', CASE WHEN nonveg THEN 'nonveg' END, CASE WHEN NOT nonveg THEN 'habitat' END]) AS subset FROM flagged f), g AS (SELECT region, subset, lon, lat, count(*) AS n FROM tag WHERE subset IS NOT NULL GROUP BY ALL)
SELECT region, subset, CAST(sum(n) AS BIGINT) AS records, count(*) AS locations, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS repeated, max(n) AS most FROM g GROUP BY 1, 2""")
def duplicates_by_flag(spark, sf):
    """D15 on all, non-vegetated and habitat records."""
    tags = F.array(F.lit("all"), F.when(F.col("nonveg"), "nonveg"), F.when(~F.col("nonveg"), "habitat"))
    g = flagged(spark, sf).withColumn("subset", F.explode(F.filter(tags, lambda t: t.isNotNull()))).groupBy("region", "subset", "lon", "lat").agg(F.count("*").alias("n"))
    return g.groupBy("region", "subset").agg(F.sum("n").alias("records"), F.count("*").alias("locations"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"), F.max("n").alias("most"))


@query(f"""{SPATIAL}, {FLAGS}, hot AS (SELECT region, round(lon, 5) AS lon, round(lat, 5) AS lat FROM ue JOIN zn USING (region, sid) WHERE zone = 'Hot'),
g AS (SELECT f.region, CASE WHEN hot.lon IS NULL THEN 'elsewhere' ELSE 'hotspot' END AS subset, f.lon, f.lat, count(*) AS n FROM flagged f LEFT JOIN hot ON hot.region = f.region AND hot.lon = f.lon AND hot.lat = f.lat WHERE NOT f.nonveg GROUP BY 1, 2, 3, 4)
SELECT region, subset, CAST(sum(n) AS BIGINT) AS records, count(*) AS locations, CAST(sum(CASE WHEN n > 1 THEN n ELSE 0 END) AS BIGINT) AS repeated, max(n) AS most FROM g GROUP BY 1, 2""")
def duplicates_in_hotspots(spark, sf):
    """D15 on habitat records in the region's density hotspots, against those elsewhere; records are counted by location before the join."""
    g = flagged(spark, sf).where("not nonveg").groupBy("region", "lon", "lat").agg(F.count("*").alias("n"))
    hot = spatially_zoned(spark, sf).where("spatial_zone = 'Hot'").select("region", F.round("lon", 5).alias("lon"), F.round("lat", 5).alias("lat"), F.lit("hotspot").alias("subset"))
    g = g.join(hot.hint("merge"), ["region", "lon", "lat"], "left").withColumn("subset", F.coalesce("subset", F.lit("elsewhere")))
    return g.groupBy("region", "subset").agg(F.sum("n").alias("records"), F.count("*").alias("locations"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"), F.max("n").alias("most"))


@query(f"""{PROJ}, fx_candidates AS ({FX["fx_candidates"]}), neg AS ({ORACLE_SQL["weighted_negatives"]}), r AS (SELECT region, CASE WHEN sid % 5 = 0 THEN 'val' ELSE 'train' END AS split, 1 AS label FROM proj
UNION ALL SELECT region, split, 0 FROM neg JOIN fx_candidates USING (gbif_id) JOIN fx_regions ON {IN_BOX}), n AS (SELECT region, split, CAST(sum(label) AS BIGINT) AS positives, CAST(count(*) - sum(label) AS BIGINT) AS negatives FROM r GROUP BY 1, 2)
SELECT *, 4 * positives AS seen, round(4e0 * positives / greatest(negatives, 1), 9) AS ratio, round(400e0 * positives / (4 * positives + negatives), 9) AS majority_pct, 4e0 * positives / greatest(negatives, 1) > 3 AS severe FROM n""")
def training_balance(spark, sf):
    """Positives and negatives of each region and split after the expansion of views, and the accuracy of calling everything positive."""
    pos = habitat_points(spark, sf).select("region", F.when(F.col("sid") % 5 == 0, "val").otherwise("train").alias("split"), F.lit(1).alias("label"))
    neg = P.clipped(drawn(spark, sf).select("lon", "lat", "split"), fx(spark, sf, "fx_regions")).select("region", "split", F.lit(0).alias("label"))
    return S.balance(pos.unionByName(neg)).withColumns({c: F.round(c, 9) for c in ("ratio", "majority_pct")})


@query(f"{with_fx('fx_candidates')} SELECT gbif_id, CAST(coalesce(CASE WHEN gbif_id % 13 <> 0 THEN year END, (SELECT max(year) FROM fx_candidates WHERE gbif_id % 13 <> 0)) AS INT) AS year FROM fx_candidates")
def training_years(spark, sf):
    """Records without a year take the latest one."""
    rows = fx(spark, sf, "fx_candidates").select("gbif_id", F.when(F.col("gbif_id") % 13 != 0, F.col("year")).alias("year"))
    return S.dated(rows, 2024)
