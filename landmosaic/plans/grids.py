"""Queries over layers that each have a projection and a grid of their own, and over whole turned patches."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import geo
from ..functions.binning import unmasked
from ..operators import grids as G
from ..operators import points as P
from ..operators import views as V
from .fixtures import FX, fx
from .habitat import MASK, PIX, SIGHT, pixels
from .points import clipped
from .registry import query

FX["fx_grids"] = """
SELECT 'evt' AS feature, CAST(NULL AS DOUBLE) AS p1, CAST(NULL AS DOUBLE) AS p2, CAST(NULL AS DOUBLE) AS lat0, CAST(NULL AS DOUBLE) AS lon0, -74e0 AS x_left, 48e0 AS y_top, 0.01e0 AS res, 544 AS n_rows, 720 AS n_cols
UNION ALL SELECT 'ch', 29.5e0, 45.5e0, 23e0, -96e0, 1700000e0, 3030000e0, 1500e0, 544, 500
UNION ALL SELECT 'cc', 20e0, 60e0, 40e0, -96e0, 1600000e0, 1150000e0, 1400e0, 500, 600"""

E2 = geo.FLATTENING * (2 - geo.FLATTENING)
ECC = math.sqrt(E2)


def _q(s: str) -> str:
    return f"({1 - E2!r} * ({s} / (1 - {E2!r} * {s} * {s}) - ln((1 - {ECC!r} * {s}) / (1 + {ECC!r} * {s})) / {2 * ECC!r}))"


def _m(angle: str) -> str:
    return f"(cos(radians({angle})) / sqrt(1 - {E2!r} * pow(sin(radians({angle})), 2)))"


def _s(angle: str) -> str:
    return f"sin(radians({angle}))"


GRIDS = f"""gn AS (SELECT *, (pow({_m('p1')}, 2) - pow({_m('p2')}, 2)) / ({_q(_s('p2'))} - {_q(_s('p1'))}) AS n FROM fx_grids),
gc AS (SELECT *, pow({_m('p1')}, 2) + n * {_q(_s('p1'))} AS c FROM gn), gr AS (SELECT *, {geo.A!r} * sqrt(c - n * {_q(_s('lat0'))}) / n AS rho0 FROM gc)"""
WITH_GRIDS = f"{PIX}, {SIGHT}, fx_grids AS ({FX['fx_grids']}), {GRIDS}"


def on_map(lon: str, lat: str) -> tuple[str, str]:
    rho, theta = f"({geo.A!r} * sqrt(c - n * {_q(_s(lat))}) / n)", f"(n * radians({lon} - lon0))"
    return f"(CASE WHEN n IS NULL THEN {lon} ELSE {rho} * sin({theta}) END)", f"(CASE WHEN n IS NULL THEN {lat} ELSE rho0 - {rho} * cos({theta}) END)"


def _cell(x: str, y: str) -> tuple[str, str]:
    return f"CAST(floor((y_top - {y}) / res) AS INT)", f"CAST(floor(({x} - x_left) / res) AS INT)"


LON_LAT = on_map("lon", "lat")
LOCATED = f"{WITH_GRIDS}, loc AS (SELECT s.region, s.sid, g.feature, {LON_LAT[0]} AS x, {LON_LAT[1]} AS y, x_left, y_top, res, n_rows, n_cols FROM coll s CROSS JOIN gr g), idx AS (SELECT *, {_cell('x', 'y')[0]} AS row_id, {_cell('x', 'y')[1]} AS col_id FROM loc)"


def sightings(spark, sf):
    return P.collapsed(clipped(spark, sf)).select("region", "sid", "lon", "lat")


@query(f"{LOCATED} SELECT region, sid, feature, round(x, 3) AS x, round(y, 3) AS y, row_id, col_id, row_id BETWEEN 0 AND n_rows - 1 AND col_id BETWEEN 0 AND n_cols - 1 AS inside FROM idx")
def grid_locations(spark, sf):
    """Every sighting's pixel in each layer, by the layer's own projection and affine."""
    at = G.located(sightings(spark, sf), fx(spark, sf, "fx_grids"))
    return at.select("region", "sid", "feature", F.round("x", 3).alias("x"), F.round("y", 3).alias("y"), "row_id", "col_id", "inside")


LAYER_VALUES = " UNION ALL ".join(f"SELECT '{f}' AS feature, row_id, col_id, {MASK.format(f)} AS value FROM fx_pixels" for f in ("evt", "ch", "cc"))


@query(f"""{LOCATED}, v AS ({LAYER_VALUES}), hit AS (SELECT i.region, i.sid, i.feature, v.value FROM idx i JOIN v USING (feature, row_id, col_id) WHERE row_id BETWEEN 0 AND n_rows - 1 AND col_id BETWEEN 0 AND n_cols - 1)
SELECT s.region, s.sid, max(value) FILTER (feature = 'evt') AS evt, max(value) FILTER (feature = 'ch') AS ch, max(value) FILTER (feature = 'cc') AS cc FROM coll s LEFT JOIN hit USING (region, sid) GROUP BY ALL""")
def grid_sampling(spark, sf):
    """Three layers of different projections and grids sampled in one plan."""
    each = F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), unmasked(F.col(f)).alias("value")) for f in ("evt", "ch", "cc")))).alias("v")
    values = pixels(spark, sf).select("row_id", "col_id", each).select("v.feature", "row_id", "col_id", "v.value")
    return G.sampled_by_grid(sightings(spark, sf), fx(spark, sf, "fx_grids"), values, ("region", "sid"), ("evt", "ch", "cc"))


_C = [on_map(lon, lat) for lon in ("min_lon", "max_lon") for lat in ("min_lat", "max_lat")]
_XS, _YS = ", ".join(c[0] for c in _C), ", ".join(c[1] for c in _C)


@query(f"""{WITH_GRIDS}, k AS (SELECT region, feature, n_rows, n_cols, CAST(floor((y_top - greatest({_YS})) / res) AS INT) AS r0, CAST(floor((y_top - least({_YS})) / res) AS INT) AS r1,
 CAST(floor((least({_XS}) - x_left) / res) AS INT) AS c0, CAST(floor((greatest({_XS}) - x_left) / res) AS INT) AS c1 FROM fx_regions CROSS JOIN gr),
clamped AS (SELECT region, feature, greatest(0, r0 - 100) AS r_start, least(n_rows, r1 + 100) AS r_end, greatest(0, c0 - 100) AS c_start, least(n_cols, c1 + 100) AS c_end FROM k)
SELECT *, r_end - r_start >= 64 AND c_end - c_start >= 64 AS large FROM clamped""")
def grid_windows(spark, sf):
    """Each region's padded, clamped window in every layer, from its four projected corners."""
    return G.windows(fx(spark, sf, "fx_regions"), fx(spark, sf, "fx_grids")).select("region", "feature", "r_start", "r_end", "c_start", "c_end", "large")


@query(f"""{WITH_GRIDS}, c AS (SELECT feature, row_id, col_id, p1 IS NULL AS flat, x_left + (col_id + 0.5) * res AS x, y_top - (row_id + 0.5) * res AS y FROM fx_pixels CROSS JOIN fx_grids WHERE row_id % 8 = 0 AND col_id % 8 = 0 AND row_id < n_rows AND col_id < n_cols)
SELECT feature, row_id, col_id, CASE WHEN flat THEN round(x, 6) ELSE round(x, 1) END AS x, CASE WHEN flat THEN round(y, 6) ELSE round(y, 1) END AS y FROM c""")
def grid_centres(spark, sf):
    """The scoring grid's centres in lon and lat by the inverse projection; projected again they are the pixels' centres."""
    g = fx(spark, sf, "fx_grids")
    each = pixels(spark, sf).where("row_id % 8 = 0 and col_id % 8 = 0").select("row_id", "col_id").crossJoin(F.broadcast(g.select("feature", "n_rows", "n_cols"))).where("row_id < n_rows and col_id < n_cols")
    placed = G.centres(each.select("feature", "row_id", "col_id"), g).withColumnsRenamed({"row_id": "r", "col_id": "c"})
    back = G.located(placed, g, by=("feature",)).where("row_id = r and col_id = c and inside")
    shown = lambda c: F.when(F.col("feature") == "evt", F.round(c, 6)).otherwise(F.round(c, 1)).alias(c)
    return back.select("feature", "row_id", "col_id", shown("x"), shown("y"))


@query("""WITH k AS (SELECT unnest([0, 1, 2, 3]) AS rot), f AS (SELECT unnest([false, true]) AS flip), cell AS (SELECT CAST(i // 8 AS INT) AS r, CAST(i % 8 AS INT) AS c FROM (SELECT unnest(range(64)) AS i)),
turned AS (SELECT rot, r * 8 + c AS source, CASE rot WHEN 0 THEN r WHEN 1 THEN 7 - c WHEN 2 THEN 7 - r ELSE c END AS tr, CASE rot WHEN 0 THEN c WHEN 1 THEN r WHEN 2 THEN 7 - c ELSE 7 - r END AS tc FROM k, cell),
placed AS (SELECT rot, flip, source, tr * 8 + CASE WHEN flip THEN 7 - tc ELSE tc END AS target FROM turned, f)
SELECT vec_id, label, rot, flip, round(sum(CAST(embedding[source + 1] AS DOUBLE) * (target + 1)), 5) AS placed, round(sum(CAST(embedding[source + 1] AS DOUBLE) * pow(target - 31, 2)), 4) AS squared FROM embeddings, placed GROUP BY ALL""")
def expanded_views(spark, sf):
    """All eight views of whole patches, each with its label, as two checksums over places."""
    e = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("patch"))
    out = V.expanded(e, "patch", 8)
    weighed = lambda w: F.aggregate(F.transform("patch", w), F.lit(0.0), lambda a, x: a + x)
    first, second = weighed(lambda v, i: v * (i + 1)), weighed(lambda v, i: v * (i - 31) * (i - 31))
    return out.select("vec_id", "label", "rot", "flip", F.round(first, 5).alias("placed"), F.round(second, 4).alias("squared"))
