"""Queries over windows round points: the patch feature table, naive Bayes on codes, the scored surface."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.binning import unmasked
from ..functions.geo import albers, hash_share
from ..operators import bayes
from ..operators import metrics as M
from ..operators import patches as W
from ..operators import points as P
from ..operators import raster as R
from .fixtures import FX, fx
from .habitat import MASK, PIX, SIGHT, pixels
from .negatives import drawn
from .points import HASH, X, Y, clipped
from .registry import ORACLE_SQL, query

CLASSES, VALUES, CODES = ("evt", "sclass"), ("ch", "cc"), ("evt", "sclass", "evh")
AT = "CAST(floor((48e0 - lat) / 0.01e0) AS INT) AS row_id, CAST(floor((lon + 74e0) / 0.01e0) AS INT) AS col_id"
POINTS = f"""{PIX}, {SIGHT}, fx_candidates AS ({FX["fx_candidates"]}), neg AS ({ORACLE_SQL["weighted_negatives"]}),
pts AS (SELECT 'sighting' AS kind, region || ':' || sid AS id, lon, lat, 1 AS y, 1e0 AS weight, {AT} FROM coll
UNION ALL SELECT 'negative', CAST(gbif_id AS VARCHAR), lon, lat, 0, CASE WHEN species = 0 THEN 10e0 WHEN species = 5 THEN 1e0 ELSE 1e0 / least(greatest((species * species * 3) / 4e0, 0.1e0), 10e0) END, {AT} FROM neg JOIN fx_candidates USING (gbif_id)),
spots AS (SELECT DISTINCT row_id, col_id FROM pts),
masked AS (SELECT row_id, col_id, {", ".join(f"{MASK.format(c)} AS {c}" for c in ("evt", "sclass", "evh", "ch", "cc"))} FROM fx_pixels)"""


def window_sql(side: int, name: str = "win") -> str:
    """Every pixel of every spot's window."""
    return f"""{name} AS (SELECT s.row_id, s.col_id, p.evt, p.sclass, p.ch, p.cc FROM spots s CROSS JOIN (SELECT unnest(range({side})) AS i) CROSS JOIN (SELECT unnest(range({side})) AS j)
    JOIN masked p ON p.row_id = s.row_id - {side // 2} + i AND p.col_id = s.col_id - {side // 2} + j)"""


def patch_points(spark, sf):
    """kind, id, lon, lat, y, weight, row_id, col_id of every collapsed sighting and every drawn negative."""
    seen = P.collapsed(clipped(spark, sf)).select(F.lit("sighting").alias("kind"), F.concat_ws(":", "region", "sid").alias("id"), "lon", "lat", F.lit(1).alias("y"), F.lit(1.0).alias("weight"))
    others = drawn(spark, sf).select(F.lit("negative").alias("kind"), F.col("gbif_id").cast("string").alias("id"), "lon", "lat", F.lit(0).alias("y"), "weight")
    return R.indexed(seen.unionByName(others))


@query(f"""{POINTS}, {window_sql(64)}, n AS (SELECT row_id, col_id, 'evt' AS feature, evt AS code, count(*) AS n FROM win WHERE evt IS NOT NULL GROUP BY ALL UNION ALL SELECT row_id, col_id, 'sclass', sclass, count(*) FROM win WHERE sclass IS NOT NULL GROUP BY ALL)
SELECT kind, id, feature, CAST(code AS INT) AS code, round(n / 4096e0, 9) AS share FROM pts JOIN n USING (row_id, col_id)""")
def patch_shares(spark, sf):
    """M1: class shares of the 64 x 64 window round every sighting and negative, by summed-area tables."""
    at = P.saved(patch_points(spark, sf).select("kind", "id", "row_id", "col_id"))
    shares = W.class_shares(at, W.window_sums(at, pixels(spark, sf), CLASSES, ()))
    return shares.select("kind", "id", "feature", "code", F.round("share", 9).alias("share"))


@query(f"""{POINTS}, {window_sql(64)}, {window_sql(2, "mid")}, a AS (SELECT row_id, col_id, sum(ch) / 4096e0 AS ch_mean, sum(cc) / 4096e0 AS cc_mean FROM win GROUP BY ALL), b AS (SELECT row_id, col_id, sum(ch) / 4e0 AS ch_middle, sum(cc) / 4e0 AS cc_middle FROM mid GROUP BY ALL)
SELECT kind, id, {", ".join(f"coalesce(m.{c}, 0) AS {c}_centre" for c in CLASSES)}, {", ".join(f"round(coalesce({c}, 0), 6) AS {c}" for c in ("ch_mean", "cc_mean", "ch_middle", "cc_middle"))} FROM pts LEFT JOIN masked m USING (row_id, col_id) LEFT JOIN a USING (row_id, col_id) LEFT JOIN b USING (row_id, col_id)""")
def patch_pooled(spark, sf):
    """Codes of the central pixel, means of the continuous layers over the window and over the central 2 x 2 pixels."""
    at = P.saved(patch_points(spark, sf).select("kind", "id", "row_id", "col_id"))
    p = pixels(spark, sf)
    out = W.pooled(W.centre_codes(at, p, CLASSES), W.window_sums(at, p, (), VALUES), VALUES)
    out = W.pooled(out, W.window_sums(at, p, (), VALUES, side=2), VALUES, side=2, suffix="_middle")
    return out.select("kind", "id", *(f"{c}_centre" for c in CLASSES), *(F.round(f"{f}{s}", 6).alias(f"{f}{s}") for s in ("_mean", "_middle") for f in VALUES))


CODED = f"""{POINTS}, coded AS (SELECT p.*, evt, sclass, evh, CAST(floor({X} / 3000e0) AS BIGINT) || '_' || CAST(floor({Y} / 3000e0) AS BIGINT) AS block_id FROM pts p JOIN masked m USING (row_id, col_id)),
held AS (SELECT *, {HASH} < 2000 AS val FROM coded)"""


def bayes_sql(rows: str) -> str:
    each = " UNION ALL ".join(f"SELECT '{c}' AS feature, CAST({c} AS VARCHAR) AS code, y, weight FROM {rows} WHERE {c} IS NOT NULL" for c in CODES)
    return f"""each AS ({each}), kinds AS (SELECT feature, code, coalesce(sum(weight) FILTER (y = 1), 0) AS pos, coalesce(sum(weight) FILTER (y = 0), 0) AS neg FROM each GROUP BY ALL),
    odds AS (SELECT feature, code, ln(((pos + 1) / (sum(pos) OVER w + count(*) OVER w)) / ((neg + 1) / (sum(neg) OVER w + count(*) OVER w))) AS log_odds FROM kinds WINDOW w AS (PARTITION BY feature)),
    prior AS (SELECT ln((coalesce(sum(weight) FILTER (y = 1), 0) + 1) / (coalesce(sum(weight) FILTER (y = 0), 0) + 1)) AS prior FROM {rows})"""


def logit_sql(rows: str, keep: str) -> str:
    joins = " ".join(f"LEFT JOIN odds o_{c} ON o_{c}.feature = '{c}' AND o_{c}.code = CAST(r.{c} AS VARCHAR)" for c in CODES)
    return f"SELECT {keep}, prior + {' + '.join(f'coalesce(o_{c}.log_odds, 0)' for c in CODES)} AS logit FROM {rows} r CROSS JOIN prior {joins}"


def coded(spark, sf):
    """Every sighting and negative with the codes of its pixel and val, whether its 3 km block is held out."""
    x, y = albers(F.col("lon"), F.col("lat"))
    block = F.concat_ws("_", F.floor(x / 3000), F.floor(y / 3000))
    values = pixels(spark, sf).select("row_id", "col_id", *(unmasked(F.col(c)).alias(c) for c in CODES))
    rows = patch_points(spark, sf).withColumn("val", hash_share(42, block) < 2000)
    return rows.join(R.asked(rows, values), ["row_id", "col_id"]).select("kind", "id", "y", "weight", "val", *CODES)


@query(f"{CODED}, {bayes_sql('held')} SELECT feature, code, round(log_odds, 9) AS log_odds FROM odds UNION ALL SELECT 'prior', NULL, round(prior, 9) FROM prior")
def naive_bayes(spark, sf):
    """M2: log-odds of the codes under the weighted positives and negatives."""
    table, prior = bayes.fitted(coded(spark, sf), CODES)
    return table.select("feature", "code", F.round("log_odds", 9).alias("log_odds")).union(spark.createDataFrame([("prior", None, round(prior, 9))], "feature string, code string, log_odds double"))


RANK = "rank() OVER (PARTITION BY val ORDER BY logit) + (count(*) OVER (PARTITION BY val, logit) - 1) / 2e0"


@query(f"""{CODED}, train AS (SELECT * FROM held WHERE NOT val), {bayes_sql('train')}, s AS ({logit_sql('held', 'val, y')}), rounded AS (SELECT val, y, round(logit, 9) AS logit FROM s), r AS (SELECT val, y, {RANK} AS rk FROM rounded)
SELECT val, count(*) AS n, round((sum(rk) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (sum(y) * (count(*) - sum(y))), 9) AS auc FROM r GROUP BY val""")
def bayes_auc(spark, sf):
    """Fitted on the blocks that aren't held out; its AUC there and on those that are."""
    rows = P.saved(coded(spark, sf))
    scored = bayes.with_logit(rows, bayes.fitted(rows.where("not val"), CODES), CODES).select("val", "y", F.round("logit", 9).alias("logit"))
    auc = M.roc_auc(scored, ("val",)).join(scored.groupBy("val").agg(F.count("*").alias("n")), "val")
    return auc.select("val", "n", F.round("auc", 9).alias("auc"))


STRIDE, TEMPERATURE = 8, 1.5
CELL = "-74 + (col_id + 0.5) * 0.01e0 AS x, 48 - (row_id + 0.5) * 0.01e0 AS yc"


@query(f"""{CODED}, {bayes_sql('held')}, px AS (SELECT * FROM masked WHERE evt IS NOT NULL), lo AS ({logit_sql('px', 'row_id, col_id')}),
ctr AS (SELECT row_id, col_id, {CELL} FROM lo WHERE row_id % {STRIDE} = 0 AND col_id % {STRIDE} = 0),
reg AS (SELECT r.region, c.* FROM ctr c JOIN fx_regions r ON c.x BETWEEN min_lon AND max_lon AND c.yc BETWEEN min_lat AND max_lat),
one AS (SELECT DISTINCT row_id, col_id FROM reg),
den AS (SELECT r AS row_id, c AS col_id, coalesce(logit, 0) AS v FROM (SELECT unnest(range(640)) AS r) CROSS JOIN (SELECT unnest(range(820)) AS c) LEFT JOIN lo ON row_id = r AND col_id = c),
down AS (SELECT row_id, col_id, sum(v) OVER (PARTITION BY col_id ORDER BY row_id ROWS BETWEEN 32 PRECEDING AND 31 FOLLOWING) AS s FROM den),
wide AS (SELECT row_id, col_id, sum(s) OVER (PARTITION BY row_id ORDER BY col_id ROWS BETWEEN 32 PRECEDING AND 31 FOLLOWING) / 4096e0 AS m FROM down WHERE row_id % {STRIDE} = 0),
mid AS (SELECT o.row_id, o.col_id, sum(logit) / 4e0 AS m FROM one o CROSS JOIN (SELECT unnest(range(2)) AS i) CROSS JOIN (SELECT unnest(range(2)) AS j) JOIN lo ON lo.row_id = o.row_id - 1 + i AND lo.col_id = o.col_id - 1 + j GROUP BY ALL)
SELECT region, CAST(row_id // {STRIDE} AS INT) AS grid_row, CAST(col_id // {STRIDE} AS INT) AS grid_col, round(x, 6) AS x, round(yc, 6) AS y, 0.08e0 AS a, round(-74 + 0.005e0, 6) AS c, -0.08e0 AS e, round(48 - 0.005e0, 6) AS f, round(1 / (1 + exp(-(0.5e0 * mid.m + 0.5e0 * wide.m) / {TEMPERATURE})), 6) AS p
FROM reg JOIN wide USING (row_id, col_id) JOIN mid USING (row_id, col_id)""")
def region_scoring(spark, sf):
    """Every region's grid scored by the naive Bayes of its pixels, pooled over windows and views, written as a partitioned surface and read back."""
    boxes = fx(spark, sf, "fx_regions")
    low_lon, low_lat, high_lon, high_lat = boxes.agg(F.min("min_lon"), F.min("min_lat"), F.max("max_lon"), F.max("max_lat")).first()
    r0, r1, c0, c1 = R.window((low_lon, high_lon), (low_lat, high_lat), 2**31, 2**31, pad=32)
    near = pixels(spark, sf).where(F.col("row_id").between(r0, r1) & F.col("col_id").between(c0, c1)).select("row_id", "col_id", *(unmasked(F.col(c)).alias(c) for c in CODES)).where("evt IS NOT NULL")
    model = bayes.fitted(coded(spark, sf), CODES)
    grid = W.scored_grid(bayes.with_logit(near, model, CODES).select("row_id", "col_id", "logit"), STRIDE, temperature=TEMPERATURE)
    placed = grid.withColumn("lon", -74 + (F.col("col_id") + 0.5) * 0.01).withColumn("lat", 48 - (F.col("row_id") + 0.5) * 0.01)
    surface = W.write_surface(P.clipped(placed, boxes).select("region", "row_id", "col_id", "p"), f"{P.shared_folder(spark)}/surface-{uuid.uuid4().hex}", STRIDE)
    return surface.select("region", "grid_row", "grid_col", *(F.round(k, 6).alias(k) for k in ("x", "y", "a", "c", "e", "f", "p")))
