"""Deterministic inputs derived from the given tables, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

FX: dict[str, str] = {}

FX["fx_regions"] = """
SELECT 'ME' AS region, -71.158e0 AS min_lon, 42.889e0 AS min_lat, -66.852e0 AS max_lon, 47.555e0 AS max_lat
UNION ALL SELECT 'NH', -72.626e0, 42.605e0, -70.600e0, 45.398e0
UNION ALL SELECT 'VT', -73.510e0, 42.632e0, -71.422e0, 45.112e0"""

FX["fx_sightings"] = """
SELECT event_id AS sid,
       -73.3e0 + CAST(loc % 8 AS DOUBLE) * 0.8e0 + CAST((loc * loc * 31 + loc * 7919) % 10007 AS DOUBLE) / 10007e0 * 0.04e0 + jit AS lon,
       42.8e0 + CAST(loc % 5 AS DOUBLE) * 0.95e0 + CAST((loc * loc * 17 + loc * 4729) % 9973 AS DOUBLE) / 9973e0 * 0.03e0 AS lat,
       CAST(2016 + event_id % 9 AS INT) AS year
FROM (SELECT event_id,
             CASE WHEN event_id % 3 = 0 OR event_id % 6 = 1 THEN user_id ELSE 1000 + event_id END AS loc,
             CASE WHEN event_id % 6 = 1 THEN CAST((event_id * 37) % 23 AS DOUBLE) * 0.0001e0 ELSE 0e0 END AS jit
      FROM events) t"""

FX["fx_candidates"] = """
SELECT o_orderkey AS gbif_id,
       -73.32e0 + CAST(loc % 8 AS DOUBLE) * 0.8e0 + CAST((loc * loc * 13 + loc * 6101) % 10007 AS DOUBLE) / 10007e0 * 0.09e0 AS lon,
       42.785e0 + CAST(loc % 5 AS DOUBLE) * 0.95e0 + CAST((loc * loc * 7 + loc * 7793) % 9973 AS DOUBLE) / 9973e0 * 0.07e0 AS lat,
       CAST(2020 + o_orderkey % 6 AS INT) AS year,
       CAST(o_custkey % 6 AS INT) AS species,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN 5000e0 ELSE 100e0 END AS coord_uncertainty_m
FROM (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey ELSE 2000 + o_orderkey END AS loc FROM orders) t"""

FX["fx_crosswalk"] = """
SELECT 7001 AS value, 'Hardwood' AS evt_phys UNION ALL SELECT 7002, 'Conifer' UNION ALL SELECT 7003, 'Conifer-Hardwood'
UNION ALL SELECT 7004, 'Grassland' UNION ALL SELECT 7005, 'Riparian' UNION ALL SELECT 7006, 'Exotic Tree-Shrub'
UNION ALL SELECT 7007, 'Developed-Low Intensity' UNION ALL SELECT 7008, 'Open Water'"""

#: Every order is a tile of 8 x 8 pixels; 6,120 of them (68 x 90) fill a sheet in scattered order, further sheets lie south of it.
FX["fx_pixels"] = """
SELECT row_id, col_id,
       CAST(CASE WHEN (row_id * 13 + col_id * 7) % 97 = 0 THEN -9999 ELSE 7001 + (row_id * 5 + col_id * 3) % 9 END AS INT) AS evt,
       CAST(CASE WHEN (row_id + col_id) % 19 = 0 THEN 111 ELSE 1 + (row_id * 3 + col_id) % 7 END AS INT) AS sclass,
       CAST(100 + (row_id * 7 + col_id * 13) % 60 AS INT) AS evh,
       CAST(100 + (row_id * 11 + col_id * 5) % 80 AS INT) AS evc,
       CAST(CASE WHEN (row_id * col_id) % 11 = 0 THEN 1 + (row_id + col_id) % 30 ELSE NULL END AS INT) AS fdist,
       CAST((row_id * 17 + col_id * 3) % 300 AS INT) AS ch,
       CAST((row_id * 3 + col_id * 19) % 100 AS INT) AS cc
FROM (SELECT row_id, unnest(range(first_col, first_col + 8)) AS col_id
      FROM (SELECT first_col, unnest(range(first_row, first_row + 8)) AS row_id
            FROM (SELECT sheet * 544 + CAST(floor(place / 90e0) AS BIGINT) * 8 AS first_row, place % 90 * 8 AS first_col
                  FROM (SELECT CAST(floor(o_orderkey / 6120e0) AS BIGINT) AS sheet, (o_orderkey % 6120) * 1327 % 6120 AS place FROM orders) s) t) u) v"""

FX["fx_layers"] = """
SELECT DISTINCT region, year, feature
FROM (SELECT CASE o_custkey % 3 WHEN 0 THEN 'ME' WHEN 1 THEN 'NH' ELSE 'VT' END AS region,
             CAST(CASE WHEN o_orderkey % 7 = 6 THEN 2016 ELSE 2016 + o_orderkey % 9 END AS INT) AS year,
             CASE o_orderkey % 7 WHEN 0 THEN 'evt' WHEN 1 THEN 'sclass' WHEN 2 THEN 'evh' WHEN 3 THEN 'evc' WHEN 4 THEN 'ch' WHEN 5 THEN 'cc' ELSE 'slope' END AS feature,
             (o_orderkey % 9 + o_orderkey % 7 + o_custkey % 3) % 4 AS gap
      FROM orders) t
WHERE NOT (feature = 'ch' AND region = 'NH') AND (feature = 'slope' OR gap <> 0)"""

FX["fx_scores"] = """
SELECT d.doc_id AS point_id, v.rot AS rot,
       CAST(d.n_chars % 97 - 48 AS DOUBLE) / 12e0 + 0.8e0 * l.quality
         + (CAST(v.rot AS DOUBLE) - 1.5e0) * 0.05e0 * CAST(d.doc_id % 5 - 2 AS DOUBLE) AS logit,
       l.quality AS y
FROM labels l JOIN documents d ON l.doc_id = d.doc_id
CROSS JOIN (SELECT 0 AS rot UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) v"""

FX["fx_epochs"] = """
SELECT CAST(event_id % 4 AS INT) AS run_id, CAST(EXTRACT(DAY FROM ts) AS INT) AS epoch,
       AVG(value) AS strict, AVG(value * CAST(event_id % 7 AS DOUBLE)) AS auc, AVG(value * CAST(event_id % 5 AS DOUBLE)) AS ap
FROM events GROUP BY 1, 2"""

#: Tiles of 8 x 8 pixels that one task makes.
TILES_A_TASK = 50_000

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def fx(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture as a DataFrame over the tables of sf_dir."""
    text = re.sub(r"unnest\(range\((\w+), \w+ \+ 8\)\)", r"explode(sequence(\1, \1 + 7))", FX[name])
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\b(FROM|JOIN) {t}\b", text)}
    tasks = spark.sparkContext.defaultParallelism
    if name == "fx_pixels":  # a row becomes 64, so they are dealt out first
        tasks = max(tasks, -(-frames["orders"].count() // TILES_A_TASK))
        if frames["orders"].rdd.getNumPartitions() < tasks:
            frames["orders"] = frames["orders"].select("o_orderkey").repartition(tasks)
    for t in frames:
        text = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", text)
    return spark.sql(text, **frames)


def with_fx(*names: str) -> str:
    """The same fixtures as the head of a DuckDB query."""
    kept = lambda n: " MATERIALIZED" if n == "fx_pixels" else ""
    return "WITH " + ",\n".join(f"{n} AS{kept(n)} ({FX[n]})" for n in names)
