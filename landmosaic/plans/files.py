"""Queries through the sources and sinks: fixtures are written as files, read back and compared with the tables they came from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..operators.shared import shared_folder
from ..sources import tables as T
from ..streaming import ingest as I
from .fixtures import fx, with_fx
from .points import CLIP, clipped
from .registry import query
from .scoring import points

CAND = with_fx("fx_candidates")


def folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"{CLIP} SELECT region AS state, year, count(*) AS n, round(sum(lon), 5) AS lon, round(sum(lat), 5) AS lat FROM clip GROUP BY 1, 2")
def sightings_files(spark, sf):
    """A1, A2: a CSV data set for each state and year, whose coordinate columns are found by their names."""
    path = folder(spark, "sightings")
    rows = clipped(spark, sf).select(F.col("region").alias("state"), "year", F.col("sid").alias("id"), F.col("lat").alias("decimalLatitude"), F.col("lon").alias("decimalLongitude"))
    T.write_sightings(rows, path)
    return T.read_sightings(spark, path).groupBy("state", "year").agg(F.count("*").alias("n"), F.round(F.sum("lon"), 5).alias("lon"), F.round(F.sum("lat"), 5).alias("lat"))


@query(f"{CAND} SELECT CASE species WHEN 0 THEN 'ME' WHEN 1 THEN 'NH' ELSE 'VT' END AS state, year, count(*) AS n, round(sum(lon), 5) AS lon FROM fx_candidates WHERE species < 3 AND gbif_id % 11 <> 0 GROUP BY 1, 2")
def occurrence_files(spark, sf):
    """A3, A4: tab-separated records go to a sink by state and year; unmapped states and rows without a year are left out."""
    source, sink = folder(spark, "occurrences"), folder(spark, "by-state")
    names = F.element_at(F.array(*(F.lit(s) for s in ("Maine", "New Hampshire", "Vermont", "Quebec", "Ontario", "Ohio"))), F.col("species") + 1)
    rows = fx(spark, sf, "fx_candidates").select(names.alias("stateProvince"), F.when(F.col("gbif_id") % 11 != 0, F.col("year")).alias("year"), F.col("lon").alias("decimalLongitude"), F.col("lat").alias("decimalLatitude"))
    rows.write.csv(source, sep="\t", header=True)
    states = spark.createDataFrame([("Maine", "ME"), ("New Hampshire", "NH"), ("Vermont", "VT")], "stateProvince string, state string")
    T.write_by_state(T.read_occurrences(spark, source), states, sink)
    return spark.read.parquet(sink).groupBy("state", "year").agg(F.count("*").alias("n"), F.round(F.sum("decimalLongitude"), 5).alias("lon"))


@query("SELECT CAST(o_orderkey AS INT) AS value, o_orderpriority AS evt_phys, coalesce(CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END, o_orderpriority) AS evt_group FROM orders")
def crosswalk_files(spark, sf):
    """Of two written tables the newest one by name is read; headers are trimmed, a missing group is the class itself."""
    path = folder(spark, "crosswalk")
    o = spark.read.parquet(f"{sf}/orders.parquet")
    group = F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus"))
    for year, name in (("2016", F.lit("Old")), ("2022", F.col("o_orderpriority"))):
        table = o.select(F.col("o_orderkey").alias(" value "), name.alias("evt_phys"), group.alias("Evt_Gp_N"), F.lit(f"LF{year}_EVT.csv").alias("name"))
        table.write.mode("append").partitionBy("name").csv(path, header=True)
    return T.read_crosswalk(spark, path)


@query(f"{CLIP} SELECT region, year, count(*) AS n FROM clip WHERE region = 'NH' GROUP BY 1, 2")
def artifact_files(spark, sf):
    """A named table for each region, written, found by the catalogue and pruned to one region."""
    path = folder(spark, "artifacts")
    T.write_artifact(clipped(spark, sf).groupBy("region", "year").agg(F.count("*").alias("n")), path, "sightings")
    return T.Artifacts(spark, path).table("sightings", "NH").select("region", "year", "n")


@query(f"""{with_fx("fx_scores")}, pt AS (SELECT point_id, avg(logit) AS logit, min(y) AS y FROM fx_scores GROUP BY 1), k AS (SELECT unnest([1e0, 2e0]) AS scale), b AS (SELECT scale, CAST(least(floor(1 / (1 + exp(-logit / scale)) * 15), 14) AS INT) AS bin, 1 / (1 + exp(-logit / scale)) AS p, y FROM pt CROSS JOIN k)
SELECT CASE WHEN scale = 1 THEN 'before' ELSE 'after' END AS stage, bin, count(*) AS count, round(avg(p), 9) AS mean_pred, round(avg(y), 9) AS observed FROM b GROUP BY 1, 2""")
def calibration_files(spark, sf):
    """The calibration sinks, written for two temperatures and read back."""
    path, pt = folder(spark, "calibration"), points(spark, sf)
    bins = [M.reliability(pt, temperature=t).withColumn("stage", F.lit(stage)) for stage, t in (("before", 1.0), ("after", 2.0))]
    T.write_calibration(M.summary(pt), bins[0].unionByName(bins[1]), path)
    return spark.read.parquet(f"{path}/reliability").where("count > 0").select("stage", "bin", "count", *(F.round(c, 9).alias(c) for c in ("mean_pred", "observed")))


@query(f"{CAND} SELECT CAST(gbif_id AS VARCHAR) AS gbif_id, year, CASE WHEN gbif_id % 3 < 2 THEN 'batch' ELSE 'stream' END AS run FROM fx_candidates")
def ingest_runs(spark, sf):
    """Two thirds of the candidates come as a batch, then two thirds as a stream, then the batch once more; the sink holds each id once."""
    source, sink, state = (folder(spark, n) for n in ("arrivals", "candidates", "progress"))
    schema = spark.createDataFrame([], T.CANDIDATES).schema
    known = {"common_name": F.col("species").cast("string"), "longitude": F.col("lon"), "latitude": F.col("lat"), "year": F.col("year"), "gbif_id": F.col("gbif_id").cast("string"), "coord_uncertainty_m": F.col("coord_uncertainty_m")}
    rows = fx(spark, sf, "fx_candidates").select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema), (F.col("gbif_id") % 3).alias("part"))
    rows.where("part > 0").drop("part").write.parquet(source)
    first = rows.where("part < 2").drop("part")
    I.append_new(first, sink, "batch")
    I.ingest(spark, source, sink, state)
    I.append_new(first, sink, "batch")
    return I.sink_rows(spark, sink).select("gbif_id", "year", F.split("run", "-")[0].alias("run"))
