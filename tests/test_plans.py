"""Every registered query against its SQL in DuckDB, and those without SQL against brute force."""

import hashlib

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from landmosaic.operators import envelopes, metrics, points, ranks, raster, sampling
from landmosaic.plans.fixtures import TABLES
from landmosaic.plans.habitat import available, pixels
from landmosaic.plans.points import habitat_points
from landmosaic.plans.registry import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


def plain(df):
    def one(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return "%.9g" % (float(v) + 0.0) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    columns = sorted(df.columns)
    return columns, sorted(tuple(map(one, row)) for row in df[columns].astype(object).to_numpy())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, sf, con, name):
    assert plain(QUERIES[name](spark, sf).toPandas()) == plain(con.execute(ORACLE_SQL[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_thinning_equals_taking_in_order(spark, sf):
    pts = habitat_points(spark, sf).where("region = 'ME'").withColumn("p", F.col("sid") * 7919 % 10007)
    got = {r["sid"] for r in points.thinned(pts, "sid", 300.0, F.col("p")).collect()}
    kept = []
    for r in pts.orderBy("p", "sid").collect():
        if all((r["x"] - k["x"]) ** 2 + (r["y"] - k["y"]) ** 2 >= 300.0**2 for k in kept):
            kept.append(r)
    assert got == {k["sid"] for k in kept}


def test_temperature_is_the_minimum(spark):
    df = spark.createDataFrame([(i, float(i % 7 - 3), int(i % 5 < 2 + (i % 7 > 3))) for i in range(500)], "point_id long, logit double, y int")
    g = metrics.fit_temperature(df)
    rows = df.toPandas()
    nll = lambda s: np.mean(np.logaddexp(0, s * rows.logit) - rows.y * s * rows.logit)
    assert all(nll(g) <= nll(s) + 1e-9 for s in np.geomspace(0.02, 20, 400))


def test_weighted_sample_fills_targets(spark):
    df = spark.createDataFrame([(i, "val" if i % 5 == 0 else "train", i % 3 == 0, 1.0 + i % 4) for i in range(1000)], "id long, split string, nonveg boolean, weight double")
    t = spark.createDataFrame([("train", 600), ("val", 50)], "split string, target long")
    got = sampling.weighted_sample(df, "id", t).groupBy("split").agg(F.count("*").alias("n"), F.sum(F.col("nonveg").cast("int")).alias("bare")).collect()
    assert {r["split"]: r["n"] for r in got} == {"train": 600, "val": 50} and all(r["bare"] <= 0.3 * r["n"] or r["split"] == "train" for r in got)


def test_schemes():
    assert len(envelopes.schemes({"a": ("raw", 2), "b": (3,)})) == 5


def test_running_equals_one_window(spark):
    rows = [(None if i % 3 == 2 else f"g{i % 3}", i * 7919 % 1009, i, None if i % 11 == 0 else i % 2) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, v long, id long, y int")
    got = {(r["id"], r["pos_"], r["run_y"]) for r in ranks.running(df.repartition(7), [F.desc("v"), F.col("id")], ("g",), ("y",)).collect()}
    want, pos, hits = set(), {}, {}
    for g, v, i, y in sorted(rows, key=lambda r: (-r[1], r[2])):
        pos[g], hits[g] = pos.get(g, 0) + 1, hits.get(g, 0) + (y or 0)
        want.add((i, pos[g], hits[g]))
    assert got == want
    assert ranks.running(df.limit(0), ["v", "id"]).count() == 0


def test_availability_counts_every_pixel_of_a_region(spark, sf):
    boxes = points.regions(spark)
    lon, lat = F.round(-74 + (F.col("col_id") + 0.5) * 0.01, 6), F.round(48 - (F.col("row_id") + 0.5) * 0.01, 6)
    every = points.clipped(available(spark, sf).where("not nonveg").withColumn("lon", lon).withColumn("lat", lat), boxes).groupBy("region").count()
    got = QUERIES["pixel_selection"](spark, sf).groupBy("region").agg(F.sum("avail_n"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, every.collect()))
    assert QUERIES["align_layers"](spark, sf).agg(F.sum("n")).first()[0] == pixels(spark, sf).count()
    assert QUERIES["patch_windows"](spark, sf).count() == QUERIES["collapse_visits"](spark, sf).count()


def test_zones_of_a_region_without_background(spark):
    used = spark.createDataFrame([("A", "x")] * 20 + [("A", "y")] + [("B", "x")] * 3, "region string, envelope_id string")
    seen = spark.createDataFrame([("A", "x")] * 30 + [("A", "y")] * 30, "region string, envelope_id string")
    zones = {(r["region"], r["envelope_id"]): r["env_zone"] for r in envelopes.with_zones(used, envelopes.selection(used, seen)).distinct().collect()}
    assert zones == {("A", "x"): "Proportional Envelope", ("A", "y"): "Avoided Envelope", ("B", "x"): "Proportional Envelope"}


def test_holdout_within_each_group(spark):
    rows = [(g, f"{b}_{b % 3}") for k, g in enumerate(("ME", "NH", "VT")) for b in range(12) for _ in range(1 + b * (k + 2) % 7)]
    df = spark.createDataFrame(rows, "region string, block_id string")
    held = sampling.block_holdout(df, group=("region",))
    got = {(r["region"], r["block_id"]): r["split"] for r in held.collect()}
    want = {}
    for g in ("ME", "NH", "VT"):
        mine = [b for region, b in rows if region == g]
        taken = 0
        for b in sorted(set(mine), key=lambda b: (hashlib.md5(f"42:{b}".encode()).hexdigest(), b)):
            want[g, b] = "val" if taken < round(0.2 * len(mine)) else "train"
            taken += mine.count(b)
    assert got == want and len({frozenset(b for (r, b), s in got.items() if r == g and s == "val") for g in ("ME", "NH", "VT")}) > 1
    looked = {(r["region"], r["block_id"]): r["split"] for r in sampling.with_split(df.distinct(), held, group=("region",)).collect()}
    assert looked == got


def test_sampling_by_year_prunes_layers(spark, tmp_path):
    """Ties go to the earlier year, a region never borrows another's layers, and only the layers asked for are scanned."""
    tiles = spark.createDataFrame([(r, f, y, 0, c, [y * 10 + c * 4 + i for i in range(4)]) for r, f, ys in (("A", "evt", (2016, 2020)), ("B", "evt", (2018,)), ("A", "ch", (2030,))) for y in ys for c in (0, 1)], "region string, feature string, year int, tile_r long, tile_c long, data array<int>")
    written = raster.write_tiles(tiles, str(tmp_path / "tiles"))
    layers = tiles.select("region", "feature", "year").distinct()
    pts = spark.createDataFrame([("A", 1, 2018, 0, 0), ("A", 2, 2019, 1, 3), ("B", 3, 2030, 0, 1), ("A", 4, 2018, 0, 0), ("C", 5, 2018, 0, 0), ("A", 6, 2018, 9, 9)], "region string, sid int, year int, row_id int, col_id int")
    got = raster.sampled_by_year(pts, written, layers, ("evt", "ch"), size=2)
    assert {r["sid"]: (r["evt"], r["ch"]) for r in got.collect()} == {1: (20160, 20300), 2: (20207, 20307), 3: (20181, None), 4: (20160, 20300), 5: (None, None), 6: (None, None)}
    assert "dynamicpruning" in got._jdf.queryExecution().executedPlan().toString()


def test_quantiles_equal_interpolation(spark):
    r = np.random.default_rng(4)
    rows = [("a", float(v)) for v in r.normal(size=501)] + [("b", float(v)) for v in r.integers(0, 4, 40)] + [("c", 2.5), ("d", None), (None, 1.0), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    shares = (0.0, 0.02, 0.1, 0.25, 0.5, 0.9, 0.98, 1.0)
    got = {x["g"]: x["cuts_"] for x in ranks.quantiles(df, "v", shares, ("g",)).collect()}
    assert set(got) == {"a", "b", "c", None}
    for g, cuts in got.items():
        assert cuts == pytest.approx(list(np.quantile([v for k, v in rows if k == g], shares)), abs=1e-12)
    assert ranks.quantiles(df.select("v"), "v", shares).first()[0] == pytest.approx(list(np.quantile([v for _, v in rows if v is not None], shares)), abs=1e-12)
    assert ranks.quantiles(df.limit(0), "v", shares).count() == 1 and ranks.quantiles(df.limit(0), "v", shares, ("g",)).count() == 0
    zones = points.zoned(df.withColumnRenamed("v", "density"), ("g",)).groupBy("g", "spatial_zone").count().collect()
    assert {(x["g"], x["spatial_zone"]) for x in zones if x["g"] in ("d", "c")} == {("d", "Moderate"), ("c", "Hot")} and sum(x["count"] for x in zones) == len(rows)


def test_each_cycle_deals_a_class_once_in_a_new_order(spark):
    df = spark.createDataFrame([(i, int(i < 5)) for i in range(45)], "point_id long, y int")
    got = sampling.balanced_batches(df, "point_id").orderBy("batch_id", "slot").collect()
    assert len(got) == 2 * 5 * 8 and all(sum(r["y"] for r in got[k : k + 8]) == (2 if k % 16 == 0 else 6) for k in range(0, 80, 8))
    rare = [r["point_id"] for r in got if r["y"] == 1]
    cycles = [rare[k : k + 5] for k in range(0, 40, 5)]
    assert all(sorted(c) == list(range(5)) for c in cycles) and len({tuple(c) for c in cycles}) > 4
    assert sorted(r["point_id"] for r in got if r["y"] == 0) == list(range(5, 45))
    with pytest.raises(ValueError):
        sampling.balanced_batches(df.where("y = 1"), "point_id")


def test_collapsed_takes_the_latest_years_first_record(spark):
    """Ties of year go to the least sid; records without a year come last; rows of one pin are one group however many."""
    rows = [("A", 3, 2020, 1.000001, 2.0), ("A", 2, 2020, 1.000002, 2.0), ("A", 1, 2019, 1.0, 2.0), ("A", 9, None, 1.0, 2.0), ("B", 5, None, 1.0, 2.0), ("B", 4, None, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "region string, sid long, year int, lon double, lat double")
    got = {r["region"]: (r["sid"], r["year"], r["lon"], r["n_visits"], r["first_year"], r["last_year"]) for r in points.collapsed(df).collect()}
    assert got == {"A": (2, 2020, 1.000002, 4, 2019, 2020), "B": (4, None, 1.0, 2, None, None)}
    assert points.collapsed(df.limit(0)).count() == 0 and points.collapsed(df).columns == [*df.columns, "n_visits", "first_year", "last_year"]
    many = spark.range(5000).selectExpr("'A' AS region", "id AS sid", "2000 AS year", "1D AS lon", "2D AS lat")
    assert [(r["sid"], r["n_visits"]) for r in points.collapsed(many).collect()] == [(0, 5000)]
    assert "Window" not in points.collapsed(many)._jdf.queryExecution().executedPlan().toString()
