"""What a query does not do as its tables grow: rasters sent through the driver or shuffled whole, pairs of all near points."""

import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from landmosaic.llm.common import in_batches
from landmosaic.operators import envelopes, kernel, points, raster
from landmosaic.operators.nearest import closest
from landmosaic.operators.shared import few, saved
from landmosaic.plans import fixtures
from landmosaic.plans.fixtures import fx
from landmosaic.plans.registry import QUERIES


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def sent(df):
    """The part of the plan below each broadcast."""
    lines, out = plan_of(df).split("\n"), []
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line and "ReusedExchange" not in line:
            depth = line.index("BroadcastExchange")
            below = lines[i + 1 :]
            end = next((k for k, x in enumerate(below) if len(x) - len(x.lstrip(" :+-*()0123456789")) <= depth), len(below))
            out.append("\n".join(below[:end]))
    return out


@pytest.fixture
def world(spark, sf):
    spots = spark.createDataFrame([(i, i % 7, i % 5) for i in range(50)], "id int, row_id long, col_id long")
    return spots, fx(spark, sf, "fx_pixels")


def test_sampling_sends_only_the_asked_pixels_keys_to_the_driver(world):
    spots, pixels = world
    plan = plan_of(raster.sampled(spots, pixels))
    assert plan.count("BroadcastExchange") == 1 and "SortMergeJoin" in plan
    sent = plan[plan.index("BroadcastExchange") :]
    assert "explode" not in sent


@pytest.mark.parametrize("most", (100_000, 3))
def test_asked_pixels_are_sent_as_bits_of_blocks(spark, monkeypatch, most):
    spots = spark.createDataFrame([(r, c) for r in range(-16, 16) for c in range(-20, 12) if (r * 7 + c) % 3] + [(None, 1), (2, None)], "row_id int, col_id int")
    pixels = spark.range(4096).selectExpr("id div 64 - 30 as row_id", "id % 64 - 40 as col_id", "id as v")
    sent, few = [], raster.few
    monkeypatch.setattr(raster, "few", lambda df, *rows: sent.append(df.count()) or few(df, *rows))
    monkeypatch.setattr(raster, "ASKED_BLOCKS", most, raising=False)
    got = raster.asked(spots, pixels)
    want = pixels.join(spots.distinct(), ["row_id", "col_id"], "left_semi")
    assert got.columns == pixels.columns and sorted(got.collect()) == sorted(want.collect()) and want.count() > 600
    assert sent == [20]  # blocks, not 682 pixels
    assert ("BroadcastExchange" in plan_of(got)) == (most > 3)


def test_aligned_layers_are_shuffled_not_sent(spark, sf):
    plan = plan_of(QUERIES["align_layers"](spark, sf))
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_sums_by_nodes_equal_pairs(spark, monkeypatch):
    rng = random.Random(5)
    spots = [(k % 2, 4000.0 + rng.uniform(0, 3300), -2000.0 + rng.uniform(0, 3300), 600.0 * (k % 3), 1 + k % 4) for k in range(2400)]
    spots += [(0, rng.uniform(-30000, 30000), rng.uniform(-30000, 30000), 0.0, 1) for _ in range(300)]
    spots += [(1, 4000.0 + 18000 + rng.uniform(0, 700), rng.uniform(-300, 300), 600.0, 2) for _ in range(400)]
    df = spark.createDataFrame(spots, "g int, x double, y double, z double, many long")
    monkeypatch.setattr(kernel, "CROWDED", 100)
    got = {(r["g"], r["x"], r["y"], r["z"]): r["s_"] for r in kernel.summed(df, ("g",), ["z"], 3000.0, 6.0).collect()}
    want = {(r["g"], r["x"], r["y"], r["z"]): r["s_"] for r in points._paired(df, ("g",), ["z"], 3000.0).collect()}
    assert got.keys() == want.keys()
    assert max(abs(got[k] - v) / v for k, v in want.items()) < 1e-11


def test_crowded_cells_make_no_row_for_each_pair(spark):
    rng = random.Random(6)
    df = spark.createDataFrame([(i, rng.uniform(100, 1400), rng.uniform(100, 1400)) for i in range(3000)], "id int, x double, y double")
    plan = plan_of(points.density(df, "id", least=0))
    assert "FlatMapCoGroupsInPandas" in plan


@pytest.mark.parametrize("seed", range(4))
def test_closest_equals_all_pairs(seed):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(-500, 1500, (2, 700)), rng.normal(300, 10 ** (seed + 0.5), (2, 3000))
    d = np.sqrt((a[0][:, None] - b[0]) ** 2 + (a[1][:, None] - b[1]) ** 2).min(1)
    assert np.array_equal(closest(*a, *b, 400.0), np.where(d <= 400, d, np.inf))
    assert np.isinf(closest(*a, *b[:, :0], 400.0)).all()


def test_nearest_makes_no_row_for_each_pair(spark):
    a = spark.createDataFrame([(1, 0.0, 0.0), (2, 900.0, 0.0), (3, None, 1.0), (4, 5000.0, 0.0)], "id int, x double, y double")
    b = spark.createDataFrame([(0.0, 3.0), (0.0, 3.0), (0.0, 4.0), (None, None)], "x double, y double")
    near = points.nearest_within(a, b, "id", 1000.0)
    assert {r["id"]: r["distance"] and round(r["distance"], 6) for r in near.collect()} == {1: 3.0, 2: 900.005, 3: None, 4: None}
    assert "FlatMapCoGroupsInPandas" in plan_of(near)
    assert sorted(r["id"] for r in points.buffered_out(a, b, "id", 300.0).collect()) == [2, 3, 4]


def test_pixels_are_counted_before_bins_are_fitted(spark, sf, monkeypatch):
    monkeypatch.setattr(fixtures, "TILES_A_TASK", 100)
    assert fixtures.fx(spark, sf, "fx_pixels").rdd.getNumPartitions() >= 15
    plan = plan_of(QUERIES["binned_columns"](spark, sf))
    assert "explode" not in plan


@pytest.mark.parametrize("spread", (10.0, 300.0))
def test_thinning_a_crowd_keeps_what_taking_in_order_keeps(spark, monkeypatch, spread):
    rng = random.Random(int(spread))
    rows = [(i, rng.uniform(-spread, spread), rng.uniform(-spread, spread), rng.random()) for i in range(400)] + [(900, None, 1.0, 0.5), (901, None, 1.0, 0.4)]
    df = spark.createDataFrame(rows, "id int, x double, y double, p double")
    monkeypatch.setattr(points, "pairs_within", None)  # no table of all near pairs
    want, taken = {900, 901}, []
    for i, x, y, _ in sorted((r for r in rows if r[1] is not None), key=lambda r: r[3]):
        if all((x - u) ** 2 + (y - v) ** 2 >= 900 for u, v in taken):
            taken.append((x, y))
            want.add(i)
    assert {r["id"] for r in points.thinned(df, "id", 30.0, F.col("p")).collect()} == want


def test_python_workers_get_small_batches(spark):
    texts = spark.range(0, 120, 1, 1).select(F.expr("repeat('x', 100000)").alias("text"))
    sizes = in_batches(texts, lambda batches: (pd.DataFrame({"n": [int(b["text"].str.len().sum())]}) for b in batches), "n long")
    got = [r["n"] for r in sizes.collect()]
    assert sum(got) == 12_000_000 and max(got) <= 2_200_000


@pytest.mark.parametrize("n", (20, 400))
def test_density_sends_no_points_or_nodes_to_the_driver(spark, n):
    rng = random.Random(3)
    df = spark.createDataFrame([(k, k % 2, rng.uniform(0, 3000), rng.uniform(0, 3000)) for k in range(n)], "sid long, g int, x double, y double")
    plan = points.density(df, "sid", strata=("g",), least=0)
    assert "SortMergeJoin" in plan_of(plan) and sent(plan)
    assert not [x for x in sent(plan) if re.search(r"\b(x|s_x|bx|node)#", x)]


def test_zones_and_shares_do_not_repeat_what_made_their_rows(spark):
    df = spark.range(100).selectExpr("id % 3 AS region", "id", "id * 0.5 AS density")
    assert "Range" not in plan_of(points.zoned(df, ("region",)))
    used = spark.range(60).selectExpr("concat('r', id % 2) AS region", "concat('e', id % 5) AS envelope_id")
    assert "Range" not in plan_of(envelopes.selection(used, used.where("envelope_id <> 'e0'")))


@pytest.mark.parametrize("name", ("density_overlap", "hotspot_classes"))
def test_shares_of_zones_are_made_from_written_counts(spark, sf, name):
    assert "SortMergeJoin" not in plan_of(QUERIES[name](spark, sf))


def test_hotspots_and_many_flagged_pixels_are_not_sent(spark, sf, monkeypatch):
    from landmosaic.plans import diagnosis

    out = QUERIES["duplicates_in_hotspots"](spark, sf)
    assert out.collect() and not [x for x in sent(out) if "hotspot" in x]
    monkeypatch.setattr(diagnosis, "few", lambda df: few(df, 3), raising=False)
    assert not [x for x in sent(diagnosis.flagged(spark, sf)) if "nonveg#" in x]


def test_few_sends_at_most_100_000_rows(spark):
    keys = saved(spark.range(100_001))
    joined = lambda df: plan_of(spark.range(10).join(df, "id"))
    assert "SortMergeJoin" in joined(few(keys)) and "BroadcastHashJoin" in joined(few(keys.where("id > 0")))


def test_class_lookup_samples_its_records_once(spark, sf, monkeypatch):
    from landmosaic.plans import habitat

    calls = []
    monkeypatch.setattr(habitat, "used", lambda *a, f=habitat.used: calls.append(a) or f(*a))
    assert QUERIES["class_lookup"](spark, sf).count() and len(calls) == 1


@pytest.mark.parametrize("name", ("bayes_auc", "best_schemes", "zones_without_background", "pixel_selection", "sample_tiles", "scheme_sweep"))
def test_no_step_of_a_query_sends_pixels_to_the_driver(spark, sf, monkeypatch, name):
    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **b: plans.append(self._df) or write(self, *a, **b))
    plans.append(QUERIES[name](spark, sf))
    below = [re.split(r"\n.*(?:Aggregate|Join)", f"\n{x}")[0] for df in plans for x in sent(df)]  # down to the first join or aggregate
    assert below and not [x for x in below if "Generate explode" in x]
