"""Windows, scored grids and naive Bayes against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from landmosaic.functions import scores
from landmosaic.operators import bayes, patches, raster


@pytest.fixture(scope="module")
def world(spark):
    """A ragged raster with holes, masked values, repeated pixels and negative indices."""
    r = np.random.default_rng(5)
    rows = []
    for i in range(-30, 45):
        for j in range(-20, 60):
            if (i * 7 + j * 3) % 11:
                rows.append((i, j, int(r.integers(1, 5)) if (i + j) % 13 else -9999, int(r.integers(0, 50)) if (i * j) % 9 else None))
    rows += [(0, 0, 4, 49), (0, 0, 1, 3)]
    best = {}
    for i, j, k, v in rows:
        a, b = best.get((i, j), (None, None))
        best[i, j] = (max((x for x in (a, None if k == -9999 else k) if x is not None), default=None), max((x for x in (b, v) if x is not None), default=None))
    return spark.createDataFrame(rows, "row_id int, col_id int, evt int, ch int").repartition(5), best


@pytest.mark.parametrize(("side", "tile"), [(8, 16), (7, 5), (2, 64), (40, 8)])
def test_window_sums(spark, world, side, tile):
    pixels, best = world
    spots = [(0, 0), (0, 0), (44, 59), (-30, -20), (3, 17), (500, 500), (12, 12)]
    got = patches.window_sums(spark.createDataFrame(spots, "row_id int, col_id int"), pixels, ("evt",), ("ch",), side, tile).collect()
    want, half = {}, side // 2
    for i, j in set(spots):
        for a in range(i - half, i - half + side):
            for b in range(j - half, j - half + side):
                k, v = best.get((a, b), (None, None))
                for key, value in (((i, j, "evt", k), 1 if k is not None else None), ((i, j, "ch", None), v)):
                    if value is not None:
                        n, total = want.get(key, (0, 0))
                        want[key] = (n + 1, total + value)
    assert {(x["row_id"], x["col_id"], x["feature"], x["code"]): (x["n"], x["total"]) for x in got} == want


def test_points_share_windows_and_padding_counts(spark, world):
    pixels, best = world
    at = spark.createDataFrame([("a", 0, 0), ("b", 0, 0), ("c", 900, 900)], "id string, row_id int, col_id int")
    sums = patches.window_sums(at, pixels, ("evt",), ("ch",), 8)
    shares = {(r["id"], r["code"]): r["share"] for r in patches.class_shares(at, sums, 8).collect()}
    assert {k: v for k, v in shares.items() if k[0] == "a"} == {("a", k): v for (i, k), v in shares.items() if i == "b"} and 0 < sum(v for (i, _), v in shares.items() if i == "a") < 1
    rows = {r["id"]: r for r in patches.pooled(patches.centre_codes(at, pixels, ("evt",)), sums, ("ch",), 8).collect()}
    assert rows["c"]["ch_mean"] == 0 and rows["c"]["evt_centre"] == 0 and rows["a"]["evt_centre"] == best[0, 0][0]
    assert patches.window_sums(at.limit(0), pixels, ("evt",), ("ch",), 8).count() == 0 == patches.window_sums(at, pixels.limit(0), ("evt",), ("ch",), 8).count()


@pytest.mark.parametrize(("side", "tile", "stride", "origin"), [(8, 16, 3, (0, 0)), (6, 7, 4, (2, -1)), (16, 128, 5, (1, 1))])
def test_scored_grid_averages_the_views_of_each_patch(spark, world, side, tile, stride, origin):
    pixels, best = world
    logit = {k: (v / 10 - 2) for k, (_, v) in best.items() if v is not None}
    df = spark.createDataFrame([(i, j, v) for (i, j), v in logit.items()], "row_id int, col_id int, logit double")
    got = {(r["row_id"], r["col_id"]): (r["logit"], r["p"]) for r in patches.scored_grid(df, stride, side, origin, 0.3, 1.7, tile).collect()}
    assert set(got) == {(i, j) for i, j in logit if (i - origin[0]) % stride == 0 and (j - origin[1]) % stride == 0}
    sample = sorted(got)[:: max(1, len(got) // 12)]
    cut = [(i, j, [logit.get((i - side // 2 + a, j - side // 2 + b), 0.0) for a in range(side) for b in range(side)]) for i, j in sample]
    views = [scores.rotated(F.col("patch"), side, k, flip) for k, flip in patches.VIEWS]
    middle = side // 2 * side + side // 2
    mean = lambda v: F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / (side * side)
    each = [0.3 * v[middle] + 0.7 * mean(v) for v in views]
    for r in spark.createDataFrame(cut, "row_id int, col_id int, patch array<double>").select("row_id", "col_id", sum(each[1:], each[0]).alias("s")).collect():
        z = r["s"] / 8
        assert got[r["row_id"], r["col_id"]] == pytest.approx((z, 1 / (1 + np.exp(-z / 1.7))))


def test_surface_is_read_back_with_its_affine(spark, tmp_path):
    grid = spark.createDataFrame([("A", 10, 26, 0.5), ("B", 18, 2, 0.25)], "region string, row_id int, col_id int, p double")
    back = patches.write_surface(grid, str(tmp_path / "surface"), 8, (2, 2))
    assert "region" in back.where("region = 'A'")._jdf.queryExecution().executedPlan().toString() and "PartitionFilters: [isnotnull(region" in back.where("region = 'A'")._jdf.queryExecution().executedPlan().toString()
    for r in back.collect():
        assert (r["x"], r["y"]) == pytest.approx((r["c"] + r["grid_col"] * r["a"], r["f"] + r["grid_row"] * r["e"]))
    assert {(r["region"], r["grid_row"], r["grid_col"]) for r in back.collect()} == {("A", 1, 3), ("B", 2, 0)}


def test_naive_bayes(spark):
    rows = [("a", 1, 1, 2.0), ("a", 2, 0, 1.0), ("b", 1, 0, None), ("b", None, 1, 0.5), (None, 2, 0, 4.0)]
    df = spark.createDataFrame(rows, "f string, g int, y int, weight double")
    table, prior = bayes.fitted(df, ("f", "g"))
    got = {(r["feature"], r["code"]): r["log_odds"] for r in table.collect()}
    share = lambda n, all_n, kinds: (n + 1) / (all_n + kinds)
    want = {("f", "a"): (2, 1, 2.5, 2), ("f", "b"): (0.5, 1, 2.5, 2), ("g", "1"): (2, 1, 2, 6), ("g", "2"): (0, 5, 2, 6)}
    assert got == pytest.approx({k: np.log(share(p, ap, 2) / share(n, an, 2)) for k, (p, n, ap, an) in want.items()})
    assert prior == pytest.approx(np.log(3.5 / 7))
    fresh = spark.createDataFrame([("a", 7), (None, 1)], "f string, g int")
    assert [r["logit"] for r in bayes.with_logit(fresh, (table, prior), ("f", "g")).orderBy("g").collect()] == pytest.approx([prior + got["g", "1"], prior + got["f", "a"]])


def test_a_repeated_pixel_of_a_tile_is_its_greatest_value(spark):
    pixels = spark.createDataFrame([(0, 0, 5), (0, 0, 7), (0, 1, None), (1, 1, 2), (1, 1, 2)], "row_id int, col_id int, evt int")
    assert [tuple(r["data"]) for r in raster.tiled(pixels, ("evt",), 2).collect()] == [(7, None, None, 2)]
