"""Projections and grids of layers, turned patches and cuts against plain versions."""

import math

import numpy as np
import pytest

from landmosaic.operators import grids, metrics, points, sampling, views

LAYERS = [("flat", None, None, None, None, -74.0, 48.0, 0.01, 600, 800), ("metres", 29.5, 45.5, 23.0, -96.0, 1_600_000.0, 3_100_000.0, 30.0, 30_000, 30_000)]


@pytest.fixture(scope="module")
def layers(spark):
    return spark.createDataFrame(LAYERS, grids.GRID)


def test_published_point_of_the_projection(spark):
    """Snyder's worked example is on another ellipsoid; here the parallels' scale is checked: a degree of longitude has its true length on them."""
    g = spark.createDataFrame([("m", 29.5, 45.5, 23.0, -96.0, 0.0, 0.0, 1.0, 1, 1)], grids.GRID)
    for lat in (29.5, 45.5):
        a, b = grids.located(spark.createDataFrame([(-96.0005, lat), (-95.9995, lat)], "lon double, lat double"), g).orderBy("lon").collect()
        e2 = (1 / 298.257222101) * (2 - 1 / 298.257222101)
        true = math.radians(0.001) * 6378137.0 * math.cos(math.radians(lat)) / math.sqrt(1 - e2 * math.sin(math.radians(lat)) ** 2)
        assert b["x"] - a["x"] == pytest.approx(true, rel=1e-7)


def test_pixels_go_back_to_their_centres(spark, layers):
    pts = spark.createDataFrame([(i, -74 + i * 0.31, 42.5 + i * 0.23) for i in range(24)], "id int, lon double, lat double")
    at = grids.located(pts, layers)
    got = grids.centres(at.where("inside").select("id", "feature", "row_id", "col_id"), layers).join(pts.withColumnsRenamed({"lon": "lon0", "lat": "lat0"}), "id").collect()
    assert len(got) > 30
    for r in got:
        far = max(abs(r["lat"] - r["lat0"]) * 111_200, abs(r["lon"] - r["lon0"]) * 111_200 * math.cos(math.radians(r["lat"])))
        assert far < (1_200 if r["feature"] == "flat" else 45)


def test_window_holds_the_whole_box(spark, layers):
    box = spark.createDataFrame([("b", -71.5, 43.0, -70.5, 44.0), ("tiny", -71.5, 43.0, -71.4999, 43.0001), ("away", 10.0, 43.0, 11.0, 44.0)], "id string, min_lon double, min_lat double, max_lon double, max_lat double")
    w = {(r["id"], r["feature"]): r for r in grids.windows(box, layers, pad=5).collect()}
    inner = spark.createDataFrame([(x, y) for x in (-71.5, -71.0, -70.5) for y in (43.0, 43.5, 44.0)], "lon double, lat double")
    for r in grids.located(inner, layers).collect():
        k = w["b", r["feature"]]
        assert k["large"] and k["c_start"] <= r["col_id"] < k["c_end"] and (r["feature"] == "metres" or k["r_start"] <= r["row_id"] < k["r_end"])
    assert not w["tiny", "flat"]["large"] and not w["away", "metres"]["large"]


def test_sampling_by_grid(spark, layers):
    pts = spark.createDataFrame([("a", -73.995, 47.995), ("b", -73.995, 47.995), ("c", 0.0, 0.0)], "id string, lon double, lat double")
    values = spark.createDataFrame([("flat", 0, 0, 5), ("flat", 0, 0, 7), ("flat", 1, 0, 9), ("metres", 0, 0, 1)], "feature string, row_id int, col_id int, value int")
    assert sorted(map(tuple, grids.sampled_by_grid(pts, layers, values, ("id",), ("flat", "metres")).collect())) == [("a", 7, None), ("b", 7, None), ("c", None, None)]


@pytest.mark.parametrize("side", [1, 3, 4])
def test_views(spark, side):
    rows = [(i, list(map(float, np.random.default_rng(i).integers(0, 99, side * side)))) for i in range(3)]
    got = views.expanded(spark.createDataFrame([*rows, (9, None)], "id int, patch array<double>"), "patch", side).collect()
    assert len(got) == 32
    for r in got:
        if r["id"] < 9:
            m = np.rot90(np.array(rows[r["id"]][1]).reshape(side, side), r["rot"])
            assert r["patch"] == list((np.fliplr(m) if r["flip"] else m).ravel())
    assert views.expanded(spark.createDataFrame(rows, "id int, patch array<double>"), "patch", side, flips=False).count() == 12
    with pytest.raises(Exception, match="square"):
        views.expanded(spark.createDataFrame([(1, [0.0] * (side * side + 1))], "id int, patch array<double>"), "patch", side).collect()


@pytest.mark.parametrize("seed", range(6))
def test_best_cut(spark, seed):
    r = np.random.default_rng(seed)
    rows = [(i, float(r.integers(0, 4)), int(r.integers(0, 2)) if seed else 1) for i in range(12)]
    s = sorted(rows, key=lambda x: (x[1], x[0]))
    right = [sum(y == 0 for _, _, y in s[:k]) + sum(y == 1 for _, _, y in s[k:]) for k in range(13)]
    k = right.index(max(right))
    want = s[0][1] - 1e-6 if k == 0 else s[-1][1] + 1e-6 if k == 12 else (s[k - 1][1] + s[k][1]) / 2
    got = metrics.best_cut(spark.createDataFrame(rows, "point_id int, logit double, y int")).collect()
    assert [(g["threshold"], g["correct"]) for g in got] == [(pytest.approx(want), max(right))]


def test_verdicts_and_balance(spark):
    v = spark.createDataFrame([("a", True, 10), ("a", False, 2), ("b", True, 1), ("b", False, 2), ("c", True, 2), ("c", False, 2), ("d", True, 1)], "region string, flag boolean, n_visits int")
    assert {r["region"]: r["verdict"] for r in points.visit_verdict(v, "flag", ("region",)).collect()} == {"a": "visited more", "b": "visited less", "c": "inconclusive"}
    rows = spark.createDataFrame([("a", "train", 1), ("a", "train", 0), ("a", "val", 1)], "region string, split string, label int")
    got = {r["split"]: (r["seen"], r["ratio"], r["majority_pct"], r["severe"]) for r in sampling.balance(rows).collect()}
    assert got == {"train": (4, 4.0, 80.0, True), "val": (4, 4.0, 100.0, True)}
    years = spark.createDataFrame([(1, None), (2, 2020)], "id int, year int")
    assert sorted(r["year"] for r in sampling.dated(years, 2024).collect()) == [2020, 2020] and sampling.dated(years.where("id = 1"), 2024).first()["year"] == 2024
    assert points.visit_verdict(v.limit(0), "flag").count() == 0 == sampling.balance(rows.limit(0)).count()
    assert metrics.fit_temperature(spark.createDataFrame([], "logit double, y int")) == 1.0
