"""Quantiles, triangulations and reports of groups that no task holds, against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe.functions import quantiles as qu
from terraframe.functions.tin import delaunay, hull, locate
from terraframe.operators import metrics, spatial, surface


@pytest.mark.parametrize("held", [1 << 16, 8])
def test_quantiles_of_any_size(spark, monkeypatch, held):
    monkeypatch.setattr(qu, "HELD", held)
    monkeypatch.setattr(qu, "BUCKETS", 64)
    monkeypatch.setattr(qu, "BROADCAST_GROUPS", 2 if held == 8 else 100)
    rng = np.random.default_rng(held)
    groups = {"wide": 10.0 ** rng.uniform(-250, 250, 300) * rng.choice([-1, 1], 300), "ties": np.repeat([1.5, 2.5], 150), "same": np.full(200, 7.0), "even": rng.normal(size=501), "one": np.array([3.0]), "two": np.array([3.0, -4.0]), "ends": np.array([-1.7e308, 1.7e308] * 40 + [0.0])}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs] + [("even", None), ("none", None), ("even", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = [0.0, 0.02, 0.3, 0.5, 0.95, 1.0]
    got = {r["g"]: r["q"] for r in qu.quantiles(df, "v", probs, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        if g != "ends":
            assert np.allclose(got[g], np.percentile(vs, [100 * p for p in probs]), rtol=1e-12, atol=0), g
    assert got["ends"][0] == -1.7e308 and got["ends"][-1] == 1.7e308


def shaken(spark, pts):
    df = spark.createDataFrame([("A", *p) for p in pts.tolist()], "cloud string, x double, y double, z double")
    one = surface._shaken(df, ("cloud",)).toPandas()
    return one[["px", "py"]].to_numpy(), one["z"].to_numpy(), one[["x", "y"]].to_numpy()


def cloud(kind, seed=1, n=900):
    """Points in one dense corner and few elsewhere; in a round patch; on a grid; in two patches with nothing between."""
    rng = np.random.default_rng(seed)
    if kind == "clustered":
        xy = np.r_[rng.uniform(0, 4, (n, 2)), rng.uniform(0, 40, (n // 9, 2))]
    elif kind == "round":
        a, r = rng.uniform(0, 2 * np.pi, n), 20 * np.sqrt(rng.uniform(0, 1, n))
        xy = np.c_[20 + r * np.cos(a), 20 + r * np.sin(a)]
    elif kind == "grid":
        xy = np.array([(i * 1.0, j * 1.0) for i in range(25) for j in range(25)] + [(3.0, 3.0), (4.0, 4.0)])
    else:
        xy = np.r_[rng.uniform(0, 6, (n // 2, 2)), rng.uniform(30, 40, (n // 2, 2))]
    return np.c_[xy, np.sin(xy[:, 0] / 3) + xy[:, 1] ** 2 / 50 + rng.normal(size=len(xy)) * 0.05]


@pytest.mark.parametrize("kind", ["clustered", "round", "grid", "patches"])
def test_surface_is_that_of_one_triangulation(spark, kind):
    pts = cloud(kind)
    res = 1.3
    df = spark.createDataFrame([("A", i, *p, 1, 1) for i, p in enumerate(pts.tolist())], "cloud string, pid long, x double, y double, z double, label int, pred int")
    rows = df.join(metrics.corners(df, res), ["cloud"])
    got = {(r["row"], r["col"]): r["h"] for r in surface.tin_surface(rows, res, "h", cap=64).collect()}
    xy, z, true = shaken(spark, pts)
    h, w = (max(math.ceil(np.ptp(pts[:, k]) / res), 1) for k in (1, 0))
    cells = [(r, c) for r in range(h) for c in range(w)]
    at = np.array([(pts[:, 0].min() + (c + 0.5) * res, pts[:, 1].min() + (r + 0.5) * res) for r, c in cells])
    want, _ = locate(xy, z, at, delaunay(xy), true)
    assert {c for c, v in zip(cells, want) if not np.isnan(v)} == set(got)
    assert max(abs(got[c] - v) for c, v in zip(cells, want) if not np.isnan(v)) < 1e-7


def test_hull_corners():
    xy = np.random.default_rng(4).normal(size=(200, 2))
    on = set(hull(xy).tolist())
    angles = np.linspace(0, 2 * np.pi, 5000)
    assert {int((xy @ (np.cos(a), np.sin(a))).argmax()) for a in angles} <= on
    assert on <= {int((xy @ (np.cos(a), np.sin(a))).argmax()) for a in np.linspace(0, 2 * np.pi, 500_000)}


def test_errors_of_clouds_without_a_surface(spark):
    rows = [("A", i, float(i % 5), float(i // 5), 1.0, 1, 1) for i in range(25)] + [("B", i, float(i % 5), float(i // 5), 1.0, 1, 0) for i in range(25)]
    df = spark.createDataFrame(rows, "cloud string, pid long, x double, y double, z double, label int, pred int")
    worst = {r["cloud"]: (r["rmse"], r["max_error"]) for r in metrics.aggregate_error(metrics.dtm_errors(df), clouds=df).collect()}
    assert worst == {"A": (0.0, 0.0), "B": (math.inf, math.inf)}
    assert {r["cloud"]: (r["sse"], r["n"], r["total_rmse"]) for r in metrics.dtm_rmse(df).collect()} == {"A": (0.0, 16, 0.0), "B": (0.0, 0, 0.0)}
    assert [r["total_rmse"] for r in metrics.dtm_rmse(df.filter("cloud = 'B'")).collect()] == [None]


def test_profile_by_hand(spark):
    """100 ground points at x = 0, 0.1 ... 9.9 with z = x in the band, others far off it or of another label."""
    ground = [("A", 10 + 0.1 * i, 50.0, 0.1 * i, 1) for i in range(100)]
    other = [("A", 5.0, 50.0, 99.0, 0)] + [("A", 12.0, y, 99.0, 1) for y in (43.0, 57.0) for _ in range(30)] + [("A", 12.0, y, 5.0, 0) for y in (0.0, 100.0)]
    df = spark.createDataFrame(ground + other, "cloud string, x double, y double, z double, label int")
    got = metrics.profile(df, bins=10).orderBy("bin").collect()
    assert [r["n"] for r in got] == [10] * 10
    assert np.allclose([r["x"] for r in got], [5 + 9.9 * (k + 0.5) / 10 for k in range(10)])
    assert np.allclose([r["z"] for r in got], [np.percentile([0.1 * i for i in range(10 * k, 10 * k + 10)], 30) for k in range(10)])
    assert metrics.profile(df.filter("label = 0")).count() == 0


@pytest.mark.parametrize("n", [96, 97, 200, 1000])
def test_candidate_tiles_are_the_rounded_places(spark, n):
    """Each tile's plane residual is its number, so the best ten are the last ten candidates with enough ground."""
    tiles = spark.range(n).withColumn("cloud", F.format_string("t%05d", "id"))
    pts = tiles.crossJoin(F.broadcast(spark.range(8).withColumnRenamed("id", "i"))).crossJoin(F.broadcast(spark.range(8).withColumnRenamed("id", "j")))
    df = pts.selectExpr("cloud", "CAST(i AS DOUBLE) AS x", "CAST(j AS DOUBLE) AS y", "(id + 1.0D) * ((i + j) % 2) AS z", "IF(id % 7 = 3 AND i = 0, 0, 1) AS label")
    places = sorted({int(v) for v in np.linspace(0, n - 1, 96).round()}) if n > 96 else range(n)
    want = [f"t{k:05d}" for k in places if k % 7 != 3][::-1][:10]
    assert [r["cloud"] for r in spatial.cliff_tiles(df, 10).collect()] == want


def test_profile_of_neighbours_cuts_percentiles(spark):
    df = spark.createDataFrame([("A", float(i), 0.0, 0.0) for i in range(7)], "cloud string, x double, y double, z double").withColumn("pid", F.monotonically_increasing_id())
    (row,) = spatial.neighbour_profile(df, 0.5, 2.0, levels=1, pct=0.3).collect()
    # 3, 4, 5, 5, 5, 4, 3 neighbours within two metres, themselves included
    assert (row["median_n"], row["pct_n"], row["max_n"], row["cap_n"]) == (4, 3, 5, 3)


@pytest.mark.parametrize("kind", ["clustered", "round", "patches"])
def test_few_points_find_the_triangles_of_all(kind):
    """Places few against the points: the same heights and circles as in the triangulation of all points, which isn't made."""
    xyz = cloud(kind)
    xy, z = xyz[:, :2], xyz[:, 2]
    at = np.array([[3.1, 2.2], [20.3, 20.1], [35.2, 33.3], [90.0, 1.0]])
    want, got = surface.locate(xy, z, at, surface.delaunay(xy), xy), surface.sparse_locate(xy, z, at, xy)
    assert np.allclose(want[0], got[0], equal_nan=True) and np.allclose(want[1], got[1], equal_nan=True)
    assert len(xy) > 2 * surface.FEW * len(at)
