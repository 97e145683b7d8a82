"""The spike corrector against a plain sequential version, and the small cases that tell its rules apart."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe.operators import correct, metrics, raster, sample, spatial, voxel

POINTS = "cloud string, pid long, x double, y double, z double"


def table_of(spark, xyz, cloud="A"):
    return spark.createDataFrame([(cloud, i, *map(float, p)) for i, p in enumerate(xyz)], POINTS)


def slope(n=40, side=30.0, seed=1):
    rng = np.random.default_rng(seed)
    x, y = np.meshgrid(np.linspace(0, side, n), np.linspace(0, side, n))
    return np.c_[x.ravel(), y.ravel(), 0.4 * x.ravel() + 0.05 * rng.normal(size=n * n)]


def order(at, points, k):
    """The k nearest of points to one place, ties to the smaller index."""
    return np.lexsort((np.arange(len(points)), ((points - at) ** 2).sum(1)))[:k]


def cut(residual, n_mad):
    med = np.median(residual)
    mad = 1.4826 * np.median(np.abs(residual - med))
    return med + n_mad * (mad if mad > 1e-9 else residual.std() + 1e-9)


def plain_core(xyz, near, theta0, alpha, beta):
    curv, normal = np.empty(len(xyz)), np.empty((len(xyz), 3))
    for i, js in enumerate(near):
        values, vectors = np.linalg.eigh(np.cov(xyz[js].T))
        curv[i], normal[i] = max(values[0], 0) / values.sum(), vectors[:, 0]
    theta = np.radians(theta0 * (1 + beta * curv[near].var(1)))
    tau = alpha * curv[near].mean(1)
    seen, core = np.zeros(len(xyz), bool), np.zeros(len(xyz), bool)
    for first in np.lexsort((np.arange(len(xyz)), curv)):
        if seen[first]:
            continue
        seen[first] = core[first] = True
        queue = [first]
        for i in queue:
            for j in near[i]:
                if not seen[j]:
                    seen[j] = True
                    if np.arccos(min(abs(normal[i] @ normal[j]), 1)) < theta[i] and curv[j] < tau[i]:
                        core[j] = True
                        queue.append(j)
    return core


def plain_seeds(xyz, base_res):
    cell = np.floor((xyz[:, :2] - xyz[:, :2].min(0)) / base_res).astype(int)
    half = np.floor(2 * (xyz[:, :2] - xyz[:, :2].min(0)) / base_res).astype(int)
    members = {}
    for i, c in enumerate(map(tuple, cell)):
        members.setdefault(c, []).append(i)
    mean = len(xyz) / len(members)
    low = {}
    for c, js in members.items():
        for j in js:
            key = (c, tuple(half[j])) if len(js) > mean else (c,)
            if key not in low or (xyz[j, 2], j) < (xyz[low[key], 2], low[key]):
                low[key] = j
    return sorted(low.values())


def plain_correct(xyz, p):
    """Indices of the demoted points of one cloud of ground points, step by step."""
    near = np.array([[j for j in order(xyz[i], xyz, p.k + 1) if j != i][: p.k] for i in range(len(xyz))])
    core = plain_core(xyz, near, p.theta0, p.alpha, p.beta)
    area = np.prod(np.ptp(xyz[:, :2], axis=0) + 1e-9)
    res = p.base_res or float(np.clip(np.sqrt(8 / (len(xyz) / area)), 1, 20))
    source = np.flatnonzero(core) if core.sum() >= 32 else np.arange(len(xyz))
    seeds = source[plain_seeds(xyz[source], res)]
    if len(seeds) >= 12:
        residual = np.empty(len(seeds))
        for i, s in enumerate(seeds):
            js = seeds[order(xyz[s, :2], xyz[seeds, :2], 12)]
            a = np.c_[xyz[js, :2], np.ones(len(js))]
            residual[i] = xyz[s, 2] - np.r_[xyz[s, :2], 1] @ np.linalg.lstsq(a, xyz[js, 2], rcond=None)[0]
        seeds = seeds[residual <= cut(residual, 3.0)]
    rest = np.setdiff1d(np.arange(len(xyz)), seeds)
    k = int(np.clip(round(np.sqrt(len(seeds))), 10, 30))
    cells = {}
    for i, c in zip(rest, map(tuple, np.floor((xyz[rest, :2] - xyz[:, :2].min(0)) / res).astype(int))):
        cells.setdefault(c, []).append(i)
    residual = np.empty(len(xyz))
    for js in cells.values():
        ctrl = seeds[order(xyz[js, :2].mean(0), xyz[seeds, :2], k)]
        residual[js] = xyz[js, 2] - correct.thin_plate(xyz[ctrl, :2], xyz[ctrl, 2], xyz[js, :2])
    return set(rest[residual[rest] > max(cut(residual[rest], p.n_mad), p.floor)].tolist())


def rough(seed, n=22, side=20.0):
    rng = np.random.default_rng(seed)
    xyz = slope(n, side, seed)
    xyz[:, :2] += rng.uniform(-0.2, 0.2, (len(xyz), 2))
    up = rng.choice(len(xyz), 8, replace=False)
    xyz[up, 2] += rng.uniform(1, 6, 8)
    return xyz


@pytest.mark.parametrize("params", [correct.Params(k=10), correct.Params(k=10, alpha=1.2, theta0=20.0, n_mad=2.0, base_res=3.0)])
def test_corrector_step_by_step(spark, params):
    clouds = {f"c{s}": rough(s) for s in (1, 2)}
    df = None
    for name, xyz in clouds.items():
        df = table_of(spark, xyz, name) if df is None else df.unionByName(table_of(spark, xyz, name))
    got = correct.correct_ground(df.withColumn("pred", F.lit(1)), params).filter("refined = 0").collect()
    for name, xyz in clouds.items():
        assert {r["pid"] for r in got if r["cloud"] == name} == plain_correct(xyz, params)


@pytest.mark.parametrize(("theta0", "alpha"), [(10.0, 0.5), (40.0, 1.6)])
def test_regions_cross_blocks(spark, theta0, alpha):
    """Blocks of some dozens of points give what one queue over the cloud gives, for regions that wind through all of them."""
    xyz = rough(3, 26, 24.0)
    df = table_of(spark, xyz, "A").unionByName(table_of(spark, rough(4, 8, 6.0), "B"))
    shape, near = correct.growth_thresholds(df, 8, theta0, alpha, 0.7)
    rows = {}
    for cap in (10**6, 40):
        got = correct.region_grow(shape, near, df, cap).filter("cloud = 'A'").collect()
        rows[cap] = {r["pid"]: r["region"] for r in got}
        assert all(r["core"] == (r["region"] is not None) for r in got)
    assert rows[40] == rows[10**6]
    d2 = ((xyz[:, None] - xyz[None]) ** 2).sum(-1)
    np.fill_diagonal(d2, np.inf)
    core = plain_core(xyz, np.argsort(d2, axis=1, kind="stable")[:, :8], theta0, alpha, 0.7)
    assert [rows[40][i] is not None for i in range(len(xyz))] == core.tolist()
    sizes = np.unique([v for v in rows[40].values() if v is not None], return_counts=True)[1]
    assert sizes.max() > (200 if alpha > 1 else 5)


def test_spikes_go_pits_and_clean_ground_stay(spark):
    base, rng = slope(), np.random.default_rng(2)
    some = rng.choice(len(base), 34, replace=False)
    giant, subtle, pits = some[:12], some[12:24], some[24:]
    hit = base.copy()
    hit[giant, 2] += np.linspace(3, 15, 12)
    hit[subtle, 2] += np.linspace(0.8, 1.5, 12)
    hit[pits, 2] -= np.linspace(0.5, 2, 10)
    df = table_of(spark, hit, "hit").unionByName(table_of(spark, base, "clean")).withColumn("pred", F.lit(1))
    out = {(r["cloud"], r["pid"]): r["refined"] for r in correct.correct_ground(df, correct.Params(k=10)).collect()}
    assert all(out["hit", int(i)] == 0 for i in giant)
    assert all(out["hit", int(i)] == 0 for i in subtle)
    assert all(out["hit", int(i)] == 1 for i in pits)
    assert sum(v == 0 for (c, _), v in out.items() if c == "clean") <= 0.01 * len(base)


def test_globals_override_per_cloud(spark):
    xyz = rough(3)
    df = table_of(spark, xyz, "own").unionByName(table_of(spark, xyz, "default")).unionByName(table_of(spark, xyz, "bad")).withColumn("pred", F.lit(1))
    given = spark.createDataFrame([("own", 20.0, 5.0, 0.2, 2.0, 3.0, 0.3), ("bad", 20.0, float("nan"), 0.2, 2.0, 3.0, 0.3)], "cloud string, theta0 double, alpha double, beta double, n_mad double, base_res double, floor double")
    got = correct.correct_ground(df, correct.Params(k=10), given).filter("refined = 0").collect()
    of = lambda c: {r["pid"] for r in got if r["cloud"] == c}
    assert of("own") == plain_correct(xyz, correct.Params(k=10, theta0=20.0, alpha=0.9, beta=0.2, n_mad=2.0, base_res=3.0, floor=0.3))  # alpha is cut to its box
    assert of("default") == of("bad") == plain_correct(xyz, correct.Params(k=10))


def test_mean_elevation_by_hand(spark):
    near = spark.createDataFrame([("A", 1, float(z)) for z in (0, 1, 4)] + [("A", 2, 5.0)] * 3, "cloud string, q_pid long, z double")
    got = {r["q_pid"]: r["mean_elev"] for r in spatial.mean_elevation(near).collect()}
    assert got == {1: pytest.approx((1 * 0.25 + 4 * 1.0) / 1.25), 2: 0.0}


def test_z_range_by_hand(spark):
    df = spark.createDataFrame([("flat", 2.0)] * 5 + [("one", 0.0)] * 400 + [("one", 9.0)] + [("even", float(i)) for i in range(101)], "cloud string, z double")
    got = {r["cloud"]: (r["z_lo"], r["z_hi"]) for r in metrics.z_range(df).collect()}
    assert got == {"flat": (2.0, 3.0), "one": (0.0, 9.0), "even": (2.0, 98.0)}


def test_prediction_stats_by_hand(spark):
    df = spark.createDataFrame([("a", 1, 1.0, 0.5), ("a", 1, 3.0, 1.0), ("a", 0, 8.0, 0.0), ("none", 0, 2.0, 0.25), ("none", 0, 2.0, 0.25)], "cloud string, pred int, z double, p_ground double")
    got = {r["cloud"]: r for r in voxel.prediction_stats(df).collect()}
    a = got["a"]
    assert (a["ground_share"], a["dz"], a["std_ground"], a["z_range"], a["mean_p"]) == (pytest.approx(2 / 3), pytest.approx(-0.2), pytest.approx(0.1), pytest.approx(0.7), pytest.approx(0.5))
    assert a["std_ratio"] == pytest.approx(1 / (np.std([1, 3, 8]) + 1e-3))
    assert (got["none"]["dz"], got["none"]["std_ground"], got["none"]["std_ratio"]) == (pytest.approx(-0.2), 0.0, 0.0)


def test_elastic_moves_far_points_apart(spark):
    """A cloud too long for the grid gets a wider spacing, not a rigid rest."""
    df = table_of(spark, np.c_[np.arange(400), np.zeros(400), np.zeros(400)])
    got = {r["pid"]: r["x"] - r["pid"] for r in sample.augment_elastic(df, 1.0, 1.0, "e").collect()}
    assert len({round(v, 9) for k, v in got.items() if k >= 130}) > 200
    assert max(abs(got[k + 1] - got[k]) for k in range(399)) < 0.5


def test_crops_that_hold_less_than_a_block(spark):
    cells = spark.createDataFrame([("in", r, c, float(r * 4 + c)) for r in range(4) for c in range(4)] + [("out", 0, 0, 1.0)], "cloud string, row long, col long, value double")
    frame = spark.createDataFrame([("in", 0.0, 0.0, 4, 4), ("out", 0.0, 0.0, 1, 1)], "cloud string, x_min double, y_min double, h long, w long")
    whole = {(r["cloud"], r["row"], r["col"]): r["value"] for r in raster.crop_downsample(cells, frame, (0.0, 0.0, 3.0, 3.0), 1.0, 2.0).filter("cloud = 'in'").collect()}
    assert whole == {("in", 0, 0): 2.5, ("in", 0, 1): 4.5, ("in", 1, 0): 10.5, ("in", 1, 1): 12.5}
    small = raster.crop_downsample(cells, frame, (3.0, 3.0, 3.5, 3.5), 1.0, 2.0).collect()
    assert sorted((r["cloud"], r["row"], r["col"], r["value"]) for r in small if r["cloud"] == "in") == [("in", 0, 0, 15.0)]
    assert [(r["row"], r["col"], r["value"]) for r in small if r["cloud"] == "out"] == [(0, 0, None)]


def test_crop_of_a_raster_with_an_unknown_border(spark):
    """9 x 9 cells of which the last row and column are unknown: nine blocks, the outer ones of what they know."""
    cells = spark.createDataFrame([("a", r, c, float(10 * r + c)) for r in range(8) for c in range(8)], "cloud string, row long, col long, value double")
    frame = spark.createDataFrame([("a", 100.0, 50.0, 9, 9)], "cloud string, x_min double, y_min double, h long, w long")
    got = {(r["row"], r["col"]): r["value"] for r in raster.crop_downsample(cells, frame, (100.0, 50.0, 109.0, 59.0), 1.0, 3.0).collect()}
    assert got == {(i, j): 10 * (1 + 3 * i - (i == 2) * 0.5) + 1 + 3 * j - (j == 2) * 0.5 for i in range(3) for j in range(3)}
    five = raster.crop_downsample(cells.withColumn("b", F.col("value")), frame, (100.0, 50.0, 109.0, 59.0), 1.0, 3.0, ["value", "b"])
    assert {(r["row"], r["col"]): r["b"] for r in five.collect()}[2, 2] is None


def test_centres_of_a_thin_cloud(spark):
    df = table_of(spark, [(0, 0, 0), (100, 0, 0), (51, 0, 0), (52, 0, 0)])
    got = spatial.candidate_centres(df, 3.0, 20.0, 3).collect()
    assert [(r["center_id"], r["members"]) for r in got] == [(2, [0, 1, 2, 3])]  # nearest the centroid, with all: its disc holds two


def test_farthest_points_look_at_the_plane(spark):
    df = table_of(spark, [(0, 0, 0), (1, 0, 99), (5, 0, 0), (2, 0, 0)])
    got = {r["pick"]: r["pid"] for r in spatial.farthest_point(df, 3).collect()}
    assert got == {0: 0, 1: 2, 2: 3}


def test_best_average_passes_over_gaps(spark):
    history = spark.createDataFrame([(1, 1.0), (2, float("nan")), (3, None), (4, 0.0), (5, float("inf")), (6, 2.0)], "epoch int, miou double")
    r = metrics.ema_best(history, "miou").first()
    assert (r["epoch"], r["ema"]) == (4, pytest.approx(0.9))
