"""Registered queries answer for the whole table, not for a part of it picked by id or cap."""

import pytest

from terraframe.plans import QUERIES
from terraframe.sources.views import points_o


@pytest.mark.parametrize("name", ["n2_radius_join", "n2_radius_or_nearest", "n4_mean_elevation", "n5_curvature", "n5_normals"])
def test_every_point_is_asked(spark, sf, name):
    assert QUERIES[name](spark, sf).select("q_pid").distinct().count() == points_o(spark, sf).count()


def test_normals_by_brute_force(spark, sf):
    import numpy as np

    pts = points_o(spark, sf).select("cloud", "pid", "x", "y", "z").toPandas()
    got = QUERIES["n5_normals"](spark, sf).toPandas().set_index("q_pid")
    for _, g in pts.groupby("cloud"):
        xyz, pid = g[["x", "y", "z"]].to_numpy(), g["pid"].to_numpy()
        for i in range(len(g)):
            near = np.lexsort((pid, ((xyz - xyz[i]) ** 2).sum(1)))[:16]
            values = np.linalg.eigvalsh(np.cov(xyz[near].T))
            assert abs(got.at[pid[i], "curvature"] - max(values[0], 0) / values.sum()) < 1e-6


def test_statistics_take_all_rows(spark):
    rows = points_o(spark, "/root/testdata/sf0.01")
    assert QUERIES["a9_norm_stats"](spark, "/root/testdata/sf0.01").first()["n_points"] == rows.count() > 7000


def test_spacing_takes_all_points(spark):
    from terraframe.operators.spatial import nominal_spacing

    # 401 points 1 m apart about the centroid, 600 pairs 0.2 m apart further out: most distances are 0.2
    near = [("c", i, float(i - 200), 0.0) for i in range(401)]
    far = [("c", 1000 + 2 * i + j, (i - 300) * 3.0 + 0.2 * j, y) for y in (-900.0, 900.0) for i in range(300) for j in (0, 1)]
    far = [(c, p + (2000 if y > 0 else 0), x, y) for c, p, x, y in far]
    df = spark.createDataFrame(near + far, "cloud string, pid long, x double, y double")
    assert abs(nominal_spacing(df, 400).first()["spacing"] - 1.0) < 1e-6
    assert abs(nominal_spacing(df, None).first()["spacing"] - 0.2) < 1e-6


def test_farthest_points_of_the_centres_by_brute_force(spark, sf):
    import numpy as np

    from terraframe.operators.spatial import candidate_centres, farthest_point

    rows = points_o(spark, sf)
    ids = {(c, p) for c, p in candidate_centres(rows, 4.0, 10.0, 20).select("cloud", "center_id").collect()}
    pts = [r for r in rows.select("cloud", "pid", "x", "y", "z").collect() if (r["cloud"], r["pid"]) in ids]
    got = {(r["cloud"], r["pick"]): r["pid"] for r in QUERIES["n9_farthest_point"](spark, sf).collect()}
    want = {}
    for cloud in {p["cloud"] for p in pts}:
        g = sorted((p for p in pts if p["cloud"] == cloud), key=lambda p: p["pid"])
        xyz, d, at = np.array([p[2:] for p in g]), np.full(len(g), np.inf), 0
        for k in range(min(64, len(g))):
            want[cloud, k] = g[at]["pid"]
            d = np.minimum(d, ((xyz - xyz[at])[:, :2] ** 2).sum(1))
            d[at] = -1
            at = int(d.argmax())
    assert got == want
    # no group of a whole cloud in one task
    df = spark.createDataFrame([("c", i, float(i), 0.0, 0.0) for i in range(9)], "cloud string, pid long, x double, y double, z double")
    made = farthest_point(df, 3)
    assert "InPandas" not in made._jdf.queryExecution().toString()
    assert [r["pid"] for r in made.orderBy("pick").collect()] == [0, 8, 4]
    assert farthest_point(df.limit(0), 3).count() == 0


def test_tuner_runs_the_core(spark):
    import numpy as np

    from terraframe.operators import correct
    from terraframe.plans.correction import TUNED

    assert all(p.use_core for p in TUNED)
    assert all(len({getattr(p, g) for p in TUNED}) > 1 for g in ("theta0", "alpha", "beta"))
    rng = np.random.default_rng(5)
    x, y = (a.ravel() for a in np.meshgrid(np.linspace(0, 20, 18), np.linspace(0, 20, 18)))
    z, label = 0.3 * x + 0.3 * np.sin(y) + 0.05 * rng.normal(size=324), np.ones(324, int)
    label[::29] = 0
    z = z + np.where(label == 0, 4.0, 0.0)
    df = spark.createDataFrame([("c", i, *map(float, p), int(k), 1) for i, (p, k) in enumerate(zip(np.c_[x, y, z], label))], "cloud string, pid long, x double, y double, z double, label int, pred int")
    grid = [correct.Params(k=8), correct.Params(k=8, theta0=2.0, alpha=0.8)]
    want = []
    for p in grid:
        kept = {r["pid"] for r in correct.correct_ground(df, p, cap=60).filter("refined = 1").collect()}
        cells = {}
        for i in range(324):
            cell = cells.setdefault((min(int(x[i] - x.min()) // 2, 9), min(int(y[i] - y.min()) // 2, 9)), ([], []))
            cell[0].extend([z[i]] if label[i] == 1 else [])
            cell[1].extend([z[i]] if i in kept else [])
        want.append(np.sqrt(np.mean([(np.mean(b) - np.mean(a)) ** 2 for a, b in cells.values() if a and b])))
    assert want[0] != want[1]
    got = correct.tune_corrector(df, grid, res=2.0, cap=60).first()
    assert got["candidate"] == int(np.argmin(want))
    assert abs(got["error"] - min(want)) < 1e-6 and abs(got["default_error"] - want[0]) < 1e-6
