"""Operators on made points: rules that no SQL on the driver tables can show."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraframe.operators import catalog, correct, metrics, project, raster, sample, score, spatial, voxel
from terraframe.sources import files

POINTS = "cloud string, pid long, x double, y double, z double"


def points(spark, xyz, cloud="A", extra=None):
    rows = [(cloud, i, *map(float, p)) for i, p in enumerate(xyz)]
    return spark.createDataFrame(rows, POINTS)


def slope(n=60, side=30.0, seed=1, grade=0.4):
    rng = np.random.default_rng(seed)
    g = np.linspace(0, side, n)
    x, y = np.meshgrid(g, g)
    return np.c_[x.ravel(), y.ravel(), grade * x.ravel() + 0.05 * rng.normal(size=n * n)]


def test_spikes_are_demoted_and_clean_slope_stays(spark):
    base = slope(40)
    rng = np.random.default_rng(2)
    up = rng.choice(len(base), 10, replace=False)
    spiked = base.copy()
    spiked[up, 2] += np.linspace(3, 15, 10)
    df = points(spark, spiked, "spiked").unionByName(points(spark, base, "clean")).withColumn("pred", F.lit(1))
    out = {(r["cloud"], r["pid"]): r["refined"] for r in correct.correct_ground(df, correct.Params(k=10)).collect()}
    assert sum(out["spiked", int(i)] == 0 for i in up) >= 8
    assert sum(v == 0 for (c, _), v in out.items() if c == "clean") < 0.05 * len(base)


def test_corrector_leaves_small_clouds(spark):
    df = points(spark, slope(3)).withColumn("pred", F.lit(1))
    assert all(r["refined"] == 1 for r in correct.correct_ground(df).collect())


def test_knn_is_exact_on_uneven_clouds(spark):
    rng = np.random.default_rng(3)
    xyz = np.r_[rng.normal(size=(300, 3)), 50 + 0.01 * rng.normal(size=(100, 3)), [[500, 500, 500]]]
    df = points(spark, xyz).unionByName(points(spark, xyz[:3], "tiny"))
    got = {}
    for r in spatial.knn_join(df, df, 6, 3, cap=30).collect():
        got.setdefault((r["cloud"], r["q_pid"]), []).append((r["rank"], r["pid"]))
    for cloud, pts in (("A", xyz), ("tiny", xyz[:3])):
        d = ((pts[:, None] - pts[None]) ** 2).sum(-1)
        for i in range(len(pts)):
            want = sorted(range(len(pts)), key=lambda j: (d[i, j], j))[:6]
            have = [p for _, p in sorted(got[cloud, i])]
            assert np.allclose(np.sort(d[i, have]), np.sort(d[i, want]))
            assert len(have) == len(want)


def test_nearest_fill_cases(spark):
    frame = spark.createDataFrame([("one", 0.0, 0.0, 4, 5), ("none", 0.0, 0.0, 2, 2), ("full", 0.0, 0.0, 1, 2)], "cloud string, x_min double, y_min double, h long, w long")
    cells = spark.createDataFrame([("one", 1, 2, 7.0), ("full", 0, 0, 1.0), ("full", 0, 1, 2.0)], "cloud string, row long, col long, value double")
    got = {(r["cloud"], r["row"], r["col"]): r["value"] for r in raster.fill_nearest(cells, frame).collect()}
    assert len(got) == 20 + 4 + 2
    assert all(v == 7.0 for (c, _, _), v in got.items() if c == "one")
    assert all(v is None for (c, _, _), v in got.items() if c == "none")
    assert got["full", 0, 1] == 2.0


def test_votes_of_voxels(spark):
    rows = [("A", i, 0.1 * i, 0.0, 0.0, lab) for i, lab in enumerate([0, 1])] + [("A", 10 + i, 5.1 + 0.1 * i, 0.0, 0.0, lab) for i, lab in enumerate([2, 2, 1])] + [("A", 20 + i, 10.1 + 0.1 * i, 0.0, 0.0, lab) for i, lab in enumerate([0, 0, 1, 1])]
    df = spark.createDataFrame(rows, POINTS + ", label int")
    counted = {r["vx"]: r["label"] for r in voxel.voxel_downsample(df, 5.0).collect()}
    excluded = {r["vx"]: r["label"] for r in voxel.voxel_majority(df, 5.0).collect()}
    assert counted == {0: 0, 1: 2, 2: 0}
    assert excluded == {0: 0, 1: 1, 2: 0}


def test_curves(spark):
    cube = spark.range(64).select((F.col("id") % 4).alias("x"), (F.floor(F.col("id") / 4) % 4).alias("y"), F.floor(F.col("id") / 16).alias("z"))
    got = cube.select("*", project.hilbert_encode(F.col("x"), F.col("y"), F.col("z"), 2).alias("h"), project.morton_encode(F.col("x"), F.col("y"), F.col("z"), 4).alias("m")).collect()
    path = sorted(got, key=lambda r: r["h"])
    assert [r["h"] for r in path] == list(range(64))
    assert all(sum(abs(a[c] - b[c]) for c in "xyz") == 1 for a, b in zip(path, path[1:]))
    assert sorted(r["m"] for r in got) == list(range(64))


def test_names(spark):
    df = spark.createDataFrame([("NZ24_North",), ("canterbury_2016-2018",), ("canterbury_2021",), ("no year",)], "survey string")
    got = {r["survey"]: (r["start_year"], r["area"]) for r in catalog.parse_survey_name(df).collect()}
    assert got == {"NZ24_North": (2024, "north"), "canterbury_2016-2018": (2016, "canterbury"), "canterbury_2021": (2021, "canterbury"), "no year": (None, "no_year")}
    tile = catalog.parse_grid_tile(spark.createDataFrame([("PNOA_2015_GAL-W_474-4750_ORT.copc.laz",), ("PNOA_2015_474-4750_ORT.laz",), ("x",)], "tile string")).collect()
    assert [(r["tile_year"], r["region"], r["east"], r["north"]) for r in tile] == [(2015, "gal_w", 474, 4750), (2015, "es", 474, 4750), (None, None, None, None)]


def test_grid_components(spark):
    tiles = spark.createDataFrame([("r", 0, 0), ("r", 10, 0), ("r", 20, 10), ("r", 90, 90)] + [("s", i, 0) for i in range(30)], "region string, e long, n long")
    got = {(r["region"], r["e"], r["n"]): r["component"] for r in catalog.grid_components(tiles).collect()}
    assert got["r", 0, 0] == got["r", 10, 0] != got["r", 20, 10] != got["r", 90, 90]
    assert len({v for (r, _, _), v in got.items() if r == "s"}) == 1


def test_budgets(spark):
    rows = [("a", 1, i + 1, f"a{i}", 10) for i in range(4)] + [("b", 1, i + 1, f"b{i}", 30 if i == 1 else 5) for i in range(4)]
    df = spark.createDataFrame(rows, "area string, pair_rank int, position int, tile string, size long")
    got = [r["tile"] for r in catalog.plan_round_robin(df, 45, 2).orderBy("pick").collect()]
    assert got == ["a0", "a1", "b0", "a2", "a3"][: len(got)]
    assert "b1" not in got
    fit = catalog.plan_first_fit(df, 45).agg(F.sum("size")).first()[0]
    assert 30 < fit <= 45


def test_metrics_guards(spark):
    for counts in ((0, 5, 5, 5), (5, 0, 5, 5), (5, 5, 0, 5), (5, 5, 5, 0), (0, 0, 0, 0)):
        row = metrics.segmentation_metrics(spark.createDataFrame([counts], "tp1 long, tp2 long, fp1 long, fp2 long")).first()
        assert all(v is None or math.isfinite(v) for v in row)


def test_batches(spark):
    df = spark.createDataFrame([("s", i, n) for i, n in enumerate([5, 5, 20, 1, 9, 1])], "shard string, item int, n long")
    assert [r["batch"] for r in sample.pack_batches(df, 10).orderBy("item").collect()] == [0, 0, 1, 2, 2, 3]


def test_discs_vote_everywhere(spark):
    rng = np.random.default_rng(4)
    df = points(spark, np.c_[rng.uniform(0, 60, (3000, 2)), rng.uniform(0, 3, 3000)])
    jobs = score.disc_jobs(df, 15.0, 4.0, 400, trim=False)
    scored = score.score(df, lambda g: 1 / (1 + g["z"]))
    votes = jobs.join(scored.select("cloud", "pid", "p_ground", "p_other"), ["cloud", "pid"])
    voted = score.soft_vote(votes)
    full = score.coverage_backstop(df, voted.filter("pid % 3 > 0"))
    assert full.count() == 3000
    assert voted.filter(F.abs(F.col("p_ground") + F.col("p_other") - 1) > 1e-9).count() == 0


def test_four_turns_are_none(spark):
    df = points(spark, np.random.default_rng(5).uniform(0, 9, (50, 3)))
    out = raster.rotate90_points(raster.rotate90_points(df, 3.0, 4.0, 3), 3.0, 4.0, 1)
    assert out.join(df.select("pid", F.col("x").alias("x0"), F.col("y").alias("y0")), "pid").filter("abs(x - x0) + abs(y - y0) > 1e-9").count() == 0


@pytest.mark.parametrize("parts", [1, 4, 17])
def test_results_do_not_depend_on_partitions(spark, parts):
    df = points(spark, np.random.default_rng(6).uniform(0, 9, (300, 3))).repartition(parts)
    got = sorted((r["vx"], r["vy"], r["vz"], round(r["x"], 9), r["n_points"]) for r in voxel.voxel_downsample(df, 2.0, label=None).collect())
    split = sorted(map(tuple, catalog.hash_split(df.select(F.col("pid").cast("string").alias("cloud")), 3, 0.1, 0.2).collect()))
    if not hasattr(test_results_do_not_depend_on_partitions, "first"):
        test_results_do_not_depend_on_partitions.first = (got, split)
    assert test_results_do_not_depend_on_partitions.first == (got, split)


def las_file(n=5, version=2, form=1):
    head = bytearray(227 if version < 4 else 375)
    head[:4] = b"LASF"
    length = 28 if form == 1 else 30
    struct.pack_into("<B", head, 24, 1)
    struct.pack_into("<B", head, 25, version)
    struct.pack_into("<I", head, 96, len(head))
    struct.pack_into("<BH", head, 104, form, length)
    struct.pack_into("<I", head, 107, n if version < 4 else 0)
    struct.pack_into("<6d", head, 131, 0.01, 0.01, 0.01, 100.0, 200.0, 0.0)
    struct.pack_into("<6d", head, 179, 110.0, 100.0, 205.0, 200.0, 5.0, 0.0)
    if version >= 4:
        struct.pack_into("<Q", head, 247, n)
    body = b""
    for i in range(n):
        p = bytearray(length)
        struct.pack_into("<3iH", p, 0, 100 * i, 50 * i, 10 * i, 7 * i)
        if form == 1:
            p[14], p[15] = 1 | 2 << 3, 7 if i == 4 else 2
        else:
            p[14], p[16] = 1 | 2 << 4, 2
            p[15] = 4 if i == 0 else 0
        body += bytes(p)
    return bytes(head) + body


def test_las(spark, tmp_path):
    (tmp_path / "a.las").write_bytes(las_file())
    (tmp_path / "b.LAS").write_bytes(las_file(3, 4, 6))
    (tmp_path / "c.las").write_bytes(b"no such thing" * 40)
    heads = {r["path"].rsplit("/", 1)[-1]: r for r in files.las_headers(spark, str(tmp_path)).collect()}
    assert set(heads) == {"a.las", "b.LAS"}
    assert (heads["a.las"]["n_points"], heads["b.LAS"]["n_points"]) == (5, 3)
    assert heads["a.las"]["density"] == 5 / 50
    assert [r["key"].rsplit("/", 1)[-1] for r in files.list_clouds(spark, str(tmp_path)).collect()] == ["a.las", "b.LAS", "c.las"]
    got = files.read_points(spark, str(tmp_path / "a.las")).orderBy("pid").collect()
    assert [(r["x"], r["y"], r["cls"], r["nret"], r["rnum"], r["intensity"]) for r in got][:2] == [(100.0, 200.0, 2, 2, 1, 0.0), (101.0, 200.5, 2, 2, 1, 7.0)]
    assert len(got) == 4
    assert files.read_points(spark, str(tmp_path / "b.LAS")).count() == 2


def test_ascii_grid(spark, tmp_path):
    (tmp_path / "g.asc").write_text("ncols 3\nnrows 2\nxllcorner 10\nyllcorner 20\ncellsize 2\nNODATA_value -9999\n1 2 3\n4 -9999 6\n")
    cells, frames = files.read_ascii_grid(spark, str(tmp_path / "g.asc"))
    got = {(r["row"], r["col"]): r["value"] for r in cells.collect()}
    assert got == {(1, 0): 1.0, (1, 1): 2.0, (1, 2): 3.0, (0, 0): 4.0, (0, 1): None, (0, 2): 6.0}
    assert tuple(frames.first()) == ("g", 10.0, 20.0, 2.0, 2, 3)


def test_stream_of_tiles(spark, tmp_path):
    from terraframe.streaming.ingest import tile_stream

    schema = POINTS + ", cls int, intensity double"
    rng = np.random.default_rng(7)
    df = points(spark, rng.uniform(0, 9, (200, 3))).withColumns({"cls": F.lit(2), "intensity": F.lit(1.0)})
    for k, cloud in enumerate("AB"):
        df.withColumn("cloud", F.lit(cloud)).write.mode("append").parquet(str(tmp_path / "in"))
        tile_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), 2.0, str(tmp_path / "ck")).awaitTermination()
        assert files.read_tiles(spark, str(tmp_path / "out")).select("cloud").distinct().count() == k + 1


def test_farthest_points(spark):
    df = points(spark, [(0, 0, 0), (1, 0, 0), (10, 0, 0), (5, 0, 0)])
    assert [r["pid"] for r in spatial.farthest_point(df, 3).orderBy("pick").collect()] == [0, 2, 3]


def test_thin_plate_plane():
    rng = np.random.default_rng(8)
    xy, at = rng.uniform(0, 10, (20, 2)), rng.uniform(0, 10, (5, 2))
    plane = lambda p: 2 * p[:, 0] - p[:, 1] + 3
    assert np.allclose(correct.thin_plate(xy, plane(xy), at), plane(at), atol=1e-6)


def test_thin_plates_together():
    """Splines solved together are those solved alone, one on a line of seeds included."""
    rng = np.random.default_rng(18)
    xy, z = rng.uniform(0, 10, (4, 12, 2)), rng.uniform(0, 3, (4, 12))
    at, cell = rng.uniform(0, 10, (40, 2)), rng.integers(0, 4, 40)
    xy[2] = np.c_[np.arange(12.0), np.arange(12.0)]
    alone = np.array([correct.thin_plate(xy[c], z[c], q[None])[0] for c, q in zip(cell, at)])
    assert np.isfinite(alone).all() and np.allclose(correct.thin_plates(xy, z, cell, at), alone, atol=1e-9)
    assert len(correct.thin_plates(xy, z, cell[:0], at[:0])) == 0


def test_triangulation():
    from terraframe.functions.tin import delaunay, interpolate

    rng = np.random.default_rng(9)
    xy = rng.uniform(0, 10, (120, 2))
    tri = delaunay(xy)
    area = np.abs((xy[tri[:, 1], 0] - xy[tri[:, 0], 0]) * (xy[tri[:, 2], 1] - xy[tri[:, 0], 1]) - (xy[tri[:, 1], 1] - xy[tri[:, 0], 1]) * (xy[tri[:, 2], 0] - xy[tri[:, 0], 0])).sum() / 2
    hull = sum_hull(xy)
    assert abs(area - hull) < 0.02 * hull
    at = rng.uniform(3, 7, (40, 2))
    assert np.allclose(interpolate(xy, 3 * xy[:, 0] - xy[:, 1], at), 3 * at[:, 0] - at[:, 1])
    assert np.isnan(interpolate(xy, xy[:, 0], np.array([[50.0, 50.0]]))).all()


def sum_hull(xy):
    pts = sorted(map(tuple, xy))

    def half(points):
        out = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(pts) + half(pts[::-1])
    return abs(sum(a[0] * b[1] - a[1] * b[0] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def test_surfaces_agree_on_a_plane(spark):
    xyz = slope(30, 30.0)
    xyz[:, 2] = 0.4 * xyz[:, 0]
    df = points(spark, xyz).withColumns({"label": F.lit(1), "pred": F.when(F.col("pid") % 3 > 0, 1).otherwise(0)})
    worst = metrics.dtm_errors(df, 1.0, surface="tin").agg(F.max(F.abs("error")), F.count("*")).first()
    assert worst[0] < 1e-9
    assert worst[1] > 500
