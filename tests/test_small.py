"""Small cases of helpers, sinks and functions that no registered query runs."""

import json
import random

import pytest
from pyspark.sql import functions as F

from terraframe.functions.tables import running
from terraframe.operators import catalog, project, sample, voxel
from terraframe.sources import files


@pytest.mark.parametrize("by", [("g",), ()])
def test_running_sums(spark, by):
    rng = random.Random(1)
    rows = [("a" if rng.random() < 0.8 else "b", i, rng.randint(0, 9)) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(7)
    got = {r["i"]: (r["s"], r["k"], r["s_all"]) for r in running(df, by, [F.desc("i")], "t", s=F.col("v"), k=F.lit(1)).collect()}
    for g in ("a", "b") if by else (None,):
        mine = sorted((r for r in rows if g in (None, r[0])), key=lambda r: -r[1])
        total = 0
        for place, (_, i, v) in enumerate(mine):
            assert got[i] == (total, place, sum(r[2] for r in mine))
            total += v
    assert running(df.limit(0), by, ["i"], "t", s=F.col("v")).count() == 0


def test_hilbert_there_and_back(spark):
    # fixed values: the order of the corners of a cube, x the highest bit
    first = [(0, 0, 0), (0, 0, 1), (0, 1, 1), (0, 1, 0), (1, 1, 0), (1, 1, 1), (1, 0, 1), (1, 0, 0)]
    one = spark.range(8).select("id", project.hilbert_decode(F.col("id"), 1).alias("p")).select("id", "p.*").collect()
    assert [(r["x"], r["y"], r["z"]) for r in sorted(one, key=lambda r: r["id"])] == first
    for bits in (2, 5, 21):
        rng = random.Random(bits)
        pts = spark.createDataFrame([tuple(rng.randrange(1 << bits) for _ in range(3)) for _ in range(200)], "x long, y long, z long")
        back = pts.select("x", "y", "z", project.hilbert_decode(project.hilbert_encode(F.col("x"), F.col("y"), F.col("z"), bits), bits).alias("p"))
        assert back.filter("x <> p.x OR y <> p.y OR z <> p.z").isEmpty()


def test_morton_there_and_back(spark):
    pts = spark.range(500).select((F.col("id") * 7919 % 65536).alias("x"), (F.col("id") * 104729 % 65536).alias("y"), (F.col("id") * 31 % 65536).alias("z"))
    a, b, c = project.morton_decode(project.morton_encode(F.col("x"), F.col("y"), F.col("z")))
    assert pts.select("x", "y", "z", a.alias("a"), b.alias("b"), c.alias("c")).filter("x <> a OR y <> b OR z <> c").isEmpty()


def test_splits(spark):
    df = spark.createDataFrame([(f"c{i}", "stored") for i in range(300)], "cloud string, was string")
    assert {r["split"] for r in catalog.effective_split(df, "was", None, 0.2, 0.2).collect()} == {"stored"}
    one, two = (sorted((r["cloud"], r["split"]) for r in catalog.effective_split(df.repartition(n), "was", 5, 0.2, 0.2).collect()) for n in (1, 6))
    assert one == two
    share = {s: sum(x == s for _, x in one) / 300 for s in ("train", "val", "test")}
    assert abs(share["val"] - 0.2) < 0.08
    assert abs(share["test"] - 0.2) < 0.08


def test_sinks(spark, tmp_path):
    stats = spark.createDataFrame([([1.0], [2.0], 3)], "mean array<double>, std array<double>, n_points int")
    files.write_norm_stats(stats, str(tmp_path / "norm"))
    files.write_norm_stats(stats, str(tmp_path / "norm"))  # replaces what is there
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "norm")).collect()] == [{"mean": [1.0], "std": [2.0], "n_points": 3}]
    history = spark.createDataFrame([(2, 0.5, 0.6), (1, 0.4, 0.3)], "epoch int, raw double, refined double")
    files.write_refine_impact(history, str(tmp_path / "impact"))
    back = spark.read.option("header", "true").option("inferSchema", "true").csv(str(tmp_path / "impact"))
    assert sorted(map(tuple, back.collect())) == [(1, 0.4, 0.3), (2, 0.5, 0.6)]


def test_votes_in_a_stream(spark, tmp_path):
    from terraframe.streaming.ingest import vote_stream

    schema = "ts timestamp, cloud string, pid long, p_ground double"
    rows = [("2024-01-01 00:00:10", "A", 1, 0.25), ("2024-01-01 00:04:00", "A", 1, 0.5), ("2024-01-01 00:06:00", "A", 1, 1.0), ("2024-01-01 00:01:00", "B", 1, 0.0)]
    spark.createDataFrame(rows, "ts string, cloud string, pid long, p_ground double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    votes = vote_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    q = votes.writeStream.format("memory").queryName("running_votes").outputMode("complete").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted((r["cloud"], r["s_ground"], r["n_votes"]) for r in spark.table("running_votes").collect()) == [("A", 0.75, 2), ("A", 1.0, 1), ("B", 0.0, 1)]


def test_project_folders(spark):
    rows = [("p", "p/tiles", "las", 9), ("p", "p/LAS_2020", "las", 2), ("p", "p/other", "raster", 1), ("p", "p/DEM", "raster", 1), ("q", "q/a", "las", 1), ("q", "q/b", "las", 3)]
    got = {r["project"]: (r["las_dir"], r["dtm_dir"]) for r in catalog.project_dirs(spark.createDataFrame(rows, "project string, dir string, kind string, n int")).collect()}
    assert got == {"p": ("p/LAS_2020", "p/DEM"), "q": ("q/b", None)}


def test_scene_is_the_mean_of_its_discs(spark):
    df = spark.createDataFrame([("s", 1.0, 4.0), ("s", 3.0, 8.0), ("t", 5.0, 5.0)], "scene string, dz double, mean_p double")
    assert sorted(map(tuple, voxel.scene_stats(df, "scene").collect())) == [("s", 2.0, 6.0), ("t", 5.0, 5.0)]


def test_warp_turns_flips_and_scales(spark):
    patch = spark.createDataFrame([(1, r, c, float(10 * r + c), float(c)) for r in range(3) for c in range(3)], "patch_id int, row int, col int, dtm double, gprob double")
    at = lambda **p: spark.createDataFrame([(1, *[float(p.get(k, d)) for k, d in (("angle", 0), ("sx", 1), ("sy", 1), ("fx", 1), ("fy", 1), ("sz", 1))])], "patch_id int, angle double, sx double, sy double, fx double, fy double, sz double")
    of = lambda **p: {(r["row"], r["col"]): (round(r["dtm"], 6), round(r["gprob"], 6)) for r in sample.warp_patch(patch, 3, at(**p), ("dtm",), plain=("gprob",)).collect()}
    same = {(r, c): (10.0 * r + c, float(c)) for r in range(3) for c in range(3)}
    assert of() == same
    assert of(sz=2) == {k: (2 * a, b) for k, (a, b) in same.items()}
    assert of(fx=-1) == {(r, c): same[r, 2 - c] for r, c in same}
    assert of(fy=-1) == {(r, c): same[2 - r, c] for r, c in same}
    quarter = of(angle=1.5707963267948966)
    assert quarter == {(r, c): same[2 - c, r] for r, c in same}
    assert of(sx=2)[0, 0] == (0.5, 0.5)
