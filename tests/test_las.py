"""LAS files by ranges: every record once, only the bytes asked for, files beyond what one task could hold."""

import os

import pytest
from pyspark.sql import functions as F

from terraframe.sources import files, las
from tests.test_points import las_file


def folder(tmp_path, sizes=(5, 700, 3, 40)):
    for i, n in enumerate(sizes):
        os.makedirs(tmp_path / f"d{i % 2}", exist_ok=True)
        (tmp_path / f"d{i % 2}" / f"t{i}.las").write_bytes(las_file(n, 4, 6))
    (tmp_path / "d0" / "_hidden.las").write_bytes(las_file(9, 4, 6))
    return sum(sizes)


@pytest.mark.parametrize("split", [1, 29, 30, 31, 1000, 1 << 20])
def test_every_record_is_read_once(tmp_path, split):
    total = folder(tmp_path)
    reader = las.LasReader(str(tmp_path), False, split)
    parts = reader.partitions()
    seen = [(c, p) for part in parts for b in reader.read(part) for c, p in zip(b["cloud"].to_pylist(), b["pid"].to_pylist())]
    assert len(seen) == len(set(seen)) == total
    assert all(sum(hi - lo for _, lo, hi in p.parts) <= max(split, 1) for p in parts)
    if split == 1 << 20:
        assert len(parts) == 1


def test_headers_read_headers_only(spark, tmp_path):
    folder(tmp_path)
    big = tmp_path / "big.las"
    with open(big, "wb") as out:  # 6 GB of records that no disk holds
        out.write(las.header_bytes(200_000_000, [0.0, 0.0, 0.0], [100.0, 50.0, 9.0]))
        out.truncate(375 + 200_000_000 * las.LENGTH)
    reader = las.LasReader(str(tmp_path), True)
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 5
    assert reader.bytes_read == 5 * las.HEADER
    one = files.las_headers(spark, str(tmp_path)).filter("n_points = 200000000").first()
    assert (one["max_x"], one["density"]) == (100.0, 40_000.0)
    # a range of it is read without the rest
    points = las.LasReader(str(big), False)
    parts = points.partitions()
    assert len(parts) == -(-(375 + 200_000_000 * las.LENGTH) // las.SPLIT)
    batch = next(points.read(parts[20]))
    assert points.bytes_read <= las.HEADER + las.BATCH
    assert batch["pid"][0].as_py() == -(-(20 * las.SPLIT - 375) // las.LENGTH)


def test_bounds_pass_over_files(spark, tmp_path):
    rows = spark.range(4000).selectExpr("concat('t', CAST(id % 4 AS STRING)) AS cloud", "id AS pid", "(id % 4) * 100 + (id % 100) / 2.0D AS x", "id / 50.0D AS y", "1.5D AS z", "2 AS cls")
    files.write_las(rows, str(tmp_path / "w"))
    assert sorted(os.listdir(tmp_path / "w")) == ["t0.las", "t1.las", "t2.las", "t3.las"]
    got = files.read_points(spark, str(tmp_path / "w"), las=True)
    assert got.count() == 4000
    inside = got.filter((F.col("x") > 95) & (F.col("x") <= 220.0))
    assert inside.count() == rows.filter("x > 95 AND x <= 220").count()
    reader = las.LasReader(str(tmp_path / "w"), False)
    list(reader.pushFilters([las.GreaterThan(("x",), 95), las.LessThanOrEqual(("x",), 220.0), las.LessThan(("z",), 1.0)]))
    assert {c for p in reader.partitions() for b in reader.read(p) for c in b["cloud"].to_pylist()} == {"t1", "t2"}
    back = got.join(rows.select("pid", F.col("x").alias("x0"), "cloud").withColumnRenamed("pid", "p"), "cloud").filter("abs(x - x0) < 1e-6")
    assert back.select("cloud").distinct().count() == 4


def test_broken_files(spark, tmp_path):
    (tmp_path / "short.las").write_bytes(las_file(50, 4, 6)[:-40])
    with pytest.raises(Exception, match="ends before its last record"):
        files.read_points(spark, str(tmp_path), las=True).count()
    os.makedirs(tmp_path / "none")
    assert files.read_points(spark, str(tmp_path / "none"), las=True).count() == 0
    assert files.las_headers(spark, str(tmp_path / "none")).count() == 0
    rows = spark.createDataFrame([("a", 1, 0.0, 0.0, 0.0, 2)], "cloud string, pid long, x double, y double, z double, cls int")
    failing = rows.withColumn("z", F.raise_error(F.lit("stop")).cast("double"))
    with pytest.raises(Exception, match="stop"):
        files.write_las(failing, str(tmp_path / "failed"))
    assert not [n for n in os.listdir(tmp_path / "failed") if n.endswith(".las")] if (tmp_path / "failed").exists() else True
