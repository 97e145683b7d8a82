"""Queries of the sources and sinks: written, read back, and compared with the table they came from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from terraframe.plans.projection import PL, PO
from terraframe.plans.registry import query
from terraframe.sources import files as f
from terraframe.sources.views import SCORED, points_l, points_o, scored

SC = f"({SCORED}) AS sc"


def place(spark, label: str) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@query("s1_read_points", f"SELECT cloud, nret, count(*) AS n, round(sum(intensity), 2) AS intensity FROM (SELECT cloud, CASE WHEN nret = 3 THEN 1 ELSE nret END AS nret, CASE WHEN rnum = 2 THEN 0 ELSE intensity END AS intensity, CASE WHEN cls = 5 AND nret > 4 THEN 7 ELSE cls END AS cls FROM {PL}) AS p WHERE cls <> 7 GROUP BY cloud, nret")
def s1(spark, sf):
    path = place(spark, "points")
    rows = points_l(spark, sf).withColumns({"cls": F.when((F.col("cls") == 5) & (F.col("nret") > 4), 7).otherwise(F.col("cls")), "nret": F.when(F.col("nret") != 3, F.col("nret")), "intensity": F.when(F.col("rnum") != 2, F.col("intensity"))})
    rows.write.parquet(path)
    return f.read_points(spark, path).groupBy("cloud", "nret").agg(F.count("*").alias("n"), F.round(F.sum("intensity"), 2).alias("intensity"))


@query("s4_classified", f"SELECT pid, cloud, pred, label, CAST(floor(least(greatest(i * CASE WHEN top > 65535 THEN 65535 / top ELSE 1 END, 0), 65535)) AS INTEGER) AS intensity FROM (SELECT *, max(i) OVER (PARTITION BY cloud) AS top FROM (SELECT *, CAST(pid % 200000 AS DOUBLE) AS i FROM {SC}) AS a) AS s")
def s4(spark, sf):
    path = place(spark, "classified")
    f.write_classified(scored(spark, sf).withColumn("intensity", (F.col("pid") % 200000).cast("double")), path)
    return f.read_classified(spark, path).select("pid", "cloud", "pred", "label", "intensity")


@query("s5_tiles", f"SELECT cloud, count(*) AS n, round(avg(CASE WHEN survey_year = 1995 THEN 1 ELSE rnum / greatest(nret, 1) END), 9) AS ret_ratio, round(sum(CASE WHEN survey_year = 1995 THEN 0 ELSE intensity END), 2) AS intensity FROM {PL} GROUP BY cloud")
def s5(spark, sf):
    path = place(spark, "tiles")
    rows = points_l(spark, sf)
    f.write_tiles(rows.filter("survey_year <> 1995"), path)
    f.write_tiles(rows.filter("survey_year = 1995").drop("intensity", "nret", "rnum"), path)
    return f.read_tiles(spark, path).groupBy("cloud").agg(F.count("*").alias("n"), F.round(F.avg("ret_ratio"), 9).alias("ret_ratio"), F.round(F.sum("intensity"), 2).alias("intensity"))


@query("s9_history", f"SELECT CAST(right(cloud, 4) AS BIGINT) AS epoch, round(avg(p_ground), 6) AS miou FROM {SC} GROUP BY cloud")
def s9(spark, sf):
    path = place(spark, "history")
    rows = scored(spark, sf).groupBy("cloud").agg(F.round(F.avg("p_ground"), 6).alias("miou")).select(F.substring("cloud", -4, 4).cast("long").alias("epoch"), "miou")
    f.append_history(rows.filter("epoch % 2 = 0"), path)
    f.append_history(rows.filter("epoch % 2 = 1"), path)
    return f.latest_history(spark, path).select("epoch", "miou")


GRID_CELLS = "SELECT CAST(floor(y / 6) AS BIGINT) AS row, CAST(floor(x / 6) AS BIGINT) AS col, round(avg(z), 3) AS value FROM {src} WHERE cls <> 5 GROUP BY ALL"


@query("s6_read_ascii_grid", f"WITH c AS ({GRID_CELLS.format(src=PL)}) SELECT CAST(r AS BIGINT) AS row, CAST(k AS BIGINT) AS col, value FROM range(10) AS a(r) CROSS JOIN range(10) AS b(k) LEFT JOIN c ON c.row = r AND c.col = k")
def s6(spark, sf):
    """The mean heights of a grid of 10 x 10 cells, written as the lines of an ASCII grid, northernmost first, and read back."""
    path = place(spark, "grid")
    cells = points_l(spark, sf).filter("cls <> 5").groupBy(F.floor(F.col("y") / 6).alias("row"), F.floor(F.col("x") / 6).alias("col")).agg(F.round(F.avg("z"), 3).alias("value"))
    every = spark.range(100).select((F.col("id") / 10).cast("long").alias("row"), (F.col("id") % 10).alias("col"))
    full = every.join(cells.hint("shuffle_merge"), ["row", "col"], "left").withColumn("value", F.coalesce(F.col("value").cast("string"), F.lit("-9999")))
    lines = full.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("col", "value"))).alias("v")).select((10 - F.col("row")).alias("at"), F.array_join("v.value", " ").alias("line"))
    head = spark.range(1).select(F.lit(0).cast("long").alias("at"), F.lit("ncols 10\nnrows 10\nxllcorner 0\nyllcorner 0\ncellsize 6\nNODATA_value -9999").alias("line"))
    head.unionByName(lines).coalesce(1).sortWithinPartitions("at").select("line").write.text(path)
    return f.read_ascii_grid(spark, path)[0].select("row", "col", "value")


#: Each cloud in two files, by odd and even points, with noise and withheld points among them.
LAS = f"(SELECT concat(cloud, '_', CAST(pid % 2 AS INTEGER)) AS cloud, pid, x, y, z, CASE WHEN pid % 13 = 0 THEN 7 ELSE cls END AS cls, CAST(1 + pid % 5 AS INTEGER) AS nret, CAST(1 + pid % 3 AS INTEGER) AS rnum, CAST(pid % 60000 AS DOUBLE) AS intensity, pid % 17 = 0 AS withheld FROM {PO}) AS las"


def las_folder(spark, sf) -> str:
    path = place(spark, "las")
    made = {"cloud": F.concat_ws("_", "cloud", (F.col("pid") % 2).cast("int").cast("string")), "cls": F.when(F.col("pid") % 13 == 0, 7).otherwise(F.col("cls")), "nret": (1 + F.col("pid") % 5).cast("int"), "rnum": (1 + F.col("pid") % 3).cast("int"), "intensity": (F.col("pid") % 60000).cast("double"), "withheld": F.col("pid") % 17 == 0}
    f.write_las(points_o(spark, sf).withColumns(made), path)
    return path


@query("s1_read_las", f"SELECT cloud, nret, count(*) AS n, round(sum(x), 4) AS x, round(sum(y), 4) AS y, round(sum(z), 4) AS z, round(sum(intensity), 1) AS intensity, CAST(sum(rnum) AS BIGINT) AS rnum, count(*) FILTER (cls = 2) AS ground FROM {LAS} WHERE cls <> 7 AND NOT withheld GROUP BY cloud, nret")
def s1_las(spark, sf):
    """Points of LAS files in ranges of 64 kB, which cut every file."""
    rows = f.read_points(spark, las_folder(spark, sf), las=True, split=1 << 16)
    return rows.groupBy("cloud", "nret").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 4).alias(c) for c in "xyz"], F.round(F.sum("intensity"), 1).alias("intensity"), F.sum("rnum").alias("rnum"), F.count_if(F.col("cls") == 2).alias("ground"))


@query("s1_read_las_window", f"SELECT cloud, count(*) AS n, round(sum(z), 4) AS z FROM {LAS} WHERE cls <> 7 AND NOT withheld AND x >= 20 AND x < 40 AND y < 30 GROUP BY cloud")
def s1_window(spark, sf):
    """Points in a window, whose bounds are also held against the box of each file."""
    rows = f.read_points(spark, las_folder(spark, sf), las=True).filter("x >= 20 AND x < 40 AND y < 30")
    return rows.groupBy("cloud").agg(F.count("*").alias("n"), F.round(F.sum("z"), 4).alias("z"))


@query("s2_las_headers", f"SELECT concat(cloud, '.las') AS file, 4 AS minor, n_points, round(min_x, 6) AS min_x, round(max_x, 6) AS max_x, round(min_y, 6) AS min_y, round(max_y, 6) AS max_y, CASE WHEN max_x > min_x AND max_y > min_y THEN round(n_points / ((max_x - min_x) * (max_y - min_y)), 6) END AS density FROM (SELECT cloud, count(*) AS n_points, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM {LAS} GROUP BY cloud) AS h")
def s2(spark, sf):
    out = f.las_headers(spark, las_folder(spark, sf))
    return out.select(F.substring_index("path", "/", -1).alias("file"), "minor", "n_points", *[F.round(c, 6).alias(c) for c in ("min_x", "max_x", "min_y", "max_y", "density")])


@query("s3_list_clouds", f"SELECT concat(cloud, '.las') AS file, 375 + 30 * count(*) AS size FROM {LAS} GROUP BY cloud")
def s3(spark, sf):
    return f.list_clouds(spark, las_folder(spark, sf)).select(F.substring_index("key", "/", -1).alias("file"), "size")
