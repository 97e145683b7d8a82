"""Queries of the raster operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraframe.operators import raster as ra
from terraframe.plans.aggregates import r
from terraframe.plans.projection import PO
from terraframe.plans.registry import query
from terraframe.sources.views import SCORED, points_o, scored

SC = f"({SCORED}) AS sc"
RES = 2
#: Sampled heights are exact decimals that may end in a five just where they are rounded; the same small step off such ties on both sides.
OFF = 3.14159e-8


def frame_sql(src: str = SC, res: int = RES) -> str:
    return f"f AS (SELECT cloud, min(x) AS x_min, min(y) AS y_min, CAST(greatest(ceil((max(y) - min(y)) / {res}), 1) AS BIGINT) AS h, CAST(greatest(ceil((max(x) - min(x)) / {res}), 1) AS BIGINT) AS w FROM {src} GROUP BY cloud)"


def cells_sql(res: int = RES) -> str:
    at = lambda c, lo, n: f"least(greatest(CAST(floor(({c} - {lo}) / {res}) AS BIGINT), 0), {n} - 1)"
    return f"p AS (SELECT s.*, {at('y', 'y_min', 'h')} AS row, {at('x', 'x_min', 'w')} AS col FROM {SC.replace(') AS sc', ') AS s')} JOIN f USING (cloud))"


BASE = f"{frame_sql()}, {cells_sql()}"
DENSE = "d AS (SELECT cloud, row, col FROM f, range(40) AS a(row), range(40) AS b(col) WHERE row < h AND col < w)"


def fill_sql(src: str, col: str) -> str:
    """Nearest fill by comparing every empty cell with every valued one."""
    return f"""(SELECT d.cloud, d.row, d.col, coalesce(k.{col}, n.{col}) AS {col} FROM d LEFT JOIN {src} AS k ON k.cloud = d.cloud AND k.row = d.row AND k.col = d.col
 LEFT JOIN (SELECT * FROM (SELECT e.cloud, e.row, e.col, v.{col}, row_number() OVER (PARTITION BY e.cloud, e.row, e.col ORDER BY (e.row - v.row) * (e.row - v.row) + (e.col - v.col) * (e.col - v.col), v.row, v.col) AS k FROM d AS e JOIN {src} AS v ON v.cloud = e.cloud AND v.{col} IS NOT NULL) AS t WHERE k = 1) AS n ON n.cloud = d.cloud AND n.row = d.row AND n.col = d.col)"""


@query("r1_build_dtm", f"WITH {BASE} SELECT cloud, row, col, round(avg(z), 6) AS value FROM p WHERE label = 1 GROUP BY cloud, row, col")
def r1(spark, sf):
    return ra.build_dtm(scored(spark, sf), 2.0, ground_only=True).select("cloud", "row", "col", *r(["value"]))


@query("r1_build_dtm_min", f"WITH {BASE} SELECT cloud, row, col, min(z) AS value FROM p GROUP BY cloud, row, col")
def r1b(spark, sf):
    return ra.build_dtm(scored(spark, sf), 2.0, "min")


GROUND = "g AS (SELECT cloud, row, col, avg(z) AS value FROM p WHERE label = 1 GROUP BY cloud, row, col)"


def sparse(spark, sf):
    rows = scored(spark, sf)
    frame = ra.frames(rows, 2.0)
    cells = ra.placed(rows, frame, 2.0).filter("label = 1").groupBy("cloud", "row", "col").agg(F.avg("z").alias("value"))
    return rows, frame, cells


@query("r2_fill_nearest", f"WITH {BASE}, {DENSE}, {GROUND} SELECT cloud, row, col, round(value, 6) AS value FROM {fill_sql('g', 'value')} AS q")
def r2(spark, sf):
    _, frame, cells = sparse(spark, sf)
    return ra.fill_nearest(cells, frame).select("cloud", "row", "col", *r(["value"]))


PRIOR = "c AS (SELECT cloud, row, col, avg(z) FILTER (label = 1) AS dtm, max(z) AS dsm, count(*) FILTER (label = 1) / count(*) AS gprob FROM p GROUP BY cloud, row, col)"


@query("r3_build_prior", f"WITH {BASE}, {DENSE}, {PRIOR} SELECT a.cloud, a.row, a.col, round(a.dtm, 6) AS dtm, b.dsm, round(greatest(b.dsm - a.dtm, 0), 6) AS ndsm, round(coalesce(c.gprob, 0), 9) AS gprob, CAST(CASE WHEN c.gprob IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS cover FROM {fill_sql('c', 'dtm')} AS a JOIN {fill_sql('c', 'dsm')} AS b USING (cloud, row, col) LEFT JOIN c ON c.cloud = a.cloud AND c.row = a.row AND c.col = a.col")
def r3(spark, sf):
    return ra.build_prior(scored(spark, sf), 2.0).select("cloud", "row", "col", *r(["dtm"]), "dsm", *r(["ndsm"]), F.round("gprob", 9).alias("gprob"), "cover")


@query("r4_prior_from_grid", f"WITH {BASE}, {DENSE}, {GROUND}, v AS (SELECT * FROM g WHERE (row + col) % 5 > 0) SELECT q.cloud, q.row, q.col, round(coalesce(q.value, 0), 6) AS dtm, CAST(CASE WHEN v.row IS NULL THEN 0 ELSE 1 END AS DOUBLE) AS cover FROM {fill_sql('v', 'value')} AS q LEFT JOIN v ON v.cloud = q.cloud AND v.row = q.row AND v.col = q.col")
def r4(spark, sf):
    _, frame, cells = sparse(spark, sf)
    marked = cells.withColumn("value", F.when((F.col("row") + F.col("col")) % 5 == 0, -9999.0).otherwise(F.col("value")))
    return ra.prior_from_grid(marked, frame, -9999.0).select("cloud", "row", "col", *r(["dtm"]), "cover")


@query("r5_promote_prior", f"WITH {BASE}, {GROUND} SELECT cloud, row, col, round(value, 6) AS dtm, round(value, 6) AS dsm, CAST(0 AS DOUBLE) AS ndsm, CAST(1 AS DOUBLE) AS gprob, CAST(1 AS DOUBLE) AS cover FROM g")
def r5(spark, sf):
    return ra.promote_prior(sparse(spark, sf)[2]).select("cloud", "row", "col", *r(["dtm", "dsm"]), "ndsm", "gprob", "cover")


def sample_sql(cells: str, col: str, points: str = SC, res: str = str(RES)) -> str:
    """cloud, pid and the bilinear sample v of one band."""
    return f"""(WITH a AS (SELECT cloud, pid, h, w, least(greatest((x - x_min) / {res}, 0), w - 1) AS fx, least(greatest((y - y_min) / {res}, 0), h - 1) AS fy FROM {points} JOIN f USING (cloud)),
 k AS (SELECT cloud, pid, least(CAST(floor(fy) AS BIGINT) + dr, h - 1) AS row, least(CAST(floor(fx) AS BIGINT) + dc, w - 1) AS col, (CASE dr WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE dc WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) AS weight FROM a, range(2) AS i(dr), range(2) AS j(dc)),
 m AS (SELECT k.*, c.{col} AS v, coalesce(avg(c.{col}) OVER (PARTITION BY k.cloud), 0) AS mean FROM k LEFT JOIN {cells} AS c ON c.cloud = k.cloud AND c.row = k.row AND c.col = k.col)
 SELECT cloud, pid, sum(weight * coalesce(v, mean)) AS v FROM m GROUP BY cloud, pid)"""


@query("r6_sample_bilinear", f"WITH {BASE}, {GROUND} SELECT pid, round(v + {OFF}, 6) AS value FROM {sample_sql('g', 'value')} AS q")
def r6(spark, sf):
    rows, frame, cells = sparse(spark, sf)
    return ra.sample_bilinear(rows, cells, frame, 2.0).select("pid", F.round(F.col("value") + OFF, 6).alias("value"))


COVER = "v AS (SELECT DISTINCT cloud, row, col FROM g)"
MASK = f"mk AS (SELECT s.pid, s.cloud, (x - x_min) / 2 BETWEEN 0 AND w - 1 AND (y - y_min) / 2 BETWEEN 0 AND h - 1 AND v.row IS NOT NULL AS covered FROM {SC.replace(') AS sc', ') AS s')} JOIN f USING (cloud) LEFT JOIN v ON v.cloud = s.cloud AND v.row = CAST(round_even((y - y_min) / 2, 0) AS BIGINT) AND v.col = CAST(round_even((x - x_min) / 2, 0) AS BIGINT))"


@query("r8_coverage_mask", f"WITH {BASE}, {GROUND}, {COVER}, {MASK} SELECT pid, covered FROM mk")
def r8(spark, sf):
    rows, frame, cells = sparse(spark, sf)
    return ra.coverage_mask(rows, cells.withColumn("cover", F.lit(1.0)), frame, 2.0).select("pid", "covered")


@query("r7_height_above", f"WITH {BASE}, {GROUND}, {COVER}, {MASK}, s AS (SELECT pid, v AS dtm FROM {sample_sql('g', 'value')} AS q) SELECT sc.pid, round(CASE WHEN covered THEN z - dtm ELSE 0 END + {OFF}, 6) AS height_above FROM {SC} JOIN mk USING (pid) JOIN s USING (pid)")
def r7(spark, sf):
    rows, frame, cells = sparse(spark, sf)
    return ra.height_above(rows, ra.promote_prior(cells), frame, 2.0).select("pid", F.round(F.col("height_above") + OFF, 6).alias("height_above"))


#: Lowest heights are exact decimals, so a mean of nine has no tie at the last digit, whatever the order of the sum.
LOWEST = "g AS (SELECT cloud, row, col, min(z) AS value FROM p WHERE label = 1 GROUP BY cloud, row, col)"


@query("r9_crop_downsample", f"""WITH {BASE}, {LOWEST},
 s AS (SELECT cloud, greatest(floor((8.5 - y_min) / 2), 0) AS r0, least(ceil((41.5 - y_min) / 2) + 1, h) AS r1, greatest(floor((10.5 - x_min) / 2), 0) AS c0, least(ceil((45.5 - x_min) / 2) + 1, w) AS c1 FROM f),
 k AS (SELECT *, CASE WHEN r1 - r0 < 3 OR c1 - c0 < 3 THEN 1 ELSE 3 END AS k FROM s),
 b AS (SELECT g.cloud, CAST(floor((g.row - r0) / k) AS BIGINT) AS row, CAST(floor((g.col - c0) / k) AS BIGINT) AS col, value, k, r1 - r0 AS hh, c1 - c0 AS ww FROM g JOIN k USING (cloud) WHERE g.row >= r0 AND g.col >= c0)
 SELECT cloud, row, col, round(avg(value), 6) AS value FROM b WHERE (row + 1) * k <= hh AND (col + 1) * k <= ww GROUP BY cloud, row, col
 UNION ALL SELECT cloud, 0, 0, NULL FROM s WHERE r1 <= r0 OR c1 <= c0""")
def r9(spark, sf):
    rows = scored(spark, sf)
    lowest = ra.build_dtm(rows, 2.0, "min", ground_only=True)
    return ra.crop_downsample(lowest, ra.frames(rows, 2.0), (10.5, 8.5, 45.5, 41.5), 2.0, 6.0).select("cloud", "row", "col", *r(["value"]))


PATCH = "pt AS (SELECT cloud, row_number() OVER (ORDER BY cloud) - 1 AS patch_id FROM f), nd AS (SELECT cloud, patch_id, py, px, (patch_id * 6 + py) * 6 + px AS pid, 10 + CAST(20 AS DOUBLE) * px / 5 AS x, 12 + CAST(20 AS DOUBLE) * py / 5 AS y FROM pt, range(6) AS a(py), range(6) AS b(px))"


@query("r10_resample_patch", f"WITH {BASE}, {GROUND}, {PATCH} SELECT nd.cloud, CAST(patch_id AS BIGINT) AS patch_id, CAST(py AS INTEGER) AS py, CAST(px AS INTEGER) AS px, round(v - 1 + {OFF}, 6) AS dtm, CAST(0 AS DOUBLE) AS ndsm FROM nd JOIN {sample_sql('g', 'value', 'nd')} AS q ON q.cloud = nd.cloud AND q.pid = nd.pid")
def r10(spark, sf):
    _, frame, cells = sparse(spark, sf)
    patches = frame.select("cloud", (F.row_number().over(ra.Window.orderBy("cloud")) - 1).cast("long").alias("patch_id")).withColumns({"x0": F.lit(10.0), "y0": F.lit(12.0), "side": F.lit(20.0), "z0": F.lit(1.0)})
    return ra.resample_patch(ra.promote_prior(cells), frame, 2.0, patches, 6).select("cloud", "patch_id", "py", "px", F.round(F.col("dtm") + OFF, 6).alias("dtm"), "ndsm")


@query("r11_mosaic", f"""WITH {BASE}, {GROUND}, o AS (SELECT cloud, 10.0 * (row_number() OVER (ORDER BY cloud) - 1) AS x_min, CAST(0 AS DOUBLE) AS y_min, row_number() OVER (ORDER BY cloud) AS ordinal FROM (SELECT DISTINCT cloud FROM g) AS d)
 SELECT row, col + CAST(x_min / 2 AS BIGINT) AS col, round(arg_min(value, ordinal), 6) AS value FROM g JOIN o USING (cloud) GROUP BY 1, 2""")
def r11(spark, sf):
    _, _, cells = sparse(spark, sf)
    order = F.row_number().over(ra.Window.orderBy("raster_id"))
    named = cells.withColumnRenamed("cloud", "raster_id")
    origins = named.select("raster_id").distinct().select("raster_id", (10.0 * (order - 1)).alias("x_min"), F.lit(0.0).alias("y_min"), order.alias("ordinal"))
    return ra.mosaic(named, origins, 2.0).select("row", "col", *r(["value"]))


@query("r12_merge_tiles", f"WITH o AS (SELECT *, CAST(right(cloud, 1) AS INTEGER) * 50 AS ox FROM {PO}) SELECT pid, round(x + ox - min(x + ox) OVER (), 6) AS x, round(y - min(y) OVER (), 6) AS y, z, CASE WHEN cloud < 'CL_1996' THEN intensity END AS intensity FROM o")
def r12(spark, sf):
    """All clouds in one scene, the later ones from tiles without an intensity."""
    rows = points_o(spark, sf).withColumns({"origin_x": F.substring("cloud", -1, 1).cast("int") * 50, "origin_y": F.lit(0), "origin_z": F.lit(0)})
    return ra.merge_tiles([rows.filter("cloud < 'CL_1996'"), rows.filter("cloud >= 'CL_1996'").drop("intensity")]).select("pid", *r("xy"), "z", "intensity")


@query("r13_ndsm_target", f"WITH {BASE}, {DENSE}, gr AS (SELECT cloud, row, col, avg(z) AS value FROM p WHERE label = 1 GROUP BY cloud, row, col), fl AS (SELECT * FROM {fill_sql('gr', 'value')} AS q), s AS (SELECT pid, v FROM {sample_sql('fl', 'value')} AS q) SELECT pid, round(CASE WHEN label < 2 THEN z - v END + {OFF}, 6) AS ndsm FROM {SC} JOIN s USING (pid)")
def r13(spark, sf):
    return ra.ndsm_target(scored(spark, sf), 2.0).select("pid", F.round(F.col("ndsm") + OFF, 6).alias("ndsm"))


@query("r14_rotate90", f"SELECT pid, 30 - (y - 30) AS x, 30 + (x - 30) AS y FROM {PO}")
def r14(spark, sf):
    return ra.rotate90_points(points_o(spark, sf), 30.0, 30.0, 1).select("pid", "x", "y")


@query("r14_rotate90_cells", f"WITH {BASE}, {GROUND} SELECT g.cloud, g.col AS row, f.h - 1 - g.row AS col, round(60 - (y_min + h * 2), 6) AS x_min, round(x_min, 6) AS y_min, round(value, 6) AS value FROM g JOIN f USING (cloud)")
def r14b(spark, sf):
    _, frame, cells = sparse(spark, sf)
    turned, moved = ra.rotate90_cells(cells, frame, 2.0, 30.0, 30.0, 1)
    return turned.join(moved, "cloud").select("cloud", "row", "col", *r(["x_min", "y_min", "value"]))


@query("r15_sample_feature_map", f"WITH g AS (SELECT cloud, CAST(floor(y / 10) AS BIGINT) AS row, CAST(floor(x / 10) AS BIGINT) AS col, avg(intensity) AS value FROM {PO} GROUP BY ALL), f AS (SELECT DISTINCT cloud, CAST(0 AS DOUBLE) AS x_min, CAST(0 AS DOUBLE) AS y_min, 6 AS h, 6 AS w FROM g) SELECT pid, round(v, 3) AS value FROM {sample_sql('g', 'value', PO, '12')} AS q")
def r15(spark, sf):
    rows = points_o(spark, sf)
    patch = rows.groupBy("cloud", F.floor(F.col("y") / 10).alias("row"), F.floor(F.col("x") / 10).alias("col")).agg(F.avg("intensity").alias("value"))
    return ra.sample_feature_map(rows, patch, 60.0, 6, ["value"]).select("pid", *r(["value"], 3))


@query("r16_gate_prior", f"SELECT pid, round(z - avg(z) OVER (PARTITION BY cloud), 6) AS dtm, round(x - (1 - 1 / (1 + exp(-y / 10))) * z, 6) AS gated FROM {PO}")
def r16(spark, sf):
    rows = points_o(spark, sf).withColumns({"dtm": F.col("z"), "confidence": F.col("y") / 10, "residual": F.col("z"), "s": F.col("x")})
    return ra.gate_prior(rows, by=("cloud",)).select("pid", *r(["dtm", "gated"]))
