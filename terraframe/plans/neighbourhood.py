"""Queries of the spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraframe.operators import spatial as s
from terraframe.operators import voxel as v
from terraframe.plans.aggregates import r, vox
from terraframe.plans.projection import PO
from terraframe.plans.registry import query
from terraframe.sources.views import SCORED, points_o, scored

SC = f"({SCORED}) AS sc"
D3 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"
D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)"


def knn_sql(k: int, d: str = D3, q: str = "TRUE", p: str = "TRUE", src: str = PO) -> str:
    """q_pid, cloud, pid, rank, d2 of the exact neighbours, by comparing all pairs of a cloud."""
    return f"SELECT * FROM (SELECT a.cloud, a.pid AS q_pid, b.pid, b.x, b.y, b.z, {d} AS d2, row_number() OVER (PARTITION BY a.cloud, a.pid ORDER BY {d}, b.pid) AS rank FROM (SELECT * FROM {src} WHERE {q}) AS a JOIN (SELECT * FROM {src} WHERE {p}) AS b ON a.cloud = b.cloud) AS n WHERE rank <= {k}"


@query("n1_knn_join", f"SELECT q_pid, cloud, pid, CAST(rank AS INTEGER) AS rank, round(d2, 9) AS d2 FROM ({knn_sql(4)}) AS k")
def n1(spark, sf):
    rows = points_o(spark, sf).select("cloud", "pid", "x", "y", "z")
    return s.knn_join(rows, rows, 4).select("q_pid", "cloud", "pid", "rank", F.round("d2", 9).alias("d2"))


PAIRS = f"SELECT a.pid AS q_pid, a.cloud, b.pid, round({D2}, 9) AS d2 FROM (SELECT * FROM {PO}) AS a JOIN (SELECT * FROM {PO}) AS b ON a.cloud = b.cloud AND {D2} <= 1.5 * 1.5"


@query("n2_radius_join", PAIRS)
def n2(spark, sf):
    rows = points_o(spark, sf).select("cloud", "pid", "x", "y")
    # rounded in doubles, as the SQL does it: F.round goes by each number's digits, which took a third of the query's time
    return s.radius_join(rows, rows, 1.5, cols=["q_pid", "cloud", "pid", "d2"]).withColumn("d2", F.floor(F.col("d2") * 1e9 + 0.5) / 1e9)


DISCS = f"""WITH k AS ({knn_sql(3, D2)}), disc AS (SELECT a.cloud, a.pid AS q_pid, b.pid FROM (SELECT * FROM {PO}) AS a JOIN (SELECT * FROM {PO}) AS b ON a.cloud = b.cloud AND {D2} <= 1), c AS (SELECT cloud, q_pid, count(*) AS inside FROM disc GROUP BY cloud, q_pid)
 SELECT q_pid, cloud, disc.pid FROM disc JOIN c USING (cloud, q_pid) WHERE inside >= 3 UNION ALL SELECT q_pid, cloud, k.pid FROM k JOIN c USING (cloud, q_pid) WHERE inside < 3"""


@query("n2_radius_or_nearest", DISCS)
def n2b(spark, sf):
    rows = points_o(spark, sf).select("cloud", "pid", "x", "y")
    return s.radius_or_nearest(rows, rows, 1.0, 3).select("q_pid", "cloud", "pid")


VOX = f"(SELECT cloud, vx, vy, vz, count(*) AS n_points FROM {vox(PO, 2)} GROUP BY ALL) AS voxels"
WEIGHTS = [((i * 7) % 5 - 2) / 4 for i in range(27)]


@query("n3_stencil_aggregate", f"WITH v AS (SELECT * FROM {VOX}), o AS (SELECT i - 1 AS i, j - 1 AS j, k - 1 AS k, (((i * 9 + j * 3 + k) * 7) % 5 - 2) / 4 AS w FROM range(3) AS a(i), range(3) AS b(j), range(3) AS c(k)) SELECT v.cloud, v.vx, v.vy, v.vz, round(sum(w * n.n_points) + 0.5, 6) AS conv FROM v, o, v AS n WHERE n.cloud = v.cloud AND n.vx = v.vx + i AND n.vy = v.vy + j AND n.vz = v.vz + k GROUP BY ALL")
def n3(spark, sf):
    voxels = v.voxel_downsample(points_o(spark, sf), 2.0, label=None)
    return s.stencil_aggregate(voxels, WEIGHTS, "n_points", 0.5).select("cloud", "vx", "vy", "vz", *r(["conv"]))


NEAR = f"near AS ({knn_sql(16)})"


def near16(spark, sf):
    rows = points_o(spark, sf).select("cloud", "pid", "x", "y", "z")
    return s.knn_lists(rows, rows, 16)


#: Heights weighted by their place in the range of each query's own neighbourhood.
ELEVATION = "w AS (SELECT *, (z - min(z) OVER q) / greatest(max(z) OVER q - min(z) OVER q, 1e-6) AS w FROM near WINDOW q AS (PARTITION BY cloud, q_pid))"
MEAN_ELEV = "round(sum(z * w) / greatest(sum(w), 1e-6), 6) AS mean_elev"


ELEVATIONS = f"WITH {NEAR}, {ELEVATION} SELECT cloud, q_pid, {MEAN_ELEV} FROM w GROUP BY cloud, q_pid"


@query("n4_mean_elevation", ELEVATIONS)
def n4(spark, sf):
    return s.mean_elevation(near16(spark, sf)).select("cloud", "q_pid", *r(["mean_elev"]))


CURVATURE = f"""c AS (SELECT cloud, q_pid, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(z, z) AS zz, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, count(*) AS n_near FROM near GROUP BY cloud, q_pid),
 q AS (SELECT *, (xx + yy + zz) / 3 AS q FROM c), p AS (SELECT *, sqrt((pow(xx - q, 2) + pow(yy - q, 2) + pow(zz - q, 2) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM q),
 d AS (SELECT *, ((xx - q) * ((yy - q) * (zz - q) - yz * yz) - xy * (xy * (zz - q) - yz * xz) + xz * (xy * yz - (yy - q) * xz)) / (2 * p * p * p) AS r FROM p),
 k AS (SELECT cloud, q_pid, greatest(q + 2 * p * cos(acos(least(greatest(r, -1), 1)) / 3 + 2 * 3.141592653589793 / 3), 0) / (xx + yy + zz) AS share, n_near FROM d)"""


CURVATURES = f"WITH {NEAR}, {CURVATURE} SELECT cloud, q_pid, round(share, 6) AS curvature, n_near FROM k"


@query("n5_curvature", CURVATURES)
def n5(spark, sf):
    return s.curvature(near16(spark, sf)).select("cloud", "q_pid", *r(["curvature"]), "n_near")


@query("n5_normals")
def n5b(spark, sf):
    return s.normals(near16(spark, sf))


@query("n6_shallow_geom", f"WITH near AS ({knn_sql(8)}), {ELEVATION}, {CURVATURE}, e AS (SELECT cloud, q_pid, {MEAN_ELEV} FROM w GROUP BY cloud, q_pid) SELECT e.q_pid AS pid, mean_elev, round(share, 6) AS curvature FROM e JOIN k ON k.cloud = e.cloud AND k.q_pid = e.q_pid")
def n6(spark, sf):
    return s.shallow_geom(points_o(spark, sf), 8).select("pid", *r(["mean_elev", "curvature"]))


#: The first point of each voxel of 3 m stands for it.
SUBSAMPLE = f"sub AS (SELECT cloud, min(pid) AS pid FROM {vox(PO)} GROUP BY cloud, vx, vy, vz)"
NEAREST = f"SELECT q_pid AS pid, pid AS hit FROM (SELECT a.pid AS q_pid, b.pid, row_number() OVER (PARTITION BY a.cloud, a.pid ORDER BY {D3}, b.pid) AS k FROM (SELECT * FROM {PO}) AS a JOIN (SELECT p.* FROM (SELECT * FROM {PO}) AS p JOIN sub ON sub.pid = p.pid) AS b ON a.cloud = b.cloud) AS n WHERE k = 1"


@query("n7_project_back", f"WITH {SUBSAMPLE} SELECT k.pid, CASE b.cls WHEN 2 THEN 1 ELSE 0 END AS label FROM ({NEAREST}) AS k JOIN (SELECT pid, cls FROM {PO}) AS b ON b.pid = k.hit")
def n7(spark, sf):
    rows = points_o(spark, sf)
    first = v.voxel_assign(rows, 3).groupBy("cloud", "vx", "vy", "vz").agg(F.min("pid").alias("pid")).select("cloud", "pid")
    sub = rows.join(first, ["cloud", "pid"], "left_semi").select("pid", "cloud", "x", "y", "z", F.when(F.col("cls") == 2, 1).otherwise(0).alias("label"))
    return s.project_back(rows, sub, ["label"]).select("pid", "label")


@query("n8_nearest_crop", f"WITH m AS (SELECT cloud, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy FROM {PO} GROUP BY cloud) SELECT pid, cloud FROM (SELECT pid, cloud, row_number() OVER (PARTITION BY cloud ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), pid) AS k FROM {PO} JOIN m USING (cloud)) AS s WHERE k <= 500")
def n8(spark, sf):
    return s.nearest_crop(points_o(spark, sf), 500).select("pid", "cloud")


def centres(spark, sf):
    """The points at the candidate centres of all clouds."""
    rows = points_o(spark, sf)
    at = s.candidate_centres(rows, 4.0, 10.0, 20).select("cloud", F.col("center_id").alias("pid"))
    return rows.join(at, ["cloud", "pid"], "left_semi")


@query("n9_farthest_point")
def n9(spark, sf):
    return s.farthest_point(centres(spark, sf), 64)


@query("n9_diverse_gallery")
def n9b(spark, sf):
    return s.diverse_gallery(centres(spark, sf), 40)


def cliffs_sql(tile: str, by: str, candidates: int, n: int) -> str:
    """Plane residuals of each candidate tile; the candidates lie at the rounded places of an even division from the first tile to the last."""
    same = " AND ".join(f"g.{b} = f.{b}" for b in by.split(", "))
    return f"""WITH src AS (SELECT {tile}, x, y, z + CAST(pid % 13 AS DOUBLE) / 7 AS z, label FROM {SC}), tl AS (SELECT DISTINCT {by} FROM src), nm AS (SELECT *, row_number() OVER (ORDER BY {by}) - 1 AS i, count(*) OVER () AS total FROM tl),
 pk AS (SELECT DISTINCT CAST(round_even(k * (total - 1) / CAST({candidates - 1} AS DOUBLE), 0) AS BIGINT) AS i FROM range({candidates}) AS r(k), (SELECT any_value(total) AS total FROM nm) AS t),
 ev AS (SELECT * FROM nm WHERE total <= {candidates} OR i IN (SELECT i FROM pk)), g AS (SELECT src.*, i FROM src JOIN ev USING ({by}) WHERE label = 1),
 f AS (SELECT {by}, covar_pop(x, x) AS xx, covar_pop(y, y) AS yy, covar_pop(x, y) AS xy, covar_pop(x, z) AS xz, covar_pop(y, z) AS yz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM g GROUP BY {by} HAVING count(*) >= 64),
 ab AS (SELECT *, (xz * yy - yz * xy) / (xx * yy - xy * xy) AS a, (yz * xx - xz * xy) / (xx * yy - xy * xy) AS b FROM f)
 SELECT {", ".join("f." + b for b in by.split(", "))}, round(quantile_cont(abs(z - mz - a * (x - mx) - b * (y - my)), 0.95), 6) AS p95 FROM g JOIN ab AS f ON {same} GROUP BY {", ".join("f." + b for b in by.split(", "))} ORDER BY p95 DESC, max(i) DESC LIMIT {n}"""


def bumpy(spark, sf):
    return scored(spark, sf).withColumn("z", F.col("z") + (F.col("pid") % 13).cast("double") / 7)


@query("n10_cliff_tiles", cliffs_sql("cloud", "cloud", 96, 5))
def n10(spark, sf):
    return s.cliff_tiles(bumpy(spark, sf), 5).select("cloud", *r(["p95"]))


@query("n10_cliff_blocks", cliffs_sql("cloud, CAST(floor(y / 15) AS BIGINT) AS tr, CAST(floor(x / 15) AS BIGINT) AS tc", "cloud, tr, tc", 96, 5))
def n10b(spark, sf):
    """Tiles of 15 m, which are more than there are candidates."""
    rows = bumpy(spark, sf).withColumns({"tr": F.floor(F.col("y") / 15), "tc": F.floor(F.col("x") / 15)})
    return s.cliff_tiles(rows, 5, by=("cloud", "tr", "tc")).select("cloud", "tr", "tc", *r(["p95"]))


@query("a8_nominal_spacing", f"""WITH m AS (SELECT cloud, avg(x) AS cx, avg(y) AS cy FROM {PO} GROUP BY cloud), c AS (SELECT *, row_number() OVER (PARTITION BY cloud ORDER BY (x - cx) * (x - cx) + (y - cy) * (y - cy), pid) AS k FROM {PO} JOIN m USING (cloud)),
 d AS (SELECT a.cloud, a.pid, min(sqrt({D2})) AS d FROM (SELECT * FROM c WHERE k <= 120000) AS a JOIN (SELECT * FROM c WHERE k <= 120000) AS b ON a.cloud = b.cloud AND a.pid <> b.pid GROUP BY a.cloud, a.pid)
 SELECT cloud, round(greatest(quantile_cont(d, 0.5) FILTER (d > 0.001), 0.1), 6) AS spacing FROM d GROUP BY cloud""")
def a8(spark, sf):
    return s.nominal_spacing(points_o(spark, sf)).select("cloud", *r(["spacing"]))


@query("a8_nominal_spacing_all", f"WITH d AS (SELECT a.cloud, a.pid, min(sqrt({D2})) AS d FROM (SELECT * FROM {PO}) AS a JOIN (SELECT * FROM {PO}) AS b ON a.cloud = b.cloud AND a.pid <> b.pid GROUP BY a.cloud, a.pid) SELECT cloud, round(greatest(quantile_cont(d, 0.5) FILTER (d > 0.001), 0.1), 6) AS spacing FROM d GROUP BY cloud")
def a8_all(spark, sf):
    return s.nominal_spacing(points_o(spark, sf), None).select("cloud", *r(["spacing"]))


CENTRES = f"""b AS (SELECT cloud, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {PO} GROUP BY cloud),
 n AS (SELECT cloud, row_number() OVER (PARTITION BY cloud ORDER BY i, j) AS node, x0 + i * 10 AS x, y0 + j * 10 AS y FROM b, range(10) AS a(i), range(10) AS c(j) WHERE i <= floor((x1 - x0) / 10) AND j <= floor((y1 - y0) / 10)),
 s AS (SELECT DISTINCT cloud, pid, x, y FROM (SELECT b.cloud, b.pid, b.x, b.y, row_number() OVER (PARTITION BY a.cloud, a.node ORDER BY {D2}, b.pid) AS k FROM n AS a JOIN (SELECT * FROM {PO}) AS b ON a.cloud = b.cloud) AS t WHERE k = 1),
 d0 AS (SELECT a.cloud, a.pid AS center_id, count(*) AS n FROM s AS a JOIN (SELECT * FROM {PO}) AS b ON a.cloud = b.cloud AND {D2} <= 16 GROUP BY ALL HAVING count(*) >= 20),
 m AS (SELECT cloud, avg(x) AS cx, avg(y) AS cy, count(*) AS total FROM {PO} WHERE cloud NOT IN (SELECT cloud FROM d0) GROUP BY cloud),
 o AS (SELECT * FROM (SELECT p.cloud, p.pid, p.x, p.y, total, row_number() OVER (PARTITION BY p.cloud ORDER BY (p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy), p.pid) AS k FROM (SELECT * FROM {PO}) AS p JOIN m ON m.cloud = p.cloud) AS t WHERE k = 1),
 d AS (SELECT * FROM d0 UNION ALL SELECT a.cloud, a.pid, CASE WHEN count(*) < 20 THEN any_value(total) ELSE count(*) END FROM o AS a JOIN (SELECT * FROM {PO}) AS b ON a.cloud = b.cloud AND {D2} <= 16 GROUP BY a.cloud, a.pid)"""


@query("a15_candidate_centres", f"WITH {CENTRES} SELECT cloud, center_id, CAST(n AS INTEGER) AS n FROM d")
def a15(spark, sf):
    return s.candidate_centres(points_o(spark, sf), 4.0, 10.0, 20).select("cloud", "center_id", F.size("members").alias("n"))


@query("a16_candidate_counts", f"WITH {CENTRES} SELECT cloud, center_id, greatest(n, 30) AS n FROM d")
def a16(spark, sf):
    discs = s.candidate_centres(points_o(spark, sf), 4.0, 10.0, 20)
    return v.candidate_counts(discs.withColumn("pid", F.explode("members")), 30)


def level_sql(src: str, dl: int) -> str:
    """The mean points of the voxels of src, counted from each cloud's corner."""
    cell = ", ".join(f"CAST(floor(({c} - min({c}) OVER c) / {dl}) AS BIGINT) AS v{c}" for c in "xyz")
    return f"(SELECT cloud, vx, vy, vz, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM (SELECT cloud, x, y, z, {cell} FROM {src} WINDOW c AS (PARTITION BY cloud)) AS s GROUP BY cloud, vx, vy, vz)"


def counts_sql(level: int, kind: str, asking: str, other: str, radius: float) -> str:
    """Neighbours of each point of one level among those of another."""
    return f"SELECT {level} AS level, '{kind}' AS kind, count(*) AS n FROM {asking} AS a JOIN {other} AS b ON a.cloud = b.cloud AND {D3} <= {radius * radius} GROUP BY a.cloud, a.vx, a.vy, a.vz"


PROFILE = f"""WITH l0 AS {level_sql(PO, 1)}, l1 AS {level_sql('l0', 2)}, l2 AS {level_sql('l1', 4)},
 n AS ({counts_sql(0, 'same', 'l0', 'l0', 2.5)} UNION ALL {counts_sql(1, 'same', 'l1', 'l1', 5.0)} UNION ALL {counts_sql(2, 'same', 'l2', 'l2', 10.0)}
  UNION ALL {counts_sql(1, 'coarse_to_fine', 'l1', 'l0', 2.5)} UNION ALL {counts_sql(2, 'coarse_to_fine', 'l2', 'l1', 5.0)}),
 p AS (SELECT level, kind, CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS median_n, CAST(floor(quantile_cont(n, 0.95)) AS BIGINT) AS pct_n, max(n) AS max_n FROM n GROUP BY level, kind)
 SELECT *, CAST(least(greatest(max(pct_n) OVER (), 1), 1024) AS BIGINT) AS cap_n FROM p"""


@query("a18_neighbour_profile", PROFILE)
def a18(spark, sf):
    return s.neighbour_profile(points_o(spark, sf), 1.0, 2.5)


@query("t4_hole_mask", f"WITH n AS (SELECT DISTINCT cloud, CAST(i * 100 + j AS BIGINT) AS node, CAST(i AS DOUBLE) AS x, CAST(j AS DOUBLE) AS y FROM {PO}, range(0, 60, 4) AS a(i), range(0, 60, 4) AS b(j)), d AS (SELECT a.cloud, a.node, min({D2}) AS d2 FROM n AS a JOIN (SELECT * FROM {PO}) AS b ON a.cloud = b.cloud GROUP BY ALL) SELECT cloud, node, d2 > 0.5 * 0.5 AS hole FROM d")
def t4(spark, sf):
    rows = points_o(spark, sf)
    axis = F.sequence(F.lit(0), F.lit(56), F.lit(4))
    nodes = rows.select("cloud").distinct().withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis)).selectExpr("cloud", "CAST(i * 100 + j AS BIGINT) AS node", "CAST(i AS DOUBLE) AS x", "CAST(j AS DOUBLE) AS y")
    return s.hole_mask(nodes, rows, 0.5).select("cloud", "node", "hole")


@query("a21_coverage_filter", f"WITH c AS (SELECT * FROM {PO}), k AS (SELECT DISTINCT cloud, CAST(floor(y / 2) AS BIGINT) AS row, CAST(floor(x / 2) AS BIGINT) AS col FROM {PO} WHERE cls = 2), g AS (SELECT c.cloud, avg(CASE WHEN k.row IS NULL THEN 0 ELSE 1 END) AS cov FROM c LEFT JOIN k ON k.cloud = c.cloud AND k.row = floor(c.y / 2) AND k.col = floor(c.x / 2) GROUP BY c.cloud HAVING avg(CASE WHEN k.row IS NULL THEN 0 ELSE 1 END) >= 0.5) SELECT pid, cloud FROM c WHERE cloud IN (SELECT cloud FROM g)")
def a21(spark, sf):
    rows = points_o(spark, sf)
    cells = rows.filter("cls = 2").groupBy("cloud", F.floor(F.col("y") / 2).alias("row"), F.floor(F.col("x") / 2).alias("col")).agg(F.avg("z").alias("value"))
    return v.coverage_filter(rows, cells, 0.0, 0.0, 2.0, 0.5).select("pid", "cloud")


@query("a21_coverage_filter_centres", f"WITH {CENTRES}, c AS (SELECT p.cloud, p.pid, p.x, p.y FROM (SELECT * FROM {PO}) AS p JOIN d ON d.cloud = p.cloud AND d.center_id = p.pid), k AS (SELECT DISTINCT cloud, CAST(floor(y / 2) AS BIGINT) AS row, CAST(floor(x / 2) AS BIGINT) AS col FROM {PO} WHERE cls = 2), g AS (SELECT c.cloud FROM c LEFT JOIN k ON k.cloud = c.cloud AND k.row = floor(c.y / 2) AND k.col = floor(c.x / 2) GROUP BY c.cloud HAVING avg(CASE WHEN k.row IS NULL THEN 0 ELSE 1 END) >= 0.5) SELECT pid, cloud FROM c WHERE cloud IN (SELECT cloud FROM g)")
def a21_centres(spark, sf):
    rows = points_o(spark, sf)
    cells = rows.filter("cls = 2").groupBy("cloud", F.floor(F.col("y") / 2).alias("row"), F.floor(F.col("x") / 2).alias("col")).agg(F.avg("z").alias("value"))
    return v.coverage_filter(centres(spark, sf), cells, 0.0, 0.0, 2.0, 0.5).select("pid", "cloud")
