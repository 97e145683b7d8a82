"""Queries of the grouped aggregations and the metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraframe.operators import metrics as m
from terraframe.operators import project as p
from terraframe.operators import voxel as v
from terraframe.plans.projection import GRID, PL, PO, grid, morton_sql
from terraframe.plans.registry import query
from terraframe.sources.views import SCORED, points_l, points_o, scored

SC = f"({SCORED}) AS sc"
LABEL = "CASE WHEN cls IN (0, 1) THEN 2 WHEN cls IN (2, 9) THEN 1 ELSE 0 END"


def vox(src: str, dl: float = 3) -> str:
    return f"(SELECT *, CAST({LABEL} AS INTEGER) AS label, CAST(floor((x - min(x) OVER c) / {dl}) AS BIGINT) AS vx, CAST(floor((y - min(y) OVER c) / {dl}) AS BIGINT) AS vy, CAST(floor((z - min(z) OVER c) / {dl}) AS BIGINT) AS vz FROM {src} WINDOW c AS (PARTITION BY cloud)) AS vox"


def r(cols, n: int = 6):
    return [F.round(c, n).alias(c) for c in cols]


@query("a1_voxel_downsample", f"""WITH v AS (SELECT * FROM {vox(PL)}), a AS (SELECT cloud, vx, vy, vz, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, round(avg(intensity), 3) AS intensity, count(*) AS n_points FROM v GROUP BY cloud, vx, vy, vz),
 c AS (SELECT cloud, vx, vy, vz, label, row_number() OVER (PARTITION BY cloud, vx, vy, vz ORDER BY count(*) DESC, label) AS k FROM v GROUP BY cloud, vx, vy, vz, label)
 SELECT a.*, c.label FROM a JOIN c USING (cloud, vx, vy, vz) WHERE k = 1""")
def a1(spark, sf):
    out = v.voxel_downsample(p.map_labels(points_l(spark, sf)), 3, ["intensity"])
    return out.select("cloud", "vx", "vy", "vz", *r("xyz", 9), *r(["intensity"], 3), "n_points", "label")


@query("a2_voxel_majority", f"""WITH c AS (SELECT cloud, vx, vy, vz, label, row_number() OVER (PARTITION BY cloud, vx, vy, vz ORDER BY label = 2, count(*) DESC, label) AS k FROM {vox(PL, 8)} GROUP BY cloud, vx, vy, vz, label)
 SELECT cloud, vx, vy, vz, label FROM c WHERE k = 1""")
def a2(spark, sf):
    return v.voxel_majority(p.map_labels(points_l(spark, sf)), 8)


@query("a3_voxel_mean", f"SELECT cloud, vx, vy, vz, round(avg(CASE WHEN nret > 2 THEN intensity END), 3) AS intensity FROM {vox(PL)} GROUP BY cloud, vx, vy, vz")
def a3(spark, sf):
    rows = points_l(spark, sf).withColumn("intensity", F.when(F.col("nret") > 2, F.col("intensity")).otherwise(F.lit(float("nan"))))
    return v.voxel_mean(rows, 3, ["intensity"], True).withColumn("intensity", F.round("intensity", 3))


@query("a4_push_back", f"SELECT pid, round(avg(z) OVER (PARTITION BY cloud, vx, vy, vz), 9) AS z, count(*) OVER (PARTITION BY cloud, vx, vy, vz) AS n_points FROM {vox(PO)}")
def a4(spark, sf):
    rows = points_o(spark, sf)
    return v.push_back(v.voxel_assign(rows, 3), v.voxel_downsample(rows, 3, label=None), ["z", "n_points"]).select("pid", *r("z", 9), "n_points")


CODED = f"(SELECT *, {morton_sql('gx', 'gy', 'gz', 8)} AS code_z FROM {GRID}) AS coded"


def coded(spark, sf):
    return p.serialize(grid(spark, sf), ("z",), 8)


@query("a5_pool", f"SELECT cloud, code_z >> 6 AS parent, max(intensity) AS intensity, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, min(gx >> 2) AS gx, min(gy >> 2) AS gy, min(gz >> 2) AS gz, min(pid) AS representative, count(*) AS n_children FROM {CODED} GROUP BY cloud, code_z >> 6")
def a5(spark, sf):
    out = v.pool(coded(spark, sf), "code_z", 2, ["intensity"])
    return out.select("cloud", "parent", "intensity", *r("xyz", 9), "gx", "gy", "gz", "representative", "n_children")


@query("a5_unpool", f"SELECT pid, round(z + max(z) OVER (PARTITION BY cloud, code_z >> 6), 6) AS z FROM {CODED}")
def a5b(spark, sf):
    rows = coded(spark, sf)
    return v.unpool(rows, v.pool(rows.drop("x", "y").withColumns({"x": F.lit(0.0), "y": F.lit(0.0)}).withColumn("zz", F.col("z")), "code_z", 2, ["zz"]).withColumn("z", F.col("zz")), "code_z", 2, "z").select("pid", *r("z"))


@query("a6_pool_last", f"SELECT cloud, code_z >> 6 AS parent, arg_max(intensity, code_z * 10000000 + pid) AS intensity FROM {CODED} GROUP BY cloud, code_z >> 6")
def a6(spark, sf):
    return v.pool_last(coded(spark, sf), "code_z", 2, "intensity")


@query("a7_cloud_sizes", f"SELECT cloud, n_points, row_number() OVER (ORDER BY cloud) - 1 AS batch, CAST(sum(n_points) OVER (ORDER BY cloud) AS BIGINT) AS stop, CAST(sum(n_points) OVER (ORDER BY cloud) - n_points AS BIGINT) AS start FROM (SELECT cloud, count(*) AS n_points FROM {PL} GROUP BY cloud) AS n")
def a7(spark, sf):
    return v.cloud_sizes(points_l(spark, sf))


NORMS = f"SELECT round(avg(x), 6) AS mean_x, round(avg(z), 6) AS mean_z, round(sqrt(greatest(avg(x * x) - avg(x) * avg(x), 1e-8)), 6) AS std_x, round(sqrt(greatest(avg(z * z) - avg(z) * avg(z), 1e-8)), 6) AS std_z, count(*) AS n_points, CAST(2 AS INTEGER) AS n_features FROM {PO}"


@query("a9_norm_stats", NORMS)
def a9(spark, sf):
    out = v.norm_stats(points_o(spark, sf), ["x", "z"], None)
    g = lambda c, i: F.round(F.get(c, F.lit(i)), 6)
    return out.select(g("mean", 0).alias("mean_x"), g("mean", 1).alias("mean_z"), g("std", 0).alias("std_x"), g("std", 1).alias("std_z"), "n_points", "n_features")


@query("p6_standardise", f"WITH s AS (SELECT avg(x) AS mx, avg(z) AS mz, sqrt(greatest(avg(x * x) - avg(x) * avg(x), 1e-8)) AS sx, sqrt(greatest(avg(z * z) - avg(z) * avg(z), 1e-8)) AS sz FROM {PO}) SELECT pid, round((x - mx) / sx, 6) AS x, round((z - mz) / sz, 6) AS z FROM {PO}, s")
def p6(spark, sf):
    rows = points_o(spark, sf)
    return p.standardise(rows, v.norm_stats(rows, ["x", "z"]), ["x", "z"]).select("pid", *r(["x", "z"]))


@query("a10_class_histogram", f"WITH n AS (SELECT cloud, cls, CAST({LABEL} AS INTEGER) AS label, count(*) AS n FROM {PL} GROUP BY ALL) SELECT cloud, cls, label, n, round(n / sum(n) OVER (PARTITION BY cloud), 9) AS share, round(sum(n) OVER (PARTITION BY cloud, label) / sum(n) OVER (PARTITION BY cloud), 9) AS label_share FROM n")
def a10(spark, sf):
    return v.class_histogram(p.map_labels(points_l(spark, sf))).withColumns({c: F.round(c, 9) for c in ("share", "label_share")})


@query("a10_label_warnings", f"SELECT cloud, round(avg(CAST(label = 2 AS INTEGER)), 9) AS ignore_share, round(avg(CAST(label = 0 AS INTEGER)), 9) AS other_share, avg(CAST(label = 2 AS INTEGER)) > 0.3 AS warn_ignore, avg(CAST(label = 0 AS INTEGER)) < 0.05 AS warn_other FROM (SELECT cloud, {LABEL} AS label FROM {PL}) AS l GROUP BY cloud")
def a10b(spark, sf):
    return v.label_warnings(p.map_labels(points_l(spark, sf))).withColumns({c: F.round(c, 9) for c in ("ignore_share", "other_share")})


@query("a11_label_audit", f"WITH l AS (SELECT cloud, {LABEL} AS label, CASE survey_year % 3 WHEN 0 THEN 'test' WHEN 1 THEN 'train' ELSE 'val' END AS split FROM {PL}), s AS (SELECT split, count(DISTINCT cloud) AS n_tiles, count(*) AS n_points, round(count(*) FILTER (label = 1) / count(*), 9) AS ground, round(count(*) FILTER (label = 0) / count(*), 9) AS other, round(count(*) FILTER (label = 2) / count(*), 9) AS ignored FROM l GROUP BY split) SELECT *, split = 'train' AND ignored > 0.3 AS warn_ignore, split = 'train' AND other < 0.05 AS warn_other FROM s")
def a11(spark, sf):
    rows = p.map_labels(points_l(spark, sf)).withColumn("split", F.when(F.col("survey_year") % 3 == 0, "test").when(F.col("survey_year") % 3 == 1, "train").otherwise("val"))
    return v.label_audit(rows).withColumns({c: F.round(c, 9) for c in ("ground", "other", "ignored")})


@query("a11_wide_channels", f"SELECT CAST(channel AS INTEGER) AS channel, mean FROM (SELECT 0 AS channel, round(avg(x), 6) AS mean FROM {PO} UNION ALL SELECT 1, round(avg(z), 6) FROM {PO} UNION ALL SELECT 2, round(avg(y), 6) FROM {PO}) AS c WHERE abs(mean) > 10")
def a11b(spark, sf):
    return v.wide_channels(v.norm_stats(points_o(spark, sf), ["x", "z", "y"])).select("channel", *r(["mean"]))


@query("a12_repetition_factor", f"SELECT count(DISTINCT cloud) AS n_tiles, round(500 / greatest(count(DISTINCT cloud), 1), 9) AS views, 500 / greatest(count(DISTINCT cloud), 1) > 8 AS warn FROM {PL}")
def a12(spark, sf):
    return v.repetition_factor(points_l(spark, sf), 500).withColumn("views", F.round("views", 9))


@query("a13_region_report", f"WITH t AS (SELECT cloud, CAST(survey_year AS VARCHAR) AS region, CASE WHEN cloud LIKE 'CL_1%' THEN 'val' ELSE 'train' END AS split, count(*) AS n_candidates FROM {PL} GROUP BY ALL), s AS (SELECT region, split, count(*) AS n_tiles, CAST(sum(n_candidates) AS BIGINT) AS n_candidates FROM t GROUP BY GROUPING SETS ((region), (split), ())) SELECT *, round(n_candidates / max(n_candidates) OVER (), 9) AS share FROM s")
def a13(spark, sf):
    tiles = points_l(spark, sf).groupBy("cloud", F.col("survey_year").cast("string").alias("region"), F.when(F.col("cloud").startswith("CL_1"), "val").otherwise("train").alias("split")).agg(F.count("*").alias("n_candidates"))
    return v.region_report(tiles).withColumn("share", F.round("share", 9))


@query("a14_class_weights", f"WITH n AS (SELECT label, count(*) AS n FROM {SC} WHERE label <> 2 GROUP BY label) SELECT label, n, round(least(greatest((1 / n) / avg(1 / n) OVER (), 0.1), 10), 9) AS weight FROM n")
def a14(spark, sf):
    return v.class_weights(scored(spark, sf)).withColumn("weight", F.round("weight", 9))


@query("a17_batch_limit", f"SELECT greatest(CAST(round_even(3.5 * (sum(n * w) / sum(w)), 0) AS BIGINT), 1) AS \"limit\" FROM (SELECT cloud, count(*) AS n, CAST(1 + min(survey_year) % 3 AS DOUBLE) AS w FROM {PL} GROUP BY cloud) AS c")
def a17(spark, sf):
    counts = points_l(spark, sf).groupBy("cloud").agg(F.count("*").alias("n"), (1 + F.min("survey_year") % 3).cast("double").alias("w"))
    return v.batch_limit(counts, 3, "w")


@query("a19_regime_targets", f"WITH g AS (SELECT cloud, count(*) FILTER (label = 1) AS n_ground, (max(x) FILTER (label = 1) - min(x) FILTER (label = 1) + 1e-9) * (max(y) FILTER (label = 1) - min(y) FILTER (label = 1) + 1e-9) AS area FROM {SC} GROUP BY cloud) SELECT cloud, n_ground, CAST(10 AS DOUBLE) AS theta0, CAST(0.5 AS DOUBLE) AS alpha, CAST(0.7 AS DOUBLE) AS beta, CAST(3 AS DOUBLE) AS n_mad, CAST(0.1 AS DOUBLE) AS floor, round(least(greatest(CASE WHEN n_ground < 32 THEN CAST(4.25 AS DOUBLE) ELSE sqrt(8 / greatest(n_ground / area, 1e-6)) END, 0.5), 8), 6) AS base_res FROM g")
def a19(spark, sf):
    return v.regime_targets(scored(spark, sf)).withColumn("base_res", F.round("base_res", 6))


@query("a20_prediction_stats", f"SELECT cloud, round(avg(pred), 6) AS ground_share, round((coalesce(avg(z) FILTER (pred = 1), 0) - avg(z)) / 10, 6) AS dz, round(coalesce(stddev_pop(z) FILTER (pred = 1), 0) / 10, 6) AS std_ground, round(stddev_pop(z) / 10, 6) AS std_all, round(least(max(z) - min(z), 10000) / 10, 6) AS z_range, round(ln(count(*)) - 12, 6) AS log_n, round(avg(p_ground), 6) AS mean_p, round(coalesce(stddev_pop(z) FILTER (pred = 1), 0) / (stddev_pop(z) + 1e-3), 6) AS std_ratio FROM {SC} GROUP BY cloud")
def a20(spark, sf):
    return v.prediction_stats(scored(spark, sf)).select("cloud", *r(["ground_share", "dz", "std_ground", "std_all", "z_range", "log_n", "mean_p", "std_ratio"]))


def conf_sql(pred: str = "pred", by: str = "") -> str:
    key = f"{by}, " if by else ""
    return f"SELECT {key}count(*) FILTER (label = 0 AND {pred} = 0) AS tp1, count(*) FILTER (label = 1 AND {pred} = 1) AS tp2, count(*) FILTER (label = 1 AND {pred} = 0) AS fp1, count(*) FILTER (label = 0 AND {pred} = 1) AS fp2 FROM {SC} WHERE label < 2" + (f" GROUP BY {by}" if by else "")


SEG = """tp1 / (tp1 + fp1 + fp2 + 1e-8) AS i1, tp2 / (tp2 + fp1 + fp2 + 1e-8) AS i2, (tp1 + tp2) / (tp1 + tp2 + fp1 + fp2 + 1e-8) AS a,
 ((tp1 + fp1) * (tp1 + fp2) + (tp2 + fp2) * (tp2 + fp1)) / (CAST(tp1 + tp2 + fp1 + fp2 AS DOUBLE) * (tp1 + tp2 + fp1 + fp2) + 1e-8) AS pe,
 (CAST(tp1 AS DOUBLE) * tp2 - CAST(fp1 AS DOUBLE) * fp2) / (sqrt(CAST(tp1 + fp1 AS DOUBLE) * (tp1 + fp2) * (tp2 + fp1) * (tp2 + fp2)) + 1e-8) AS mc"""


@query("m1_confusion", conf_sql(by="cloud"))
def m1(spark, sf):
    return m.confusion(scored(spark, sf), by=("cloud",))


@query("m2_segmentation_metrics", f"SELECT cloud, round(i1 * 100, 6) AS iou_nonground, round(i2 * 100, 6) AS iou_ground, round(a * 100, 6) AS oa, round((a - pe) / (1 - pe + 1e-8) * 100, 6) AS kappa, round(mc * 100, 6) AS mcc, round((i1 + i2) / 2 * 100, 6) AS miou FROM (SELECT cloud, {SEG} FROM ({conf_sql(by='cloud')}) AS c) AS s")
def m2(spark, sf):
    return m.segmentation_metrics(m.confusion(scored(spark, sf), by=("cloud",))).select("cloud", *r(["iou_nonground", "iou_ground", "oa", "kappa", "mcc", "miou"]))


@query("m3_binary_metrics", f"SELECT round(100 * pr, 6) AS precision, round(100 * rc, 6) AS recall, round(200 * pr * rc / (pr + rc + 1e-8), 6) AS f1, round(i1 * 100, 6) AS iou_nonground, round(i2 * 100, 6) AS iou_ground, round(a * 100, 6) AS oa, round(mc, 6) AS mcc, round((a - pe) / (1 - pe + 1e-8), 6) AS kappa FROM (SELECT {SEG}, tp2 / (tp2 + fp2 + 1e-8) AS pr, tp2 / (tp2 + fp1 + 1e-8) AS rc FROM ({conf_sql()}) AS c) AS s")
def m3(spark, sf):
    return m.binary_metrics(scored(spark, sf)).select(*r(["precision", "recall", "f1", "iou_nonground", "iou_ground", "oa", "mcc", "kappa"]))


#: Cells of 2 m from the corner of all points of a cloud; the last row and column take what lies on the far edges.
ERR = f"""ok AS (SELECT cloud FROM {SC} GROUP BY cloud HAVING count(*) FILTER (label = 1) >= 3 AND count(*) FILTER (pred = 1 AND label < 2) >= 3),
 fr AS (SELECT cloud, min(x) AS x0, min(y) AS y0, greatest(ceil((max(x) - min(x)) / 2), 1) AS w, greatest(ceil((max(y) - min(y)) / 2), 1) AS h FROM {SC} GROUP BY cloud),
 pl AS (SELECT sc.*, CAST(least(floor((y - y0) / 2), h - 1) AS BIGINT) AS row, CAST(least(floor((x - x0) / 2), w - 1) AS BIGINT) AS col FROM {SC} JOIN fr USING (cloud)),
 t AS (SELECT cloud, row, col, avg(z) AS z_true FROM pl WHERE label = 1 GROUP BY ALL),
 g AS (SELECT cloud, row, col, avg(z) AS z_pred FROM pl WHERE pred = 1 AND label < 2 GROUP BY ALL),
 e AS (SELECT cloud, row, col, z_pred - z_true AS error FROM t JOIN g USING (cloud, row, col) WHERE cloud IN (SELECT cloud FROM ok))"""


@query("m4_dtm_rmse", f"WITH {ERR}, s AS (SELECT cloud, sum(error * error) AS sse, count(*) AS n FROM e GROUP BY cloud), a AS (SELECT fr.cloud, coalesce(sse, 0) AS sse, coalesce(n, 0) AS n FROM fr LEFT JOIN s USING (cloud)) SELECT cloud, round(sse, 6) AS sse, n, round(sqrt(sum(sse) OVER () / nullif(sum(n) OVER (), 0)), 6) AS total_rmse FROM a")
def m4(spark, sf):
    return m.dtm_rmse(scored(spark, sf), 2.0).select("cloud", *r(["sse"]), "n", *r(["total_rmse"]))


@query("m4_dtm_rmse_tin")
def m4b(spark, sf):
    return m.dtm_rmse(scored(spark, sf), 2.0, surface="tin").select("cloud", *r(["sse"]), "n", *r(["total_rmse"]))


@query("m5_aggregate_error", f"WITH {ERR} SELECT cloud, round(sqrt(avg(error * error)), 6) AS rmse, round(quantile_cont(abs(error), 0.95), 6) AS p95, round(quantile_cont(abs(error), 0.99), 6) AS p99, round(max(abs(error)), 6) AS max_error FROM e GROUP BY cloud UNION ALL SELECT cloud, CAST('inf' AS DOUBLE), CAST('inf' AS DOUBLE), CAST('inf' AS DOUBLE), CAST('inf' AS DOUBLE) FROM fr WHERE cloud NOT IN (SELECT cloud FROM e)")
def m5(spark, sf):
    rows = scored(spark, sf)
    return m.aggregate_error(m.dtm_errors(rows, 2.0), clouds=rows).select("cloud", *r(["rmse", "p95", "p99", "max_error"]))


@query("m6_lovasz", f"""WITH c AS (SELECT cloud, pid, 0 AS cls, CAST(label = 0 AS INTEGER) AS fg, abs(CAST(label = 0 AS INTEGER) - (1 - p_ground)) AS err FROM {SC} WHERE label < 2 UNION ALL SELECT cloud, pid, 1, CAST(label = 1 AS INTEGER), abs(CAST(label = 1 AS INTEGER) - p_ground) FROM {SC} WHERE label < 2),
 k AS (SELECT *, sum(fg) OVER (PARTITION BY cloud, cls) AS g, sum(fg) OVER w AS hit, row_number() OVER w AS k FROM c WINDOW w AS (PARTITION BY cloud, cls ORDER BY err DESC, pid)),
 j AS (SELECT *, 1 - (g - hit) / (g + k - hit) AS j FROM k WHERE g > 0), s AS (SELECT *, j - coalesce(lag(j) OVER (PARTITION BY cloud, cls ORDER BY k), 0) AS s FROM j), l AS (SELECT cloud, cls, sum(err * s) AS loss FROM s GROUP BY cloud, cls)
 SELECT cloud, round(avg(loss), 6) AS lovasz FROM l GROUP BY cloud""")
def m6(spark, sf):
    return m.lovasz(scored(spark, sf)).select("cloud", *r(["lovasz"]))


@query("m7_cross_entropy", f"SELECT cloud, round(avg(-ln(least(greatest(CASE WHEN label = 1 THEN p_ground ELSE 1 - p_ground END, 1e-7), 1))), 6) AS cross_entropy FROM {SC} WHERE label < 2 GROUP BY cloud")
def m7(spark, sf):
    return m.cross_entropy(scored(spark, sf)).select("cloud", *r(["cross_entropy"]))


@query("m8_ndsm_loss", f"SELECT cloud, round(avg(abs((z - x / 20) / 10)), 6) AS l1, round(avg(pow((z - x / 20) / 10, 2)), 6) AS l2 FROM {SC} WHERE label < 2 GROUP BY cloud")
def m8(spark, sf):
    return m.ndsm_loss(scored(spark, sf).withColumn("t", F.col("x") / 20), "z", "t").select("cloud", *r(["l1", "l2"]))


def seg(pred: str, tag: str) -> str:
    return f"SELECT round(i1 * 100, 6) AS iou_nonground{tag}, round(i2 * 100, 6) AS iou_ground{tag}, round(a * 100, 6) AS oa{tag}, round((a - pe) / (1 - pe + 1e-8) * 100, 6) AS kappa{tag}, round(mc * 100, 6) AS mcc{tag}, round((i1 + i2) / 2 * 100, 6) AS miou{tag} FROM (SELECT {SEG} FROM ({conf_sql(pred)}) AS c) AS s"


@query("m9_evaluate", f"SELECT * FROM ({seg('refined', '')}) AS a, ({seg('pred', '_raw')}) AS b, (SELECT count(*) FILTER (pred <> refined) AS n_reclassified, round(avg(CAST(pred <> refined AS INTEGER)), 9) AS reclassified_frac FROM {SC}) AS c")
def m9(spark, sf):
    out = m.evaluate(scored(spark, sf))
    return out.select(*[F.round(c, 9 if c == "reclassified_frac" else 6).alias(c) if c != "n_reclassified" else F.col(c) for c in out.columns])


HISTORY = f"(SELECT CAST(right(cloud, 4) AS INTEGER) AS epoch, CASE WHEN right(cloud, 4) = '1995' THEN CAST('nan' AS DOUBLE) ELSE round(avg(p_ground), 3) END AS miou FROM {SC} GROUP BY cloud) AS h"


def history(spark, sf):
    rows = scored(spark, sf).groupBy("cloud").agg(F.round(F.avg("p_ground"), 3).alias("miou"))
    year = F.substring("cloud", -4, 4)
    return rows.select(year.cast("int").alias("epoch"), F.when(year == "1995", F.lit(float("nan"))).otherwise(F.col("miou")).alias("miou"))


@query("m10_best_run", f"SELECT epoch, miou FROM {HISTORY} WHERE isfinite(miou) ORDER BY miou DESC, epoch LIMIT 1")
def m10(spark, sf):
    return m.best_run(history(spark, sf))


@query("m10_ema_best", f"""WITH RECURSIVE h AS (SELECT *, row_number() OVER (ORDER BY epoch) AS i FROM {HISTORY} WHERE isfinite(miou)), e(i, epoch, ema) AS (SELECT i, epoch, miou FROM h WHERE i = 1 UNION ALL SELECT h.i, h.epoch, 0.9 * ema + 0.1 * miou FROM e JOIN h ON h.i = e.i + 1)
 SELECT CAST(epoch AS BIGINT) AS epoch, round(ema, 9) AS ema FROM e ORDER BY e.ema, epoch LIMIT 1""")
def m10b(spark, sf):
    return m.ema_best(history(spark, sf), "miou").withColumn("ema", F.round("ema", 9))


@query("t1_profile", f"""WITH f AS (SELECT cloud, quantile_cont(y, 0.5) AS my, max(y) - min(y) AS ey, min(x) AS x0 FROM {SC} GROUP BY cloud),
 d AS (SELECT sc.*, my, ey, x - x0 AS dx, count_if(abs(y - my) <= greatest(ey * 0.06, 1)) OVER (PARTITION BY cloud) AS n1, count_if(abs(y - my) <= ey * 0.15) OVER (PARTITION BY cloud) AS n2 FROM {SC} JOIN f USING (cloud)),
 g AS (SELECT cloud, dx, z, min(dx) OVER w AS lo, max(dx) OVER w AS hi, count(*) OVER w AS k FROM d WHERE label = 1 AND CASE WHEN n1 >= 60 THEN abs(y - my) <= greatest(ey * 0.06, 1) WHEN n2 > 0 THEN abs(y - my) <= ey * 0.15 ELSE TRUE END WINDOW w AS (PARTITION BY cloud)),
 i AS (SELECT cloud, lo, hi, z, CASE WHEN hi > lo THEN least(CAST(floor((dx - lo) / ((hi - lo) / 80)) AS BIGINT), 79) ELSE 79 END AS bin FROM g WHERE k >= 4),
 l AS (SELECT cloud, bin, any_value(lo) AS lo, any_value(hi) AS hi, quantile_cont(z, 0.3) AS z, count(*) AS n FROM i GROUP BY cloud, bin),
 c AS (SELECT cloud, any_value(lo) AS lo, any_value(hi) AS hi FROM l GROUP BY cloud HAVING count(*) >= 2),
 a AS (SELECT c.cloud, b.bin, lo, hi, l.z, coalesce(l.n, 0) AS n, CASE WHEN l.z IS NOT NULL THEN b.bin END AS seen FROM c CROSS JOIN (SELECT unnest(range(80)) AS bin) b LEFT JOIN (SELECT cloud, bin, z, n FROM l) AS l ON l.cloud = c.cloud AND l.bin = b.bin),
 w AS (SELECT *, last_value(seen IGNORE NULLS) OVER p AS b0, first_value(seen IGNORE NULLS) OVER q AS b1, last_value(z IGNORE NULLS) OVER p AS z0, first_value(z IGNORE NULLS) OVER q AS z1 FROM a WINDOW p AS (PARTITION BY cloud ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), q AS (PARTITION BY cloud ORDER BY bin ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT cloud, bin, round(lo + (bin + 0.5) * ((hi - lo) / 80), 6) AS x, round(CASE WHEN b0 IS NULL THEN z1 WHEN b1 IS NULL OR b0 = b1 THEN z0 ELSE z0 + (z1 - z0) * (bin - b0) / (b1 - b0) END, 6) AS z, n FROM w""")
def t1(spark, sf):
    return m.profile(scored(spark, sf)).select("cloud", "bin", *r("xz"), "n")


@query("t2_error_points", f"WITH k AS (SELECT cloud, CASE WHEN pred = label THEN 'correct' WHEN label = 1 THEN 'ground_to_other' ELSE 'other_to_ground' END AS outcome, count(*) AS n FROM {SC} WHERE label < 2 GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY cloud), 9) AS share FROM k")
def t2(spark, sf):
    return m.error_points(scored(spark, sf)).withColumn("share", F.round("share", 9))


CELL = f"(SELECT *, CAST(floor((y - min(y) OVER c) / 3) AS BIGINT) AS row, CAST(floor((x - min(x) OVER c) / 3) AS BIGINT) AS col FROM {PO} WINDOW c AS (PARTITION BY cloud)) AS cell"


@query("t3_surface_max", f"SELECT cloud, row, col, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY cloud, row, col ORDER BY z DESC, pid) AS k FROM {CELL}) AS s WHERE k = 1")
def t3(spark, sf):
    return m.surface_cells(points_o(spark, sf), 3.0)


@query("t3_surface_low", f"WITH q AS (SELECT *, quantile_cont(z, 0.2) OVER (PARTITION BY cloud, row, col) AS q FROM {CELL}) SELECT cloud, row, col, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z) FILTER (z <= q), 6) AS z FROM q GROUP BY cloud, row, col")
def t3b(spark, sf):
    return m.surface_cells(points_o(spark, sf), 3.0, "low").select("cloud", "row", "col", *r("xyz"))


@query("t5_z_range", f"SELECT cloud, CASE WHEN b - a < 1e-6 THEN lo ELSE a END AS z_lo, CASE WHEN b - a >= 1e-6 THEN b WHEN hi - lo < 1e-6 THEN lo + 1 ELSE hi END AS z_hi FROM (SELECT cloud, round(quantile_cont(z, 0.02), 6) AS a, round(quantile_cont(z, 0.98), 6) AS b, round(min(z), 6) AS lo, round(max(z), 6) AS hi FROM {PO} GROUP BY cloud) AS q")
def t5(spark, sf):
    return m.z_range(points_o(spark, sf)).select("cloud", *r(["z_lo", "z_hi"]))


def err_side(pred: str) -> str:
    return ERR.replace("pred = 1", f"{pred} = 1")


@query("t6_refine_report", f"""WITH b AS (WITH {err_side('pred')} SELECT cloud, round(sqrt(avg(error * error)), 6) AS rmse_before FROM e GROUP BY cloud), a AS (WITH {err_side('refined')} SELECT cloud, round(sqrt(avg(error * error)), 6) AS rmse_after FROM e GROUP BY cloud),
 ib AS (SELECT cloud, round(tp2 / (tp2 + fp1 + fp2 + 1e-8) * 100, 6) AS iou_ground_before FROM ({conf_sql('pred', 'cloud')}) AS c), ia AS (SELECT cloud, round(tp2 / (tp2 + fp1 + fp2 + 1e-8) * 100, 6) AS iou_ground_after FROM ({conf_sql('refined', 'cloud')}) AS c),
 n AS (SELECT cloud, count(*) FILTER (pred <> refined) AS n_reclassified FROM {SC} GROUP BY cloud) SELECT cloud, n_reclassified, iou_ground_before, rmse_before, iou_ground_after, rmse_after FROM n LEFT JOIN b USING (cloud) LEFT JOIN a USING (cloud) LEFT JOIN ib USING (cloud) LEFT JOIN ia USING (cloud)""")
def t6(spark, sf):
    return m.refine_report(scored(spark, sf), 2.0).select("cloud", "n_reclassified", *r(["iou_ground_before", "rmse_before", "iou_ground_after", "rmse_after"]))
