"""Queries of sampling, augmentation, scoring and voting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from terraframe.operators import metrics as m
from terraframe.operators import sample as s
from terraframe.operators import score as sc
from terraframe.operators import voxel as v
from terraframe.plans.aggregates import r
from terraframe.plans.neighbourhood import D3
from terraframe.plans.projection import PL, PO
from terraframe.plans.registry import query
from terraframe.sources.views import SCORED, points_l, points_o, scored

SC = f"({SCORED}) AS sc"


def u_sql(seed: str, *cols: str) -> str:
    return "CAST(('0x' || substr(md5(concat_ws(':', '" + seed + "', " + ", ".join(cols) + ")), 1, 12)) AS BIGINT) / pow(2, 48)"


@query("b1_weighted_draws", f"""WITH i AS (SELECT pid AS item, sum(1 + pid % 9) OVER (ORDER BY pid) AS hi, 1 + pid % 9 AS w, sum(1 + pid % 9) OVER () AS total FROM {PO}), d AS (SELECT pid AS draw, (pid * 7919 % 100003) / 100003 AS u FROM {PO})
 SELECT draw, item FROM d JOIN i ON u >= CAST(hi - w AS DOUBLE) / total AND u < CAST(hi AS DOUBLE) / total""")
def b1(spark, sf):
    rows = points_o(spark, sf)
    items = rows.select(F.col("pid").alias("item"), (1 + F.col("pid") % 9).alias("w"))
    draws = rows.select(F.col("pid").alias("draw"), ((F.col("pid") * 7919 % 100003) / 100003).alias("u"))
    return s.weighted_draws(items, "w", draws)


@query("b2_region_weights", f"SELECT pid, round(1 / (count(*) OVER (PARTITION BY cloud) * (SELECT count(DISTINCT cloud) FROM {PO})), 12) AS weight FROM {PO}")
def b2(spark, sf):
    return s.region_weights(points_o(spark, sf)).select("pid", F.round("weight", 12).alias("weight"))


@query("b3_fixed_subset", f"SELECT pid FROM {PO} ORDER BY md5(concat_ws(':', 'seed', pid)), pid LIMIT 500")
def b3(spark, sf):
    return s.fixed_subset(points_o(spark, sf), 500, "seed").select("pid")


@query("b3_uniform_draws", f"WITH i AS (SELECT pid, row_number() OVER (ORDER BY pid) - 1 AS k, count(*) OVER () AS n FROM {PO}), d AS (SELECT draw, {u_sql('seed', 'draw')} AS u FROM range(2000) AS t(draw)) SELECT draw, pid FROM d JOIN i ON k = CAST(floor(u * n) AS BIGINT)")
def b3b(spark, sf):
    return s.uniform_draws(points_o(spark, sf), 2000, "seed")


@query("b4_even_subset", f"WITH k AS (SELECT pid, cloud, row_number() OVER (PARTITION BY cloud ORDER BY pid) - 1 AS p, count(*) OVER (PARTITION BY cloud) AS n FROM {PO}) SELECT pid, cloud FROM k WHERE p IN (SELECT CAST(round_even(i * (n - 1) / 39, 0) AS BIGINT) FROM range(40) AS a(i))")
def b4(spark, sf):
    return s.even_subset(points_o(spark, sf), 40).select("pid", "cloud")


@query("b5_pack_batches", f"""WITH RECURSIVE o AS (SELECT survey_year AS shard, cloud AS item, count(*) AS n, row_number() OVER (PARTITION BY survey_year ORDER BY cloud) AS i FROM {PL} GROUP BY survey_year, cloud),
 s AS (SELECT shard, item, n, i, n AS used, CAST(0 AS BIGINT) AS batch FROM o WHERE i = 1 UNION ALL SELECT o.shard, o.item, o.n, o.i, CASE WHEN s.used + o.n > 2500 THEN o.n ELSE s.used + o.n END, CASE WHEN s.used + o.n > 2500 THEN s.batch + 1 ELSE s.batch END FROM s JOIN o ON o.shard = s.shard AND o.i = s.i + 1)
 SELECT shard, item, n, batch FROM s""")
def b5(spark, sf):
    items = points_l(spark, sf).groupBy("survey_year", "cloud").agg(F.count("*").alias("n")).select(F.col("survey_year").alias("shard"), F.col("cloud").alias("item"), "n")
    return s.pack_batches(items, 2500)


@query("b6_mix_pairs", f"SELECT cloud, CAST((row_number() OVER (ORDER BY cloud) - 1) // 2 AS BIGINT) AS scene FROM (SELECT DISTINCT cloud FROM {PL}) AS c")
def b6(spark, sf):
    return s.mix_pairs(points_l(spark, sf).select("cloud").distinct())


@query("b7_stride_sample", f"SELECT pid FROM (SELECT pid, row_number() OVER (PARTITION BY cloud ORDER BY pid) - 1 AS p, greatest(count(*) OVER (PARTITION BY cloud) // 300, 1) AS s FROM {PO}) AS k WHERE p % s = 0")
def b7(spark, sf):
    return s.stride_sample(points_o(spark, sf), 300).select("pid")


PLANAR = f"pr AS (SELECT cloud, {u_sql('g/angle', 'cloud')} * 6.283185307179586 AS angle, 0.9 + {u_sql('g/sx', 'cloud')} * 0.2 AS sx, 0.9 + {u_sql('g/sy', 'cloud')} * 0.2 AS sy, 0.9 + {u_sql('g/sz', 'cloud')} * 0.2 AS sz, CASE WHEN {u_sql('g/fx', 'cloud')} < 0.5 THEN -1 ELSE 1 END AS fx, CASE WHEN {u_sql('g/fy', 'cloud')} < 0.5 THEN -1 ELSE 1 END AS fy, avg(x) AS px, avg(y) AS py FROM {PO} GROUP BY cloud)"


@query("g1_augment_planar", f"WITH {PLANAR}, d AS (SELECT *, (x - px) * fx * sx AS dx, (y - py) * fy * sy AS dy FROM {PO} JOIN pr USING (cloud)) SELECT pid, round(px + cos(angle) * dx - sin(angle) * dy, 6) AS x, round(py + sin(angle) * dx + cos(angle) * dy, 6) AS y, round(z * sz, 6) AS z FROM d")
def g1(spark, sf):
    rows = points_o(spark, sf)
    return s.augment_planar(rows, s.planar_params(rows.select("cloud").distinct(), "g")).select("pid", *r("xyz"))


TILT = f"tl AS (SELECT DISTINCT cloud, CASE WHEN {u_sql('t/x?', 'cloud')} < 0.5 THEN (2 * {u_sql('t/x', 'cloud')} - 1) * 0.05 ELSE 0 END AS tx, CASE WHEN {u_sql('t/y?', 'cloud')} < 0.5 THEN (2 * {u_sql('t/y', 'cloud')} - 1) * 0.05 ELSE 0 END AS ty FROM {PO})"


@query("g2_augment_tilt", f"WITH {TILT}, a AS (SELECT pid, x, cos(tx) * y - sin(tx) * z AS y, sin(tx) * y + cos(tx) * z AS z, ty FROM {PO} JOIN tl USING (cloud)) SELECT pid, round(cos(ty) * x + sin(ty) * z, 6) AS x, round(y, 6) AS y, round(cos(ty) * z - sin(ty) * x, 6) AS z FROM a")
def g2(spark, sf):
    rows = points_o(spark, sf)
    return s.augment_tilt(rows, s.tilt_params(rows.select("cloud").distinct(), "t")).select("pid", *r("xyz"))


def gauss_sql(seed: str, *cols: str) -> str:
    return f"sqrt(-2 * ln(1 - {u_sql(seed + '/1', *cols)})) * cos(6.283185307179586 * {u_sql(seed + '/2', *cols)})"


JITTER = ", ".join(f"round({c} + least(greatest({gauss_sql(f'j/{c}', 'pid')} * 0.01, -0.02), 0.02), 6) AS {c}" for c in "xyz")


@query("g3_augment_jitter", f"SELECT pid, {JITTER} FROM {PO}")
def g3(spark, sf):
    return s.augment_jitter(points_o(spark, sf), 0.01, 0.02, "j").select("pid", *r("xyz"))


def blur_sql(n: int, axis: str, others: str) -> str:
    return f"b{n + 1} AS (SELECT cloud, ix, iy, iz, " + ", ".join(f"sum(n{c}) OVER w / 3 AS n{c}" for c in "xyz") + f" FROM b{n} WINDOW w AS (PARTITION BY cloud, {others} ORDER BY {axis} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"


BLURS = ", ".join(blur_sql(n, axis, others) for n, (axis, others) in enumerate((("ix", "iy, iz"), ("iy", "ix, iz"), ("iz", "ix, iy")) * 2))


def elastic_sql(gran: float, mag: float, most: int = 128) -> str:
    """The grid starts a node before the corner; its spacing is wider than gran where an axis would have more than `most` nodes."""
    part = lambda c, d: f"CASE {d} WHEN 1 THEN f{c} - floor(f{c}) ELSE 1 - f{c} + floor(f{c}) END"
    return f"""WITH e AS (SELECT cloud, min(x) AS lx, min(y) AS ly, min(z) AS lz, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez FROM {PO} GROUP BY cloud),
 g AS (SELECT *, greatest({gran}, greatest(ex, ey, ez) / {most - 3}) AS g FROM e),
 b0 AS (SELECT cloud, ix, iy, iz, {', '.join(f"{gauss_sql(f'e/{c}', 'cloud', 'ix', 'iy', 'iz')} AS n{c}" for c in 'xyz')} FROM g, range({most}) AS a(ix), range({most}) AS b(iy), range({most}) AS c(iz) WHERE ix < floor(ex / g) + 3 AND iy < floor(ey / g) + 3 AND iz < floor(ez / g) + 3),
 {BLURS},
 f AS (SELECT pid, p.cloud, x, y, z, (x - lx) / g + 1 AS fx, (y - ly) / g + 1 AS fy, (z - lz) / g + 1 AS fz FROM {PO.replace(' AS po', ' AS p')} JOIN g ON g.cloud = p.cloud),
 m AS (SELECT pid, {', '.join(f"sum({part('x', 'dx')} * {part('y', 'dy')} * {part('z', 'dz')} * n{c}) AS m{c}" for c in 'xyz').replace('CASE', '(CASE').replace('END', 'END)')} FROM f, range(2) AS a(dx), range(2) AS b(dy), range(2) AS c(dz), b6 WHERE b6.cloud = f.cloud AND ix = floor(fx) + dx AND iy = floor(fy) + dy AND iz = floor(fz) + dz GROUP BY pid)
 SELECT f.pid, {', '.join(f"round({c} + {mag} * m{c}, 6) AS {c}" for c in 'xyz')} FROM f JOIN m ON m.pid = f.pid"""


@query("g4_augment_elastic", elastic_sql(8.0, 0.4))
def g4(spark, sf):
    return s.augment_elastic(points_o(spark, sf), 8.0, 0.4, "e").select("pid", *r("xyz"))


@query("g4_augment_elastic_coarsened", elastic_sql(0.4, 0.4, 16))
def g4_coarse(spark, sf):
    return s.augment_elastic(points_o(spark, sf), 0.4, 0.4, "e", 16).select("pid", *r("xyz"))


WARP_CELLS = f"(SELECT CAST(substr(cloud, 4) AS INTEGER) AS patch_id, CAST(floor(y / 6) AS BIGINT) AS row, CAST(floor(x / 6) AS BIGINT) AS col, max(z) AS dtm, max(z) AS dsm, min(z) AS ndsm FROM {PO} GROUP BY ALL) AS wc"


@query("g5_warp_patch", f"""WITH c AS (SELECT * FROM {WARP_CELLS}), a AS (SELECT patch_id, row, col, least(greatest(4.5 - (cos(0.3) * (col - 4.5) + sin(0.3) * (row - 4.5)) / 1.1, 0), 9) AS fx, least(greatest(4.5 + (cos(0.3) * (row - 4.5) - sin(0.3) * (col - 4.5)) / 0.9, 0), 9) AS fy FROM c),
 k AS (SELECT patch_id, row, col, least(CAST(floor(fy) AS BIGINT) + i, 9) AS r, least(CAST(floor(fx) AS BIGINT) + j, 9) AS c, (CASE i WHEN 1 THEN fy - floor(fy) ELSE 1 - fy + floor(fy) END) * (CASE j WHEN 1 THEN fx - floor(fx) ELSE 1 - fx + floor(fx) END) AS w FROM a, range(2) AS p(i), range(2) AS q(j))
 SELECT k.patch_id, k.row, k.col, round(sum(w * c.dtm) * 2, 6) AS dtm, round(sum(w * c.ndsm), 6) AS ndsm FROM k JOIN c ON c.patch_id = k.patch_id AND c.row = k.r AND c.col = k.c GROUP BY k.patch_id, k.row, k.col""")
def g5(spark, sf):
    rows = points_o(spark, sf)
    patch = rows.groupBy(F.substring("cloud", 4, 4).cast("int").alias("patch_id"), F.floor(F.col("y") / 6).alias("row"), F.floor(F.col("x") / 6).alias("col")).agg(F.max("z").alias("dtm"), F.max("z").alias("dsm"), F.min("z").alias("ndsm"))
    params = patch.select("patch_id").distinct().withColumns({"angle": F.lit(0.3), "sx": F.lit(1.1), "sy": F.lit(0.9), "fx": F.lit(-1.0), "fy": F.lit(1.0), "sz": F.lit(2.0)})
    return s.warp_patch(patch, 10, params, ("dtm",), plain=("ndsm",)).select("patch_id", "row", "col", *r(["dtm", "ndsm"]))


@query("g6_random_dropout", f"WITH d AS (SELECT pid, cloud, {u_sql('d/cloud', 'cloud')} < 0.6 AND {u_sql('d/point', 'pid')} < 0.3 AS gone FROM {PO}), k AS (SELECT *, count(*) FILTER (NOT gone) OVER (PARTITION BY cloud) AS n FROM d) SELECT pid FROM k WHERE NOT gone OR n < 1500")
def g6(spark, sf):
    return s.random_dropout(points_o(spark, sf), 0.3, 0.6, 1500, "d").select("pid")


DISCS = f"""WITH b AS (SELECT cloud, count(*) AS n, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM {PO} GROUP BY cloud), c AS (SELECT *, greatest(sqrt(2) / 2 * 20 + 4, sqrt(1000 / (3.141592653589793 * (n / greatest((x1 - x0) * (y1 - y0), 1e-6))))) AS rc FROM b WHERE n > 1000),
 d AS (SELECT cloud, rc, row_number() OVER (PARTITION BY cloud ORDER BY i, j) AS job, x0 + (i + 0.5) * 20 AS cx, y0 + (j + 0.5) * 20 AS cy FROM c, range(5) AS p(i), range(5) AS q(j) WHERE i <= floor((x1 - x0) / 20) AND j <= floor((y1 - y0) / 20))
 SELECT p.cloud, job, pid, (x - cx) * (x - cx) + (y - cy) * (y - cy) <= (sqrt(2) / 2 * 20) * (sqrt(2) / 2 * 20) AS central FROM (SELECT * FROM {PO}) AS p JOIN d ON d.cloud = p.cloud AND (x - cx) * (x - cx) + (y - cy) * (y - cy) <= rc * rc
 UNION ALL SELECT p.cloud, 0, pid, TRUE FROM (SELECT * FROM {PO}) AS p JOIN b ON b.cloud = p.cloud WHERE b.n <= 1000"""


@query("v1_disc_jobs", DISCS)
def v1(spark, sf):
    return sc.disc_jobs(points_o(spark, sf), 20.0, 4.0, 1000, trim=False)


@query("v1_disc_jobs_trimmed", f"SELECT cloud, job, pid, central FROM (SELECT *, row_number() OVER (PARTITION BY cloud, job ORDER BY central DESC, md5(concat_ws(':', job, pid)), pid) AS k FROM ({DISCS}) AS d) AS t WHERE job = 0 OR k <= 1000")
def v1_trimmed(spark, sf):
    return sc.disc_jobs(points_o(spark, sf), 20.0, 4.0, 1000)


def height_rule(g: pd.DataFrame) -> pd.Series:
    """P(ground) by height above the slope."""
    return 1 / (1 + ((g["z"] - g["x"] / 20).abs() * 2))


@query("v2_score", f"SELECT pid, round(1 / (1 + abs(z - x / 20) * 2), 9) AS p_ground FROM {PO}")
def v2(spark, sf):
    return sc.score(points_o(spark, sf), height_rule).select("pid", F.round("p_ground", 9).alias("p_ground"))


VOTES = f"(SELECT cloud, pid // 2 AS pid, p_ground, 1 - p_ground AS p_other, pid % 5 > 0 AS central FROM {SC}) AS votes"


def votes(spark, sf):
    return scored(spark, sf).select("cloud", F.expr("pid div 2").alias("pid"), "p_ground", (1 - F.col("p_ground")).alias("p_other"), (F.col("pid") % 5 > 0).alias("central"))


@query("v3_soft_vote", f"SELECT cloud, pid, count(*) AS n_votes, round(avg(p_ground), 9) AS p_ground, CAST(CASE WHEN round(sum(p_ground), 9) > round(sum(p_other), 9) THEN 1 ELSE 0 END AS INTEGER) AS pred FROM {VOTES} WHERE central GROUP BY cloud, pid")
def v3(spark, sf):
    return sc.soft_vote(votes(spark, sf)).select("cloud", "pid", "n_votes", F.round("p_ground", 9).alias("p_ground"), F.when(F.round("s_ground", 9) > F.round("s_other", 9), 1).otherwise(0).alias("pred"))


@query("v4_coverage_backstop", f"""WITH k AS (SELECT * FROM {SC} WHERE pid % 6 > 0), n AS (SELECT * FROM (SELECT a.pid AS pid, b.p_ground, row_number() OVER (PARTITION BY a.cloud, a.pid ORDER BY {D3}, b.pid) AS k FROM (SELECT * FROM {SC} WHERE pid % 6 = 0) AS a JOIN k AS b ON a.cloud = b.cloud) AS t WHERE k = 1)
 SELECT pid, p_ground AS s_ground FROM k UNION ALL SELECT pid, p_ground FROM n""")
def v4(spark, sf):
    rows = scored(spark, sf)
    voted = rows.filter("pid % 6 > 0").select("cloud", "pid", (1 - F.col("p_ground")).alias("s_other"), F.col("p_ground").alias("s_ground"), F.lit(1).cast("long").alias("n_votes"))
    return sc.coverage_backstop(rows, voted).select("pid", "s_ground")


@query("v5_tta_average", f"WITH t AS (SELECT pid, cloud, x, y, z FROM {PO} UNION ALL SELECT pid, cloud, 60 - y, x, z FROM {PO} UNION ALL SELECT pid, cloud, 60 - x, 60 - y, z FROM {PO} UNION ALL SELECT pid, cloud, y, 60 - x, z FROM {PO}) SELECT pid, round(avg(1 / (1 + abs(z - x / 20) * 2)), 6) AS p_ground FROM t GROUP BY cloud, pid")
def v5(spark, sf):
    return sc.tta_average(sc.tta_scores(points_o(spark, sf), lambda d: sc.score(d, height_rule), 30.0, 30.0)).select("pid", *r(["p_ground"]))


@query("v6_fit_ground_classifier")
def v6(spark, sf):
    rows = scored(spark, sf).withColumn("height", F.col("z") - F.col("x") / 20)
    model, _ = sc.fit_ground_classifier(rows, ["height", "p_ground"], v.class_weights(rows))
    out = model.transform(rows).withColumn("pred", F.col("prediction").cast("int"))
    return m.segmentation_metrics(m.confusion(out, by=("cloud",)))
