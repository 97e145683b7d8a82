"""Queries of the projection and catalog operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from terraframe.operators import catalog as c
from terraframe.operators import project as p
from terraframe.plans.registry import query
from terraframe.sources.views import CATALOG, POINTS_L, POINTS_O, catalog, points_l, points_o

PO, PL, CAT = f"({POINTS_O}) AS po", f"({POINTS_L}) AS pl", f"({CATALOG}) AS cat"
GRID = f"(SELECT *, CAST(floor((x - min(x) OVER (PARTITION BY cloud)) / 2) AS BIGINT) AS gx, CAST(floor((y - min(y) OVER (PARTITION BY cloud)) / 2) AS BIGINT) AS gy, CAST(floor((z - min(z) OVER (PARTITION BY cloud)) / 2) AS BIGINT) AS gz FROM {PO}) AS g"


def grid(spark, sf):
    return p.grid_coords(points_o(spark, sf), 2.0)


@query("p1_map_labels", f"SELECT pid, cls, CAST(CASE WHEN cls IN (0, 1) THEN 2 WHEN cls IN (2, 9) THEN 1 ELSE 0 END AS INTEGER) AS label FROM {PO}")
def p1(spark, sf):
    return p.map_labels(points_o(spark, sf)).select("pid", "cls", "label")


@query("p2_return_ratio", f"SELECT cloud, nret, rnum, count(*) AS n, rnum / greatest(nret, 1) AS ret_ratio FROM {PL} GROUP BY cloud, nret, rnum")
def p2(spark, sf):
    return p.return_ratio(points_l(spark, sf)).groupBy("cloud", "nret", "rnum", "ret_ratio").agg(F.count("*").alias("n"))


@query("p3_log_intensity", f"SELECT pid, round(ln(1 + greatest(intensity, 0)), 9) AS log_intensity FROM {PO}")
def p3(spark, sf):
    return p.log_intensity(points_o(spark, sf)).select("pid", F.round("log_intensity", 9).alias("log_intensity"))


@query("p4_moments", f"SELECT pid, x / 10 * (x / 10) AS m_xx, y / 10 * (y / 10) AS m_yy, z / 10 * (z / 10) AS m_zz, x / 10 * (y / 10) AS m_xy, x / 10 * (z / 10) AS m_xz, y / 10 * (z / 10) AS m_yz FROM {PO}")
def p4(spark, sf):
    return p.moments(points_o(spark, sf), 10).select("pid", *[f"m_{k}" for k in ("xx", "yy", "zz", "xy", "xz", "yz")])


@query("p5_assemble_features", f"SELECT pid, CAST(8 AS INTEGER) AS dim, x AS f0, y AS f1, z AS f2, CAST(1 AS DOUBLE) AS f3, CAST(1 AS DOUBLE) AS f4, CAST(1 AS DOUBLE) AS f5, round(ln(1 + greatest(intensity, 0)), 9) AS f6, CAST(0 AS DOUBLE) AS f7 FROM {PO}")
def p5(spark, sf):
    spec = p.FeatureSpec(constant=True, nret=True, ret_ratio=True, intensity=True, height_above=True)
    out = p.assemble_features(p.log_intensity(points_o(spark, sf)), spec)
    return out.select("pid", F.size("features").alias("dim"), *[F.round(F.get("features", F.lit(i)), 9).alias(f"f{i}") if i == 6 else F.get("features", F.lit(i)).alias(f"f{i}") for i in range(p.feature_dim(spec))])


@query("p7_localise", f"SELECT pid, cloud, x - min(x) OVER w AS x, y - min(y) OVER w AS y, z - min(z) OVER w AS z, min(x) OVER w AS origin_x FROM {PO} WINDOW w AS (PARTITION BY cloud)")
def p7(spark, sf):
    return p.localise(points_o(spark, sf)).select("pid", "cloud", "x", "y", "z", "origin_x")


@query("p7_centre", f"SELECT pid, round(x - avg(x) OVER w, 6) AS x, round(y - avg(y) OVER w, 6) AS y, round(z - avg(z) OVER w, 6) AS z FROM {PO} WINDOW w AS (PARTITION BY cloud)")
def p7b(spark, sf):
    return p.centre(points_o(spark, sf)).select("pid", *[F.round(k, 6).alias(k) for k in "xyz"])


def morton_sql(a: str, b: str, d: str, depth: int = 16) -> str:
    bits = [f"((({v} >> {i}) & 1) << {3 * i + place})" for v, place in ((a, 2), (b, 1), (d, 0)) for i in range(depth)]
    return " | ".join(bits)


@query("p8_morton", f"SELECT pid, gx, gy, gz, {morton_sql('gx', 'gy', 'gz')} AS code, gx AS dx, gy AS dy, gz AS dz FROM {GRID}")
def p8(spark, sf):
    code = grid(spark, sf).withColumn("code", p.morton_encode(F.col("gx"), F.col("gy"), F.col("gz")))
    x, y, z = p.morton_decode(F.col("code"))
    return code.select("pid", "gx", "gy", "gz", "code", x.alias("dx"), y.alias("dy"), z.alias("dz"))


def hilbert_sql(bits: int) -> str:
    """code of gx, gy, gz, one nested SELECT a step of the transform."""
    src = f"(SELECT pid, gx, gy, gz, gx AS x, gy AS y, gz AS z FROM {GRID})"
    keep = "pid, gx, gy, gz"
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for a in "xyz":
            on = f"(({a} & {bit}) <> 0)"
            swap = f"(xor(x, {a}) & {low})"
            moved = {c: c for c in "xyz"}
            moved["x"] = f"CASE WHEN {on} THEN xor(x, {low}) ELSE xor(x, {swap}) END"
            if a != "x":
                moved[a] = f"CASE WHEN {on} THEN {a} ELSE xor({a}, {swap}) END"
            src = f"(SELECT {keep}, {', '.join(f'{v} AS {k}' for k, v in moved.items())} FROM {src} AS t)"
    src = f"(SELECT {keep}, x, xor(x, y) AS y, xor(x, xor(y, z)) AS z FROM {src} AS t)"
    flip = "0"
    for b in range(bits - 1, 0, -1):
        flip = f"xor({flip}, CASE WHEN (z & {1 << b}) <> 0 THEN {(1 << b) - 1} ELSE 0 END)"
    src = f"(SELECT {keep}, xor(x, t) AS x, xor(y, t) AS y, xor(z, t) AS z FROM (SELECT *, {flip} AS t FROM {src} AS f) AS t)"
    return f"SELECT {keep}, {morton_sql('x', 'y', 'z', bits)} AS code, gx AS dx, gy AS dy, gz AS dz FROM {src} AS h"


@query("p9_hilbert", hilbert_sql(6))
def p9(spark, sf):
    code = grid(spark, sf).withColumn("code", p.hilbert_encode(F.col("gx"), F.col("gy"), F.col("gz"), 6))
    back = p.hilbert_decode(F.col("code"), 6)
    return code.select("pid", "gx", "gy", "gz", "code", back["x"].alias("dx"), back["y"].alias("dy"), back["z"].alias("dz"))


@query("p10_serialize", f"SELECT pid, {morton_sql('gx', 'gy', 'gz', 8)} AS code_z, {morton_sql('gy', 'gx', 'gz', 8)} AS code_z_trans FROM {GRID}")
def p10(spark, sf):
    return p.serialize(grid(spark, sf), depth=8).select("pid", "code_z", "code_z_trans")


RANKED = f"(SELECT pid, cloud, row_number() OVER (PARTITION BY cloud ORDER BY {morton_sql('gx', 'gy', 'gz', 8)}, pid) - 1 AS r, count(*) OVER (PARTITION BY cloud) AS n FROM {GRID}) AS r"


@query("p11_order_rank", f"SELECT pid, cloud, r AS rank_code_z FROM {RANKED}")
def p11(spark, sf):
    return p.order_rank(p.serialize(grid(spark, sf), ("z",), 8), "code_z").select("pid", "cloud", "rank_code_z")


@query("p12_order_variants", f"SELECT pid, n - 1 - r AS rank_reversed, CASE WHEN r % 2 = 0 THEN r // 2 ELSE (n + 1) // 2 + r // 2 END AS rank_stride, n - 1 - CASE WHEN r % 2 = 0 THEN r // 2 ELSE (n + 1) // 2 + r // 2 END AS rank_stride_reversed FROM {RANKED}")
def p12(spark, sf):
    ranked = p.order_rank(p.serialize(grid(spark, sf), ("z",), 8), "code_z")
    return p.order_variants(ranked, "rank_code_z").select("pid", "rank_reversed", "rank_stride", "rank_stride_reversed")


@query("p13_window_encoding", f"SELECT pid, gz / 32 AS we_z, (gx // 16) / 64 AS we0_x, (gy // 16) / 64 AS we0_y, (gx % 16) / 16 AS we0_in_x, (gy % 16) / 16 AS we0_in_y, ((gx + 8) // 16) / 64 AS we1_x, ((gy + 8) // 16) / 64 AS we1_y, ((gx + 8) % 16) / 16 AS we1_in_x, ((gy + 8) % 16) / 16 AS we1_in_y FROM {GRID}")
def p13(spark, sf):
    return p.window_encoding(grid(spark, sf)).select("pid", "we_z", *[f"we{k}{part}_{a}" for k in "01" for part in ("", "_in") for a in "xy"])


@query("p14_pack_key", f"SELECT pid, (((dense_rank() OVER (ORDER BY cloud) - 1) * (max(gx) OVER () - min(gx) OVER () + 1) + gx - min(gx) OVER ()) * (max(gy) OVER () - min(gy) OVER () + 1) + gy - min(gy) OVER ()) * (max(gz) OVER () - min(gz) OVER () + 1) + gz - min(gz) OVER () AS packed FROM {GRID}")
def p14(spark, sf):
    return p.pack_key(grid(spark, sf)).select("pid", "packed")


@query("p15_crop_window", f"SELECT pid, x, y FROM {PO} WHERE x >= 10 AND x < 30 AND y >= 15 AND y < 35")
def p15(spark, sf):
    return p.crop_window(points_o(spark, sf), 20, 20, 25).select("pid", "x", "y")


@query("p16_squash_clip", f"SELECT pid, round(2 + 3 / (1 + exp(-z)), 9) AS squashed, least(greatest(z, 1), 4) AS clipped FROM {PO}")
def p16(spark, sf):
    return points_o(spark, sf).select("pid", F.round(p.squash(F.col("z"), 2, 5), 9).alias("squashed"), p.clip(F.col("z"), 1, 4).alias("clipped"))


@query("p17_nice_round", f"SELECT pid, CASE WHEN intensity <= 0 THEN 1 ELSE pow(10, floor(log10(intensity))) * CASE WHEN intensity / pow(10, floor(log10(intensity))) >= 5 THEN 5 WHEN intensity / pow(10, floor(log10(intensity))) >= 2 THEN 2 ELSE 1 END END AS nice FROM {PO}")
def p17(spark, sf):
    return points_o(spark, sf).select("pid", p.nice_round(F.col("intensity")).alias("nice"))


NAMED = f"""(SELECT *, CASE WHEN token IS NULL THEN NULL WHEN token LIKE 'NZ%' THEN 2000 + CAST(substr(token, 3, 2) AS INTEGER) ELSE CAST(substr(token, 1, 4) AS INTEGER) END AS start_year,
  lower(replace(trim(regexp_replace(CASE WHEN token IS NULL THEN survey ELSE replace(survey, token, '') END, '[^A-Za-z0-9]+', ' ', 'g')), ' ', '_')) AS area
 FROM (SELECT *, coalesce(nullif(regexp_extract(survey, '((?:19|20)\\d{{2}}-(?:19|20)\\d{{2}})', 1), ''), nullif(regexp_extract(survey, '((?:19|20)\\d{{2}})', 1), ''), nullif(regexp_extract(survey, '(NZ\\d{{2}})', 1), '')) AS token FROM {CAT}) AS t) AS named"""


def named(spark, sf):
    return c.parse_survey_name(catalog(spark, sf))


@query("c1_parse_survey_name", f"SELECT tile_id, survey, start_year, area FROM {NAMED}")
def c1(spark, sf):
    return named(spark, sf).select("tile_id", "survey", "start_year", "area")


GRIDDED = f"""(SELECT *, CAST(regexp_extract(tile, '^PNOA_(\\d{{4}})_', 1) AS INTEGER) AS tile_year, lower(replace(regexp_extract(tile, '^PNOA_\\d{{4}}_([A-Za-z-]+)_', 1), '-', '_')) AS region,
  CAST(regexp_extract(tile, '_(\\d+)-(\\d+)_', 1) AS BIGINT) AS east, CAST(regexp_extract(tile, '_(\\d+)-(\\d+)_', 2) AS BIGINT) AS north FROM {CAT}) AS gridded"""


def gridded(spark, sf):
    return c.parse_grid_tile(catalog(spark, sf))


@query("c2_parse_grid_tile", f"SELECT tile_id, tile_year, region, east, north FROM {GRIDDED}")
def c2(spark, sf):
    return gridded(spark, sf).select("tile_id", "tile_year", "region", "east", "north")


@query("c3_parse_en_region", f"SELECT tile_id, CAST(regexp_extract(tile, '(\\d+)\\D+(\\d+)\\D*$', 1) AS BIGINT) AS e, CAST(regexp_extract(tile, '(\\d+)\\D+(\\d+)\\D*$', 2) AS BIGINT) AS n, regexp_replace(regexp_extract(tile, '^(.*?)\\d+\\D+\\d+\\D*$', 1), '[-_. ]+$', '') AS en_region FROM {CAT}")
def c3(spark, sf):
    return c.parse_en_region(catalog(spark, sf), "tile").select("tile_id", "e", "n", "en_region")


@query("c4_region_of", f"SELECT tile_id, regexp_replace(regexp_replace(survey, '\\d{{3,}}.*$', ''), '[-_. ]+$', '') AS region_of FROM {CAT}")
def c4(spark, sf):
    return c.region_of(catalog(spark, sf), "survey").select("tile_id", "region_of")


@query("c5_spatial_key", f"SELECT tile_id, replace(tile, concat('_', tile_year, '_'), '_') AS spatial_key FROM {GRIDDED}")
def c5(spark, sf):
    return c.spatial_key(gridded(spark, sf), "tile", "tile_year").select("tile_id", "spatial_key")


@query("c6_pair_surveys", f"""WITH s AS (SELECT DISTINCT survey, start_year, area FROM {NAMED} WHERE start_year IS NOT NULL AND lower(survey) LIKE '%nz%'),
 l AS (SELECT area, survey AS cur, start_year AS cur_year, lag(survey) OVER w AS prev, lag(start_year) OVER w AS prev_year FROM s WINDOW w AS (PARTITION BY area ORDER BY start_year, survey))
 SELECT * FROM l WHERE prev IS NOT NULL AND cur_year <> prev_year""")
def c6(spark, sf):
    return c.pair_surveys(catalog(spark, sf))


@query("c7_density_band", f"""WITH k AS (SELECT *, row_number() OVER (PARTITION BY survey ORDER BY md5(CAST(tile_id AS VARCHAR)), tile_id) AS k FROM {NAMED} WHERE start_year >= 2012)
 SELECT survey, area, start_year, quantile_cont(density, 0.5) AS density, count(*) AS n_tiles FROM k WHERE k <= 6 GROUP BY ALL HAVING quantile_cont(density, 0.5) BETWEEN 3 AND 7""")
def c7(spark, sf):
    return c.density_band(catalog(spark, sf), 3, 7, 2012)


@query("c8_match_twins", f"""WITH k AS (SELECT *, replace(tile, concat('_', tile_year, '_'), '_') AS spatial_key FROM {GRIDDED})
 SELECT c.tile_id, c.tile, m.prev_tile FROM k c JOIN (SELECT spatial_key, min(tile) AS prev_tile FROM k WHERE tile_year = 2010 GROUP BY 1) m USING (spatial_key) WHERE c.tile_year = 2011""")
def c8(spark, sf):
    keyed = c.spatial_key(gridded(spark, sf), "tile", "tile_year")
    return c.match_twins(keyed.filter("tile_year = 2011"), keyed.filter("tile_year = 2010")).select("tile_id", "tile", "prev_tile")


@query("c9_match_grid", f"""WITH k AS (SELECT * FROM {GRIDDED}), m AS (SELECT c.tile_id, count(*) AS n_prev, min(p.tile) AS first_prev FROM k c JOIN k p USING (east, north) WHERE c.tile_year = 2011 AND p.tile_year = 2010 GROUP BY 1)
 SELECT tile_id, CAST(n_prev AS INTEGER) AS n_prev, first_prev FROM m""")
def c9(spark, sf):
    rows = gridded(spark, sf)
    out = c.match_grid(rows.filter("tile_year = 2011"), rows.filter("tile_year = 2010"))
    return out.select("tile_id", F.size("prev_tiles").alias("n_prev"), F.get("prev_tiles", F.lit(0)).alias("first_prev"))


@query("c9_unmatched", f"WITH k AS (SELECT * FROM {GRIDDED}) SELECT count(*) AS n_unmatched FROM k c WHERE tile_year = 2011 AND NOT EXISTS (SELECT 1 FROM k p WHERE p.tile_year = 2010 AND p.east = c.east AND p.north = c.north)")
def c9b(spark, sf):
    rows = gridded(spark, sf)
    return c.unmatched(rows.filter("tile_year = 2011"), rows.filter("tile_year = 2010"), ["east", "north"])


@query("c10_match_stem", f"""WITH a AS (SELECT concat('cur/t', tile_id % 300, '.copc.laz') AS path, tile_id FROM {CAT}), b AS (SELECT DISTINCT concat('r/t', tile_id % 200, '.tif') AS path FROM {CAT}),
 m AS (SELECT regexp_extract(path, '/([^.]*)', 1) AS stem, min(path) AS other_path FROM b GROUP BY 1) SELECT tile_id, path, other_path FROM a LEFT JOIN m ON regexp_extract(path, '/([^.]*)', 1) = stem""")
def c10(spark, sf):
    cat = catalog(spark, sf)
    name = lambda n, a, b: F.concat(F.lit(a), (F.col("tile_id") % n).cast("string"), F.lit(b))
    return c.match_stem(cat.select("tile_id", name(300, "cur/t", ".copc.laz").alias("path")), cat.select(name(200, "r/t", ".tif").alias("path")).distinct()).select("tile_id", "path", "other_path")


@query("c11_match_extent", f"""WITH b AS (SELECT tile_id, tile_id % 3 AS epsg, tile_year, min_x, min_y, min_x + 40 AS max_x, min_y + 40 AS max_y FROM {GRIDDED})
 SELECT a.tile_id, b.tile_id AS raster_id, a.epsg <> b.epsg AS epsg_differs FROM b a JOIN b ON a.tile_year = 2011 AND b.tile_year = 2010 AND a.min_x <= b.max_x AND b.min_x <= a.max_x AND a.min_y <= b.max_y AND b.min_y <= a.max_y""")
def c11(spark, sf):
    boxes = gridded(spark, sf).selectExpr("tile_id", "tile_id % 3 AS epsg", "tile_year", "min_x", "min_y", "min_x + 40 AS max_x", "min_y + 40 AS max_y")
    return c.match_extent(boxes.filter("tile_year = 2011"), boxes.filter("tile_year = 2010").withColumnRenamed("tile_id", "raster_id"), 100.0, "tile_id", "raster_id")


#: The round-robin plan, a tile a step: whether the chunk of a tile is stopped, the pass took anything, and what is left.
ROUND_ROBIN = f"""WITH RECURSIVE n AS (SELECT area, tile_id, size, dense_rank() OVER (PARTITION BY area ORDER BY survey) AS pair_rank, row_number() OVER (PARTITION BY survey ORDER BY tile_id) AS position FROM {NAMED} WHERE start_year IS NOT NULL),
 o AS (SELECT row_number() OVER (ORDER BY (position - 1) // 6, pair_rank, area, position, tile_id, size) AS i, CAST((position - 1) // 6 AS BIGINT) AS visit, area || ':' || pair_rank || ':' || (position - 1) // 6 AS chunk, tile_id, size FROM n),
 s(i, left_over, stopped, visit, took, ended, tile) AS (SELECT CAST(0 AS BIGINT), CAST(500000 AS BIGINT), '', CAST(-1 AS BIGINT), TRUE, FALSE, CAST(NULL AS VARCHAR)
  UNION ALL SELECT i, CASE WHEN fits THEN left_over - size ELSE left_over END, CASE WHEN NOT fits AND NOT done THEN chunk ELSE stopped END, visit, fits OR (took AND NOT turned), done, CASE WHEN fits THEN CAST(tile_id AS VARCHAR) END FROM (
   SELECT *, NOT done AND stopped <> chunk AND size <= left_over AS fits FROM (SELECT o.i, s.left_over, s.stopped, o.visit, s.took, o.visit <> s.visit AS turned, s.ended OR (o.visit <> s.visit AND NOT s.took) AS done, o.chunk, o.tile_id, o.size FROM s JOIN o ON o.i = s.i + 1) AS a) AS b)
 SELECT CAST(row_number() OVER (ORDER BY i) - 1 AS INTEGER) AS pick, tile FROM s WHERE tile IS NOT NULL"""


@query("c12_plan_round_robin", ROUND_ROBIN)
def c12(spark, sf):
    rows = named(spark, sf).filter("start_year IS NOT NULL").select("area", F.dense_rank().over(c.Window.partitionBy("area").orderBy("survey")).alias("pair_rank"), F.row_number().over(c.Window.partitionBy("survey").orderBy("tile_id")).alias("position"), F.col("tile_id").alias("tile"), "size")
    return c.plan_round_robin(rows, 500_000)


@query("c13_plan_first_fit", f"""WITH RECURSIVE o AS (SELECT tile_id, size, row_number() OVER (ORDER BY md5(concat('4:', tile_id)), CAST(tile_id AS VARCHAR)) AS i FROM {CAT}), s(i, left_over, tile, size) AS (SELECT CAST(0 AS BIGINT), CAST(300000 AS BIGINT), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT)
  UNION ALL SELECT o.i, CASE WHEN o.size <= left_over THEN left_over - o.size ELSE left_over END, CASE WHEN o.size <= left_over THEN CAST(tile_id AS VARCHAR) END, CAST(o.size AS BIGINT) FROM s JOIN o ON o.i = s.i + 1)
 SELECT tile, size FROM s WHERE tile IS NOT NULL""")
def c13(spark, sf):
    return c.plan_first_fit(catalog(spark, sf).select(F.col("tile_id").alias("tile"), "size"), 300_000, 4)


@query("c13_plan_prefix", f"SELECT tile, size, CAST(total AS BIGINT) AS total FROM (SELECT tile_id AS tile, size, sum(size) OVER (ORDER BY md5(concat('4:', tile_id)), tile_id) AS total FROM {CAT}) AS s WHERE total <= 300000")
def c13b(spark, sf):
    return c.plan_prefix(catalog(spark, sf).select(F.col("tile_id").alias("tile"), "size"), 300_000, 4)


@query("c14_plan_dem_pairs", f"""WITH n AS (SELECT * FROM {NAMED} WHERE start_year IS NOT NULL), s AS (SELECT DISTINCT area, start_year FROM n),
 p AS (SELECT area, start_year AS cur_year, lag(start_year) OVER (PARTITION BY area ORDER BY start_year) AS prev_year FROM s),
 k AS (SELECT p.area, cur_year, prev_year, tile_id, size, row_number() OVER (PARTITION BY p.area, cur_year ORDER BY tile_id) AS k FROM p JOIN n ON n.area = p.area AND n.start_year = p.prev_year),
 t AS (SELECT *, sum(size) OVER (ORDER BY area, cur_year, k) AS total FROM k WHERE k <= 8)
 SELECT area, cur_year, prev_year, tile_id, size, CAST(total AS BIGINT) AS total FROM t WHERE total <= 400000""")
def c14(spark, sf):
    return c.plan_dem_pairs(named(spark, sf).filter("start_year IS NOT NULL").select("area", "start_year", "tile_id", "size"), 400_000)


@query("c15_year_from_collection", f"SELECT tile_id, CASE WHEN tile_id % 3 = 0 THEN CAST(2000 + tile_id % 20 AS INTEGER) ELSE coalesce(CAST(nullif(regexp_extract(survey, '((?:19|20)\\d{{2}})', 1), '') AS INTEGER), 0) END AS year FROM {CAT}")
def c15(spark, sf):
    js = F.when(F.col("tile_id") % 3 == 0, F.concat(F.lit('{"extent":{"temporal":{"interval":[["'), (2000 + F.col("tile_id") % 20).cast("string"), F.lit('-05-01T00:00:00Z",null]]}}}'))).otherwise(F.lit('{"extent":{}}'))
    return c.year_from_collection(catalog(spark, sf).withColumn("json", js), "json", "survey").select("tile_id", "year")


@query("c16_assign_splits", f"SELECT cloud, CASE WHEN k <= round_even(n * 0.2, 0) THEN 'test' WHEN k <= round_even(n * 0.2, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'train' END AS split FROM (SELECT cloud, row_number() OVER (ORDER BY md5(concat('0:', cloud)), cloud) AS k, count(*) OVER () AS n FROM (SELECT DISTINCT cloud FROM {PL}) AS d) AS s")
def c16(spark, sf):
    return c.assign_splits(points_l(spark, sf).select("cloud").distinct(), 0.1, 0.2)


@query("c17_hash_split", f"SELECT cloud, u, CASE WHEN u < 0.2 THEN 'test' WHEN u < 0.2 + 0.1 THEN 'val' ELSE 'train' END AS split FROM (SELECT cloud, CAST(('0x' || substr(md5(concat('7:', cloud)), 1, 12)) AS BIGINT) / pow(2, 48) AS u FROM (SELECT DISTINCT cloud FROM {PL}) AS d) AS s")
def c17(spark, sf):
    return c.hash_split(points_l(spark, sf).select("cloud").distinct(), 7, 0.1, 0.2)


@query("c18_scan_tiles", f"SELECT cloud, count(*) AS n_points, min(x) AS origin_x, min(y) AS origin_y, min(z) AS origin_z, CAST(regexp_extract(cloud, '(\\d+)_(\\d+)$', 1) AS BIGINT) AS e, CAST(regexp_extract(cloud, '(\\d+)_(\\d+)$', 2) AS BIGINT) AS n, 'CL' AS en_region FROM {PL} GROUP BY cloud")
def c18(spark, sf):
    return c.scan_tiles(points_l(spark, sf))


TILES = f"(SELECT region, east AS e, north AS n, sum(size) AS n_points FROM {GRIDDED} GROUP BY ALL) AS tiles"
COMPONENTS = f"""WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY e, n) AS id FROM {TILES}),
 se AS (SELECT region, coalesce(min(g), 1) AS se FROM (SELECT region, e - lag(e) OVER (PARTITION BY region ORDER BY e) AS g FROM (SELECT DISTINCT region, e FROM t) AS d) AS q GROUP BY region),
 sn AS (SELECT region, coalesce(min(g), 1) AS sn FROM (SELECT region, n - lag(n) OVER (PARTITION BY region ORDER BY n) AS g FROM (SELECT DISTINCT region, n FROM t) AS d) AS q GROUP BY region),
 edge AS (SELECT a.region, a.id, b.id AS other FROM t a JOIN se USING (region) JOIN sn USING (region) JOIN t b ON a.region = b.region AND ((abs(a.e - b.e) = se AND a.n = b.n) OR (abs(a.n - b.n) = sn AND a.e = b.e))),
 reach AS (SELECT region, id, id AS root FROM t UNION SELECT edge.region, edge.other, reach.root FROM reach JOIN edge ON reach.region = edge.region AND reach.id = edge.id),
 comp AS (SELECT region, e, n, CAST(n_points AS BIGINT) AS n_points, (SELECT min(root) FROM reach r WHERE r.region = t.region AND r.id = t.id) AS component FROM t)"""


def tiles(spark, sf):
    return gridded(spark, sf).withColumnsRenamed({"east": "e", "north": "n"}).groupBy("region", "e", "n").agg(F.sum("size").alias("n_points"))


@query("c19_grid_components", f"{COMPONENTS} SELECT region, e, n, component FROM comp")
def c19(spark, sf):
    return c.grid_components(tiles(spark, sf)).select("region", "e", "n", "component")


@query("c20_grid_blocks", f"""{COMPONENTS}, d AS (SELECT *, pow(e - avg(e) OVER w, 2) + pow(n - avg(n) OVER w, 2) AS d FROM comp WINDOW w AS (PARTITION BY region, component)),
 k AS (SELECT *, row_number() OVER (PARTITION BY region, component ORDER BY d, e, n) AS k FROM d)
 SELECT concat(region, '_', component) AS block, count(*) AS n_tiles, CAST(sum(n_points) AS BIGINT) AS n_points FROM k WHERE k <= 6 GROUP BY 1 ORDER BY n_points DESC, block LIMIT 10""")
def c20(spark, sf):
    return c.grid_blocks(c.grid_components(tiles(spark, sf)), 6, 10)


@query("s7_build_manifest", f"""WITH f AS (SELECT region AS project, concat(tile_year, '/', 't', east, '_', north, '.laz') AS path, tile_year FROM {GRIDDED}), cur AS (SELECT DISTINCT project, path FROM f WHERE tile_year = 2011), prev AS (SELECT DISTINCT project, path FROM f WHERE tile_year = 2010)
 SELECT cur.project AS region, prev.path IS NOT NULL AS twinned, CAST(count(*) AS INTEGER) AS n_clouds, CAST(count(prev.path) AS INTEGER) AS n_prev, min(cur.path) AS first_cloud FROM cur LEFT JOIN prev ON cur.project = prev.project AND substr(cur.path, 6) = substr(prev.path, 6) GROUP BY 1, 2""")
def s7(spark, sf):
    files = gridded(spark, sf).select(F.col("region").alias("project"), F.concat(F.col("tile_year").cast("string"), F.lit("/t"), F.col("east").cast("string"), F.lit("_"), F.col("north").cast("string"), F.lit(".laz")).alias("path"), "tile_year")
    out = c.build_manifest(files.filter("tile_year = 2011").select("project", "path").distinct(), files.filter("tile_year = 2010").select("project", "path").distinct())
    return out.select("region", "twinned", F.size("clouds").alias("n_clouds"), F.size("prev_clouds").alias("n_prev"), F.get("clouds", F.lit(0)).alias("first_cloud"))


@query("s8_pending", f"SELECT tile_id, size FROM {CAT} WHERE NOT (tile_id % 3 = 0 AND tile_id % 2 = 0)")
def s8(spark, sf):
    rows = catalog(spark, sf).select("tile_id", "size")
    done = rows.filter("tile_id % 3 = 0").withColumn("size", F.when(F.col("tile_id") % 2 == 0, F.col("size")).otherwise(0))
    return c.pending(rows, done, "tile_id")


@query("s10_flatten_jobs", f"SELECT survey AS region, CAST(row_number() OVER (PARTITION BY survey ORDER BY tile_id) - 1 AS INTEGER) AS pos, CAST(tile_id AS VARCHAR) AS cloud, CASE WHEN row_number() OVER (PARTITION BY survey ORDER BY tile_id) <= 2 THEN concat('p', tile_id) ELSE 'whole' END AS prior, CAST(NULL AS VARCHAR) AS dtm FROM {CAT}")
def s10(spark, sf):
    listed = catalog(spark, sf).groupBy(F.col("survey").alias("region")).agg(F.transform(F.array_sort(F.collect_list("tile_id")), lambda t: t.cast("string")).alias("clouds"))
    manifest = listed.withColumns({"prior_rasters": F.transform(F.slice("clouds", 1, 2), lambda t: F.concat(F.lit("p"), t)), "prior_raster": F.lit("whole"), "dtms": F.array().cast("array<string>"), "dtm": F.lit(None).cast("string")})
    return c.flatten_jobs(manifest)


