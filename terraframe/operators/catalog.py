"""Corpus planning over survey catalogs: name parsing, pairing, matching, budgets, splits and tile graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraframe.functions.tables import running, written


def _first(col: Column, pattern: str, group: int = 1) -> Column:
    """A capture, null where the pattern does not match."""
    found = F.regexp_extract(col, pattern, group)
    return F.when(found != "", found)


def parse_survey_name(df: DataFrame, col: str = "survey") -> DataFrame:
    """start_year and area of a survey name: a year range first, else a year, else NZdd as 2000 + dd; area is the rest."""
    name = F.col(col)
    ranged, single, short = _first(name, r"((?:19|20)\d{2}-(?:19|20)\d{2})"), _first(name, r"((?:19|20)\d{2})"), _first(name, r"(NZ\d{2})")
    token = F.coalesce(ranged, single, short)
    year = F.when(ranged.isNotNull() | single.isNotNull(), F.substring(token, 1, 4).cast("int")).when(short.isNotNull(), F.substring(token, 3, 2).cast("int") + 2000)
    area = F.trim(F.regexp_replace(F.when(token.isNull(), name).otherwise(F.replace(name, token, F.lit(""))), "[^A-Za-z0-9]+", " "))
    return df.withColumns({"start_year": year, "area": F.lower(F.replace(area, F.lit(" "), F.lit("_")))})


def parse_grid_tile(df: DataFrame, col: str = "tile") -> DataFrame:
    """year, region, east and north of a national grid tile name; region es if it has none, nulls where it is no such name."""
    name, whole = F.col(col), r"^PNOA_(\d{4})_(?:([A-Za-z][A-Za-z-]*)_)?(\d+)-(\d+)_"
    return df.withColumns({
        "tile_year": _first(name, whole, 1).cast("int"),
        "region": F.when(_first(name, whole, 1).isNotNull(), F.coalesce(F.lower(F.replace(_first(name, whole, 2), F.lit("-"), F.lit("_"))), F.lit("es"))),
        "east": _first(name, whole, 3).cast("long"), "north": _first(name, whole, 4).cast("long"),
    })


def parse_en_region(df: DataFrame, col: str) -> DataFrame:
    """The last two integer runs as (e, n) and the prefix before them as en_region; (null, null, whole stem) with fewer runs."""
    name = F.col(col)
    runs = F.regexp_extract_all(name, F.lit(r"(\d+)"), 1)
    enough = F.size(runs) >= 2
    prefix = F.regexp_replace(F.regexp_extract(name, r"^(.*?)\d+\D+\d+\D*$", 1), r"^[-_. ]+|[-_. ]+$", "")
    return df.withColumns({
        "e": F.when(enough, F.try_element_at(runs, F.lit(-2)).cast("long")), "n": F.when(enough, F.try_element_at(runs, F.lit(-1)).cast("long")),
        "en_region": F.when(enough, F.when(prefix == "", "scene").otherwise(prefix)).otherwise(name),
    })


def region_of(df: DataFrame, col: str) -> DataFrame:
    """region_of: the name before its first run of three digits or more, less separators at its end."""
    return df.withColumn("region_of", F.regexp_replace(F.regexp_replace(F.col(col), r"\d{3,}.*$", ""), r"[-_. ]+$", ""))


def spatial_key(df: DataFrame, key: str, year: str) -> DataFrame:
    """spatial_key: the basename with its first _<year>_ made one underscore, so epochs of a tile share it."""
    base = F.regexp_replace(F.col(key), r"^.*/", "")
    mark = F.concat(F.lit("_"), F.col(year).cast("string"), F.lit("_"))
    at = F.call_function("instr", base, mark)
    return df.withColumn("spatial_key", F.when(at > 0, F.concat(F.substring(base, F.lit(1), at), F.substring(base, at + F.length(mark), F.length(base)))).otherwise(base))


def pair_surveys(df: DataFrame, name: str = "survey", within: str | None = "nz") -> DataFrame:
    """Each survey of an area with its predecessor in time; pairs of one year are left out."""
    named = parse_survey_name(df.select(name).distinct(), name).filter("start_year IS NOT NULL")
    if within:
        named = named.filter(F.lower(F.col(name)).contains(within))
    w = Window.partitionBy("area").orderBy("start_year", name)
    paired = named.select("area", F.col(name).alias("cur"), F.col("start_year").alias("cur_year"), F.lag(name).over(w).alias("prev"), F.lag("start_year").over(w).alias("prev_year"))
    return paired.filter("prev IS NOT NULL AND cur_year <> prev_year")


def density_band(df: DataFrame, lo: float, hi: float, min_year: int, n: int = 6, regions: list[str] | None = None) -> DataFrame:
    """Surveys from min_year on whose median tile density, over the n tiles of smallest MD5, is within lo and hi."""
    named = parse_survey_name(df, "survey").filter(F.col("start_year") >= min_year)
    if regions:
        named = named.filter(F.exists(F.array(*map(F.lit, regions)), lambda r: F.col("area").contains(r)))
    pick = F.row_number().over(Window.partitionBy("survey").orderBy(F.md5(F.col("tile_id").cast("string")), "tile_id"))
    few = named.withColumn("_k", pick).filter(F.col("_k") <= n)
    return few.groupBy("survey", "area", "start_year").agg(F.percentile("density", F.lit(0.5)).alias("density"), F.count("*").alias("n_tiles")).filter(F.col("density").between(lo, hi))


def match_twins(cur: DataFrame, prev: DataFrame, key: str = "spatial_key") -> DataFrame:
    """cur rows with the first prev tile of the same key (prev_tile); rows without one are dropped."""
    first = prev.groupBy(key).agg(F.min("tile").alias("prev_tile"))
    return cur.join(first, key)


def match_grid(cur: DataFrame, prev: DataFrame, mode: str = "prev") -> DataFrame:
    """cur tiles with all prev tiles of the same (east, north), sorted; unpaired ones are dropped. Mode self pairs a tile with itself."""
    if mode == "self":
        return cur.withColumn("prev_tiles", F.array("tile"))
    grouped = prev.groupBy("east", "north").agg(F.array_sort(F.collect_list("tile")).alias("prev_tiles"))
    return cur.join(grouped, ["east", "north"])


def unmatched(cur: DataFrame, prev: DataFrame, keys: list[str]) -> DataFrame:
    """n_unmatched: cur rows without a partner."""
    return cur.join(prev.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("n_unmatched"))


def stem(col: Column) -> Column:
    """File name without folder and extensions."""
    return F.regexp_replace(F.regexp_replace(col, r"^.*/", ""), r"(\.copc)?\.[A-Za-z0-9]+$", "")


def match_stem(clouds: DataFrame, other: DataFrame, path: str = "path") -> DataFrame:
    """clouds with other_path, the first file of the same stem, or null."""
    first = other.groupBy(stem(F.col(path)).alias("_stem")).agg(F.min(path).alias("other_path"))
    return clouds.withColumn("_stem", stem(F.col(path))).join(first, "_stem", "left").drop("_stem")


def match_extent(a: DataFrame, b: DataFrame, cell: float, key_a: str = "path", key_b: str = "raster") -> DataFrame:
    """All (a, b) whose boxes (min_x, min_y, max_x, max_y) meet, borders included, with epsg_differs.

    A box belongs to the level whose cells, cell times a power of two, are the first not smaller than itself, so it touches four
    of them at most, and as many on every level above. Two boxes meet on the larger level of both, so each goes to its own level
    and to those above where the other side has boxes. A pair that shares several cells is kept in the one of the lower left corner
    of what they share, so nothing is compared twice in the end.
    """
    def levelled(df: DataFrame, p: str) -> DataFrame:
        d = df.select(*[F.col(c).alias(f"{p}_{c}") for c in df.columns])
        side = F.greatest(F.col(f"{p}_max_x") - F.col(f"{p}_min_x"), F.col(f"{p}_max_y") - F.col(f"{p}_min_y"))
        level = F.when(side > cell, F.ceil(F.log2(side / cell))).otherwise(F.lit(0)).cast("int")
        # rounding of the logarithm must not leave a cell smaller than its box
        return d.withColumn(f"{p}_level", level + (side > cell * F.pow(F.lit(2.0), level)).cast("int"))

    def cells(d: DataFrame, p: str, met: DataFrame) -> DataFrame:
        span = lambda lo, hi: F.sequence(F.floor(F.col(f"{p}_{lo}") / F.col("_side")), F.floor(F.col(f"{p}_{hi}") / F.col("_side")))
        levels = d.crossJoin(F.broadcast(met)).withColumn("_level", F.explode(F.array_distinct(F.concat(F.array(F.col(f"{p}_level")), F.filter("_levels", lambda v: v > F.col(f"{p}_level"))))))
        levels = levels.drop("_levels").withColumn("_side", cell * F.pow(F.lit(2.0), F.col("_level")))
        return levels.withColumn("_cx", F.explode(span("min_x", "max_x"))).withColumn("_cy", F.explode(span("min_y", "max_y")))

    left, right = levelled(a, "a"), levelled(b, "b")
    # one row: the levels of a side, some dozens at most
    seen = lambda d, p: d.select(F.col(f"{p}_level").alias("v")).distinct().agg(F.collect_list("v").alias("_levels"))
    pairs = cells(left, "a", seen(right, "b")).join(cells(right, "b", seen(left, "a")).drop("_side").hint("shuffle_merge"), ["_level", "_cx", "_cy"]).filter(F.col("_level") == F.greatest("a_level", "b_level"))
    meet = (F.col("a_min_x") <= F.col("b_max_x")) & (F.col("b_min_x") <= F.col("a_max_x")) & (F.col("a_min_y") <= F.col("b_max_y")) & (F.col("b_min_y") <= F.col("a_max_y"))
    once = (F.col("_cx") == F.floor(F.greatest("a_min_x", "b_min_x") / F.col("_side"))) & (F.col("_cy") == F.floor(F.greatest("a_min_y", "b_min_y") / F.col("_side")))
    differs = F.coalesce(F.col("a_epsg") != F.col("b_epsg"), F.lit(False)) if "epsg" in a.columns and "epsg" in b.columns else F.lit(False)
    return pairs.filter(meet & once).select(F.col(f"a_{key_a}").alias(key_a), F.col(f"b_{key_b}").alias(key_b), differs.alias("epsg_differs"))


def plan_round_robin(df: DataFrame, budget: int, per_visit: int = 6) -> DataFrame:
    """picked pair tiles under a budget, by area in turns.

    df: area, pair_rank, position, tile, size. Each pass visits the pairs, areas interleaved, and takes the next
    per_visit tiles of each; a chunk stops at the first tile over the budget and its rest never comes back. A
    pass that takes nothing ends the plan. The fold runs over one plan's tiles, a list by nature.
    """
    chunk = F.floor((F.col("position") - 1) / per_visit)
    ordered = df.select(F.struct(chunk.alias("visit"), F.col("pair_rank"), F.col("area"), F.col("position"), F.col("tile"), F.col("size")).alias("t"))
    listed = ordered.agg(F.array_sort(F.collect_list("t")).alias("ts"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.lit("").alias("stopped"), F.lit(-1).cast("long").alias("visit"), F.lit(True).alias("took"), F.lit(False).alias("ended"), F.array().cast("array<string>").alias("picked"))

    def step(s: Column, t: Column) -> Column:
        key = F.concat_ws(":", t["area"], t["pair_rank"].cast("string"), t["visit"].cast("string"))
        turned = t["visit"] != s["visit"]
        ended = s["ended"] | (turned & ~s["took"])
        fits = ~ended & (s["stopped"] != key) & (t["size"] <= s["left"])
        return F.struct(
            F.when(fits, s["left"] - t["size"]).otherwise(s["left"]).alias("left"),
            F.when(~fits & ~ended, key).otherwise(s["stopped"]).alias("stopped"),
            t["visit"].alias("visit"),
            (F.when(turned, F.lit(False)).otherwise(s["took"]) | fits).alias("took"),
            ended.alias("ended"),
            F.when(fits, F.concat(s["picked"], F.array(t["tile"].cast("string")))).otherwise(s["picked"]).alias("picked"),
        )

    folded = listed.select(F.aggregate("ts", start, step)["picked"].alias("picked"))
    return folded.select(F.posexplode("picked").alias("pick", "tile"))


def plan_first_fit(df: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """tile, size of the tiles that fit, in MD5 order of seed and tile; one that does not fit is passed over."""
    order = F.struct(F.md5(F.concat(F.lit(f"{seed}:"), F.col("tile").cast("string"))).alias("k"), F.col("tile").cast("string").alias("tile"), F.col("size"))
    listed = df.agg(F.array_sort(F.collect_list(order)).alias("ts"))
    start = F.struct(F.lit(budget).cast("long").alias("left"), F.array().cast("array<struct<tile:string,size:bigint>>").alias("picked"))
    step = lambda s, t: F.when(t["size"] <= s["left"], F.struct((s["left"] - t["size"]).alias("left"), F.concat(s["picked"], F.array(F.struct(t["tile"].alias("tile"), t["size"].cast("long").alias("size")))).alias("picked"))).otherwise(s)
    return listed.select(F.explode(F.aggregate("ts", start, step)["picked"]).alias("p")).select("p.tile", "p.size")


def plan_prefix(df: DataFrame, budget: int, seed: int = 0) -> DataFrame:
    """tile, size of the longest prefix, in MD5 order, within the budget."""
    keyed = df.select("tile", "size", F.md5(F.concat(F.lit(f"{seed}:"), F.col("tile").cast("string"))).alias("_k"))
    upto = running(keyed, (), ["_k", "tile"], "plan", _before=F.col("size")).withColumn("total", F.col("_before") + F.col("size"))
    return upto.filter(F.col("total") <= budget).select("tile", "size", "total")


def plan_dem_pairs(df: DataFrame, budget: int, first: int = 8) -> DataFrame:
    """area, cur_year, prev_year, tile, size, total: the first keys of each previous survey of an area until the budget is spent."""
    surveys = df.select("area", "start_year").distinct()
    w = Window.partitionBy("area").orderBy("start_year")
    pairs = surveys.select("area", F.col("start_year").alias("cur_year"), F.lag("start_year").over(w).alias("prev_year")).filter("prev_year IS NOT NULL AND prev_year <> cur_year")
    tiles = pairs.join(df.withColumnRenamed("start_year", "prev_year"), ["area", "prev_year"])
    place = F.row_number().over(Window.partitionBy("area", "cur_year").orderBy("tile_id"))
    kept = tiles.withColumn("_k", place).filter(F.col("_k") <= first)
    upto = running(kept, (), ["area", "cur_year", "_k"], "plan", _before=F.col("size")).withColumn("total", F.col("_before") + F.col("size"))
    return upto.filter(F.col("total") <= budget).select("area", "cur_year", "prev_year", "tile_id", "size", "total")


def year_from_collection(df: DataFrame, json_col: str, name_col: str) -> DataFrame:
    """year: of the collection's temporal extent, else in the name, else 0."""
    stamp = F.get_json_object(F.col(json_col), "$.extent.temporal.interval[0][0]")
    return df.withColumn("year", F.coalesce(_first(stamp, r"^(\d{4})").cast("int"), _first(F.col(name_col), r"((?:19|20)\d{2})").cast("int"), F.lit(0)))


def assign_splits(df: DataFrame, val: float, test: float, key: str = "cloud", seed: int = 0) -> DataFrame:
    """split of each row of df (one a cloud) by place in MD5 order: test, then val, then train; shares rounded half to even."""
    order = F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), key))
    n = F.count("*").over(Window.partitionBy())
    n_test, n_val = F.bround(n * F.lit(test), 0), F.bround(n * F.lit(val), 0)
    return df.withColumn("split", F.when(order <= n_test, "test").when(order <= n_test + n_val, "val").otherwise("train"))


def hash_split(df: DataFrame, seed: int, val: float, test: float, key: str = "cloud") -> DataFrame:
    """u in [0, 1) from the MD5 of seed:key, and split; independent of row order and of other rows."""
    head = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), 1, 12), 16, 10).cast("long")
    u = head / F.lit(float(2**48))
    return df.withColumns({"u": u, "split": F.when(u < test, "test").when(u < test + val, "val").otherwise("train")})


def effective_split(df: DataFrame, stored: str, seed: int | None, val: float, test: float, key: str = "cloud") -> DataFrame:
    """split: the stored one, or the hash split if a seed is set."""
    if seed is None:
        return df.withColumn("split", F.col(stored))
    return hash_split(df, seed, val, test, key).drop("u")


def scan_tiles(points: DataFrame, split: str | None = None) -> DataFrame:
    """cloud, n_points, origin, (e, n) and region of every cloud, of one split if named."""
    rows = points.filter(F.col("split") == split) if split else points
    return parse_en_region(rows.groupBy("cloud").agg(F.count("*").alias("n_points"), *[F.min(c).alias(f"origin_{c}") for c in "xyz"]), "cloud")


def grid_components(tiles: DataFrame) -> DataFrame:
    """tiles (region, e, n, ...) with component: the smallest (e, n) rank reachable over 4-neighbours.

    A region's step per axis is the smallest positive gap between its distinct coordinates. Labels fall by
    joins with the neighbours and with the label's own label, so a chain of n tiles takes about log n rounds.
    """
    def step(axis: str) -> DataFrame:
        v = tiles.select("region", axis).distinct()
        gap = F.col(axis) - F.lag(axis).over(Window.partitionBy("region").orderBy(axis))
        return v.withColumn("_gap", gap).groupBy("region").agg(F.coalesce(F.min("_gap"), F.lit(1)).alias(f"step_{axis}"))

    cells = tiles.select("region", "e", "n").distinct()
    cells = cells.withColumn("_id", (F.row_number().over(Window.partitionBy("region").orderBy("e", "n"))).cast("long"))
    cells = written(cells.join(step("e"), "region").join(step("n"), "region"), "grid-cells")
    offsets = F.array(*[F.struct(F.lit(a).alias("de"), F.lit(b).alias("dn")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    ends = cells.select("region", "_id", F.explode(offsets).alias("o"), "e", "n", "step_e", "step_n").select("region", "_id", (F.col("e") + F.col("o.de") * F.col("step_e")).alias("e"), (F.col("n") + F.col("o.dn") * F.col("step_n")).alias("n"))
    edges = written(ends.join(cells.select("region", "e", "n", F.col("_id").alias("_to")).hint("shuffle_merge"), ["region", "e", "n"]).select("region", "_id", "_to"), "grid-edges")
    labels = written(cells.select("region", "_id", F.col("_id").alias("label")), "grid-labels")
    while True:
        near = edges.join(labels.select("region", F.col("_id").alias("_to"), F.col("label").alias("_near")), ["region", "_to"]).groupBy("region", "_id").agg(F.min("_near").alias("_near"))
        lower = labels.join(near, ["region", "_id"], "left").select("region", "_id", "label", F.least("label", "_near").alias("new"))
        hop = labels.select("region", F.col("_id").alias("new"), F.col("label").alias("_root"))
        after = written(lower.join(hop, ["region", "new"]).select("region", "_id", F.col("label").alias("old"), F.least("new", "_root").alias("label")), "grid-labels")
        labels = after.select("region", "_id", "label")
        if after.filter("old <> label").isEmpty():
            break
    return tiles.join(cells.select("region", "e", "n", "_id"), ["region", "e", "n"]).join(labels, ["region", "_id"]).drop("_id").withColumnRenamed("label", "component")


def grid_blocks(components: DataFrame, max_tiles: int, num: int) -> DataFrame:
    """block, n_tiles, n_points of the `num` largest components, each cut to the max_tiles tiles nearest its centroid."""
    w = Window.partitionBy("region", "component")
    far = F.pow(F.col("e") - F.avg("e").over(w), F.lit(2)) + F.pow(F.col("n") - F.avg("n").over(w), F.lit(2))
    near = components.withColumn("_d", far).withColumn("_k", F.row_number().over(w.orderBy("_d", "e", "n"))).filter(F.col("_k") <= max_tiles)
    return near.groupBy(F.concat_ws("_", "region", F.col("component").cast("string")).alias("block")).agg(F.count("*").alias("n_tiles"), F.sum("n_points").alias("n_points")).orderBy(F.desc("n_points"), "block").limit(num)


def build_manifest(clouds: DataFrame, prev: DataFrame | None = None) -> DataFrame:
    """region, twinned and the sorted clouds and prev_clouds of each pair: per project, clouds with an earlier twin in one, others in another."""
    rows = clouds.select("project", "path", stem(F.col("path")).alias("stem"))
    if prev is not None:
        rows = rows.join(prev.groupBy("project", stem(F.col("path")).alias("stem")).agg(F.min("path").alias("prev")), ["project", "stem"], "left")
    else:
        rows = rows.withColumn("prev", F.lit(None).cast("string"))
    pair = F.array_sort(F.collect_list(F.struct("path", "prev")))
    return rows.groupBy(F.col("project").alias("region"), F.col("prev").isNotNull().alias("twinned")).agg(pair.alias("p")).select("region", "twinned", F.col("p.path").alias("clouds"), F.filter("p.prev", lambda x: x.isNotNull()).alias("prev_clouds"))


def project_dirs(files: DataFrame, las_hints=("las", "point", "cloud"), dtm_hints=("dtm", "dem", "terrain")) -> DataFrame:
    """las_dir and dtm_dir of each project: the folder whose name has the earliest hint, else the one with most files of the kind.

    files: project, dir, kind (las or raster), n files.
    """
    def best(hints, kind: str) -> Column:
        rank = F.lit(len(hints))
        for i, h in reversed(list(enumerate(hints))):
            rank = F.when(F.lower(F.regexp_replace("dir", r"^.*/", "")).contains(h), i).otherwise(rank)
        return F.min_by("dir", F.when(F.col("kind") == kind, F.struct(rank.alias("rank"), (-F.col("n")).alias("n"), F.col("dir"))))

    return files.groupBy("project").agg(best(las_hints, "las").alias("las_dir"), best(dtm_hints, "raster").alias("dtm_dir"))


def pending(planned: DataFrame, done: DataFrame, key: str = "tile") -> DataFrame:
    """Planned work whose output is missing or empty."""
    return planned.join(done.filter("size > 0").select(key).distinct(), key, "left_anti")


def flatten_jobs(manifest: DataFrame) -> DataFrame:
    """One row a cloud: region, position, cloud, prior and dtm, from the aligned lists or else the pair's single ones."""
    long = manifest.select("*", F.posexplode("clouds").alias("pos", "cloud"))
    take = lambda many, one: F.coalesce(F.get(many, F.col("pos")), F.col(one))
    return long.select("region", "pos", "cloud", take("prior_rasters", "prior_raster").alias("prior"), take("dtms", "dtm").alias("dtm"))
