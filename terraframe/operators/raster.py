"""Elevation rasters as cell tables: (by, row, col, value ...), row 0 at y_min; null is unknown.

A raster's frame is x_min, y_min, res, h, w; here every cloud has one frame row (by, x_min, y_min, h, w) and res is an argument.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraframe.functions.grids import FAR, nearest_columns
from terraframe.functions.quantiles import quantiles
from terraframe.functions.tables import dealt, written
from terraframe.operators.project import BY

BANDS = ("dtm", "dsm", "ndsm", "gprob", "cover")
#: Rows of a raster that a task fills together.
STRIP = 64


def frames(df: DataFrame, res: float, by=BY) -> DataFrame:
    """The frame of each cloud: its corner and its size in cells, one at least."""
    n = lambda c: F.greatest(F.ceil((F.max(c) - F.min(c)) / res), F.lit(1).cast("long"))
    return df.groupBy(*by).agg(F.min("x").alias("x_min"), F.min("y").alias("y_min"), n("y").alias("h"), n("x").alias("w"))


def placed(df: DataFrame, frame: DataFrame, res: float, by=BY) -> DataFrame:
    """df with the row and col of each point, clipped into the frame."""
    at = lambda c, lo, n: F.least(F.greatest(F.floor((F.col(c) - F.col(lo)) / res), F.lit(0).cast("long")), F.col(n) - 1)
    return df.join(frame, list(by)).withColumns({"row": at("y", "y_min", "h"), "col": at("x", "x_min", "w")})


def build_dtm(df: DataFrame, res: float = 1.0, reduce: str = "mean", ground_only: bool = False, by=BY) -> DataFrame:
    """value per occupied cell: mean or lowest z, of all points or of label-1 points, in the frame of all points."""
    cells = placed(df, frames(df, res, by), res, by)
    cells = cells.filter("label = 1") if ground_only else cells
    agg = F.min("z") if reduce == "min" else F.avg("z")
    return cells.groupBy(*by, "row", "col").agg(agg.alias("value"))


def dense(frame: DataFrame, by=BY) -> DataFrame:
    """Every cell of every frame."""
    span = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    return frame.select(*by, F.explode(span("h")).alias("row"), "w").select(*by, "row", F.explode(span("w")).alias("col"))


def fill_nearest(cells: DataFrame, frame: DataFrame, col: str | list[str] = "value", by=BY) -> DataFrame:
    """All cells of the frame; an empty one takes the value of the nearest valued cell, ties to the smaller (row, col).

    An exact distance transform in two passes: along each column, by windows, every cell learns the nearest source of its column;
    then, along each row, the column whose source is nearest wins. Several bands take both passes together, each with its own
    empty cells. A raster without any value stays empty.
    """
    cols = [col] if isinstance(col, str) else list(col)
    full = dense(frame, by).join(cells.select(*by, "row", "col", *cols).hint("shuffle_merge"), [*by, "row", "col"], "left")
    up = Window.partitionBy(*by, "col").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*by, "col").orderBy("row").rowsBetween(0, Window.unboundedFollowing)
    picks = {}
    for c in cols:
        source = F.when(F.col(c).isNotNull(), F.struct("row", F.col(c).cast("double").alias("v")))
        above, below = F.last(source, True).over(up), F.first(source, True).over(down)
        nearer = below.isNull() | (F.col("row") - above["row"] <= below["row"] - F.col("row"))
        picks[f"_s_{c}"] = F.when(above.isNotNull() & nearer, above).otherwise(below)
    strips = full.withColumns(picks).select(*by, F.floor(F.col("row") / STRIP).alias("_strip"), "row", "col", *[F.col(f"_s_{c}.{k}").alias(f"_{k}_{c}") for c in cols for k in ("row", "v")])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["row", "col"], ignore_index=True)
        w = int(g["col"].max()) + 1
        out = {**{b: g[b] for b in by}, "row": g["row"], "col": g["col"]}
        rows = g["row"].to_numpy().reshape(-1, w)
        for c in cols:
            at = g[f"_row_{c}"].to_numpy(float).reshape(-1, w)
            known = ~np.isnan(at)
            source = np.where(known, at, 0).astype(np.int64)
            best = nearest_columns(np.where(known, (rows - source) ** 2, FAR), source)
            here = np.arange(len(best))[:, None]
            out[c] = np.where(known[here, best], g[f"_v_{c}"].to_numpy(float).reshape(-1, w)[here, best], np.nan).ravel()
        return pd.DataFrame(out)

    kinds = dict(frame.dtypes)
    schema = ", ".join(f"{b} {kinds[b]}" for b in by) + ", row long, col long, " + ", ".join(f"{c} double" for c in cols)
    return dealt(strips, *by, "_strip").groupBy(*by, "_strip").applyInPandas(run, schema)


def build_prior(df: DataFrame, res: float = 1.0, ground: Column | None = None, by=BY) -> DataFrame:
    """The five bands of every cell: ground mean, top, height between (after filling), ground share and coverage."""
    ground = F.col("label") == 1 if ground is None else ground
    frame = frames(df, res, by)
    cells = placed(df.withColumn("_g", ground), frame, res, by).groupBy(*by, "row", "col").agg(
        F.avg(F.when(F.col("_g"), F.col("z"))).alias("dtm"), F.max("z").alias("dsm"), (F.count_if(F.col("_g")) / F.count("*")).alias("gprob"),
    )
    cells = written(cells, "prior-cells")
    both = fill_nearest(cells, frame, ["dtm", "dsm"], by).join(cells.select(*by, "row", "col", "gprob").hint("shuffle_merge"), [*by, "row", "col"], "left")
    return both.select(*by, "row", "col", "dtm", "dsm", F.greatest(F.col("dsm") - F.col("dtm"), F.lit(0.0)).alias("ndsm"), F.coalesce("gprob", F.lit(0.0)).alias("gprob"), F.when(F.col("gprob").isNotNull(), 1.0).otherwise(0.0).alias("cover"))


def prior_from_grid(cells: DataFrame, frame: DataFrame, nodata: float, by=BY) -> DataFrame:
    """Five bands from one height grid: coverage from the valid cells before the fill; no value at all gives zeros."""
    v = F.when((F.col("value") != nodata) & ~F.isnan("value"), F.col("value"))
    clean = cells.withColumn("value", v).filter("value IS NOT NULL")
    cover = clean.select(*by, "row", "col", F.lit(1.0).alias("_c"))
    filled = fill_nearest(clean, frame, "value", by).join(cover.hint("shuffle_merge"), [*by, "row", "col"], "left")
    h, c = F.coalesce("value", F.lit(0.0)), F.coalesce("_c", F.lit(0.0))
    return filled.select(*by, "row", "col", h.alias("dtm"), h.alias("dsm"), F.lit(0.0).alias("ndsm"), c.alias("gprob"), c.alias("cover"))


def promote_prior(cells: DataFrame) -> DataFrame:
    """A single band as five: itself twice, no height between, certain ground, full coverage."""
    rest = [c for c in cells.columns if c != "value"]
    return cells.select(*rest, F.col("value").alias("dtm"), F.col("value").alias("dsm"), F.lit(0.0).alias("ndsm"), F.lit(1.0).alias("gprob"), F.lit(1.0).alias("cover"))


def sample_bilinear(points: DataFrame, cells: DataFrame, frame: DataFrame, res: float, cols: list[str] = ("value",), out: str = "", by=BY, rest: str = "mean", centre: bool = False) -> DataFrame:
    """points (pid, x, y) with each of cols sampled between cells, taken as nodes (or as centres).

    Corners and weights are clamped to the frame. A missing corner counts as the mean of all corners found in
    the call, per cloud, 0 if there are none; rest="median" fills with the median of the sampled values instead.
    """
    shift = 0.5 if centre else 0.0
    axis = lambda c, lo, n: F.least(F.greatest((F.col(c) - F.col(lo)) / res - shift, F.lit(0.0)), (F.col(n) - 1).cast("double"))
    at = points.select(*by, "pid", "x", "y").join(frame.select(*by, "x_min", "y_min", "h", "w"), list(by)).withColumns({"_fx": axis("x", "x_min", "w"), "_fy": axis("y", "y_min", "h")})
    at = at.withColumns({"_c0": F.floor("_fx"), "_r0": F.floor("_fy")}).withColumns({"_wx": F.col("_fx") - F.col("_c0"), "_wy": F.col("_fy") - F.col("_r0")})
    corner = lambda dr, dc: F.struct(F.least(F.col("_r0") + dr, F.col("h") - 1).alias("row"), F.least(F.col("_c0") + dc, F.col("w") - 1).alias("col"), ((F.col("_wy") if dr else 1 - F.col("_wy")) * (F.col("_wx") if dc else 1 - F.col("_wx"))).alias("weight"))
    four = at.select(*by, "pid", F.explode(F.array(corner(0, 0), corner(0, 1), corner(1, 0), corner(1, 1))).alias("k")).select(*by, "pid", "k.row", "k.col", "k.weight")
    met = four.join(cells.select(*by, "row", "col", *cols).hint("shuffle_merge"), [*by, "row", "col"], "left")
    parts = met.groupBy(*by, "pid").agg(*[a for c in cols for a in (F.sum(F.when(F.col(c).isNotNull(), F.col("weight") * F.col(c))).alias(f"_s_{c}"), F.sum(F.when(F.col(c).isNull(), F.col("weight")).otherwise(0.0)).alias(f"_gap_{c}"), F.sum(c).alias(f"_t_{c}"), F.count(c).alias(f"_n_{c}"))])
    if rest == "mean":  # a row a cloud, added up before it moves
        parts = written(parts, "bilinear")
        parts = parts.join(parts.groupBy(*by).agg(*[(F.sum(f"_t_{c}") / F.sum(f"_n_{c}")).alias(f"_mean_{c}") for c in cols]), list(by))
    for c in cols:
        mean = F.coalesce(f"_mean_{c}", F.lit(0.0)) if rest == "mean" else None
        parts = parts.withColumn(f"{out}{c}", F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) + F.col(f"_gap_{c}") * mean if rest == "mean" else F.when(F.col(f"_gap_{c}") == 0, F.col(f"_s_{c}")))
    got = parts.select(*by, "pid", *[f"{out}{c}" for c in cols])
    if rest == "median":
        got = written(got, "sampled")
        for c in cols:
            med = quantiles(got, f"{out}{c}", [0.5], by, stored=True).select(*by, F.get("q", F.lit(0)).alias(f"_m_{c}"))
            got = got.join(med, list(by), "left")
        got = got.select(*by, "pid", *[F.coalesce(F.col(f"{out}{c}"), F.col(f"_m_{c}")).alias(f"{out}{c}") for c in cols])
    return points.join(got, [*by, "pid"])


def coverage_mask(points: DataFrame, cells: DataFrame, frame: DataFrame, res: float, col: str = "cover", by=BY) -> DataFrame:
    """points with covered: inside the node frame and the nearest cell (halves to even) covered by at least half."""
    f = lambda c, lo: (F.col(c) - F.col(lo)) / res
    at = points.join(frame.select(*by, "x_min", "y_min", "h", "w"), list(by)).withColumns({"_fx": f("x", "x_min"), "_fy": f("y", "y_min")})
    at = at.withColumns({"row": F.bround("_fy", 0).cast("long"), "col": F.bround("_fx", 0).cast("long")})
    inside = (F.col("_fx") >= 0) & (F.col("_fx") <= F.col("w") - 1) & (F.col("_fy") >= 0) & (F.col("_fy") <= F.col("h") - 1)
    met = at.join(cells.select(*by, "row", "col", F.col(col).alias("_cov")).hint("shuffle_merge"), [*by, "row", "col"], "left")
    return met.withColumn("covered", inside & (F.coalesce("_cov", F.lit(0.0)) >= 0.5)).drop("x_min", "y_min", "h", "w", "_fx", "_fy", "row", "col", "_cov")


def height_above(points: DataFrame, cells: DataFrame, frame: DataFrame, res: float, by=BY) -> DataFrame:
    """points with height_above the dtm band; 0 where the raster does not cover them, or there is none."""
    sampled = sample_bilinear(points, cells, frame, res, ["dtm"], "_", by)
    masked = coverage_mask(sampled, cells, frame, res, "cover", by)
    h = F.when(F.col("covered"), F.nanvl(F.col("z") - F.col("_dtm"), F.lit(0.0))).otherwise(0.0)
    known = masked.select(*by, "pid", F.coalesce(h, F.lit(0.0)).alias("height_above"))
    return points.join(known, [*by, "pid"], "left").withColumn("height_above", F.coalesce("height_above", F.lit(0.0)))


def crop_downsample(cells: DataFrame, frame: DataFrame, box: tuple[float, float, float, float], src: float, res: float, cols: list[str] = ("value",), by=BY) -> DataFrame:
    """The cells of box (x0, y0, x1, y1) of each raster (frame: by, x_min, y_min, h, w) as block means by the factor max(round(res / src), 1).

    Blocks that would hang over the crop's end are dropped, but a crop smaller than one block keeps its cells. A single
    band ignores unknown cells; five bands take plain means, so one unknown makes a block unknown. A cloud whose raster
    lies outside the box gets one placeholder cell, null for a single band and 0 for five.
    """
    factor = max(int(round(res / src)), 1)
    x0, y0, x1, y1 = box
    lo, hi = (lambda v, o: F.greatest(F.floor((F.lit(float(v)) - o) / src), F.lit(0).cast("long"))), (lambda v, o: F.ceil((F.lit(float(v)) - o) / src) + 1)
    ends = {"_r0": lo(y0, F.col("y_min")), "_r1": F.least(hi(y1, F.col("y_min")), F.col("h")), "_c0": lo(x0, F.col("x_min")), "_c1": F.least(hi(x1, F.col("x_min")), F.col("w"))}
    crops = frame.select(*by, *[v.alias(k) for k, v in ends.items()])
    sized = cells.join(crops, list(by))
    height, width = F.col("_r1") - F.col("_r0"), F.col("_c1") - F.col("_c0")
    sized = sized.withColumn("_f", F.when((height < factor) | (width < factor), 1).otherwise(factor))
    r, c = F.col("row") - F.col("_r0"), F.col("col") - F.col("_c0")
    br, bc = F.floor(r / F.col("_f")), F.floor(c / F.col("_f"))
    whole = (r >= 0) & (c >= 0) & ((br + 1) * F.col("_f") <= height) & ((bc + 1) * F.col("_f") <= width)
    mean = (lambda k: F.avg(k)) if len(cols) == 1 else (lambda k: F.when(F.count(k) == F.first("_f") * F.first("_f"), F.avg(k)))
    blocks = sized.filter(whole).groupBy(*by, br.alias("row"), bc.alias("col")).agg(*[mean(k).alias(k) for k in cols])
    empty = F.lit(None).cast("double") if len(cols) == 1 else F.lit(0.0)
    outside = crops.filter((height <= 0) | (width <= 0)).select(*by)
    return blocks.unionByName(outside.select(*by, F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"), *[empty.alias(k) for k in cols]))


def resample_patch(cells: DataFrame, frame: DataFrame, res: float, patches: DataFrame, size: int, by=BY) -> DataFrame:
    """(by, patch_id, py, px, bands): the five bands on size x size nodes, both ends included, of each patch (by, patch_id, x0, y0, side, z0).

    z0 comes off dtm and dsm only; without a raster all is 0.
    """
    grid = F.sequence(F.lit(0), F.lit(size - 1))
    node = lambda o, i: F.col(o) + F.col("side") * F.col(i) / max(size - 1, 1)
    nodes = patches.withColumn("py", F.explode(grid)).withColumn("px", F.explode(grid)).withColumns({"x": node("x0", "px"), "y": node("y0", "py")})
    nodes = nodes.withColumn("pid", (F.col("patch_id") * size + F.col("py")) * size + F.col("px"))
    got = sample_bilinear(nodes.select(*by, "pid", "x", "y"), cells, frame, res, list(BANDS), "", by).drop("x", "y")
    out = nodes.join(got.hint("shuffle_merge"), [*by, "pid"], "left")
    less = {b: F.coalesce(F.col(b) - F.col("z0") if b in ("dtm", "dsm") else F.col(b), F.lit(0.0)) for b in BANDS}
    return out.select(*by, "patch_id", "py", "px", *[v.alias(k) for k, v in less.items()])


def mosaic(cells: DataFrame, origins: DataFrame, res: float, raster: str = "raster_id") -> DataFrame:
    """One raster on the union extent: per cell the first known value in the order of origins (raster_id, x_min, y_min, ordinal).

    Offsets are rounded to whole cells; rasters of one cell are placeholders and take no part.
    """
    real = cells.join(cells.groupBy(raster).agg(F.count("*").alias("_n")).filter("_n > 1").select(raster), raster, "left_semi")
    ends = origins.join(real.select(raster).distinct(), raster, "left_semi").agg(F.min("x_min").alias("_x0"), F.min("y_min").alias("_y0"))
    moved = real.join(origins.crossJoin(F.broadcast(ends)), raster)  # one row of ends
    at = lambda i, o, z: F.col(i) + F.bround((F.col(o) - F.col(z)) / res, 0).cast("long")
    return moved.filter("value IS NOT NULL").groupBy(at("row", "y_min", "_y0").alias("row"), at("col", "x_min", "_x0").alias("col")).agg(F.min_by("value", "ordinal").alias("value"))


def merge_tiles(tiles: list[DataFrame], by=BY) -> DataFrame:
    """One scene of several tiles: x and y from the scene's corner, z as it is; columns a tile lacks are null."""
    whole = tiles[0]
    for t in tiles[1:]:
        whole = whole.unionByName(t, allowMissingColumns=True)
    low = whole.agg(F.min(F.col("x") + F.col("origin_x")).alias("_ox"), F.min(F.col("y") + F.col("origin_y")).alias("_oy"))
    return whole.crossJoin(F.broadcast(low)).withColumns({"x": F.col("x") + F.col("origin_x") - F.col("_ox"), "y": F.col("y") + F.col("origin_y") - F.col("_oy"), "z": F.col("z") + F.col("origin_z")}).drop("_ox", "_oy", "origin_x", "origin_y", "origin_z")


def ndsm_target(df: DataFrame, res: float = 1.0, min_ground: int = 8, by=BY) -> DataFrame:
    """df with ndsm: z over the filled ground raster; null for ignored points, and for clouds with too little ground."""
    frame = frames(df, res, by)
    ground = build_dtm(df, res, ground_only=True, by=by)
    filled = fill_nearest(ground, frame, "value", by)
    n = df.groupBy(*by).agg(F.count_if(F.col("label") == 1).alias("_ng"))
    got = sample_bilinear(df, filled, frame, res, ["value"], "_", by).join(n, list(by))
    fine = (F.col("_ng") >= min_ground) & (F.col("label") != 2)
    return got.withColumn("ndsm", F.when(fine, F.col("z") - F.col("_value"))).drop("_value", "_ng")


def rotate90_points(df: DataFrame, cx: float, cy: float, k: int) -> DataFrame:
    """Points turned k times by +90 degrees about (cx, cy)."""
    for _ in range(k % 4):
        df = df.withColumns({"x": cx - (F.col("y") - cy), "y": cy + (F.col("x") - cx)})
    return df


def rotate90_cells(cells: DataFrame, frame: DataFrame, res: float, cx: float, cy: float, k: int, by=BY) -> tuple[DataFrame, DataFrame]:
    """Cells and their frames turned with the points."""
    for _ in range(k % 4):
        joined = cells.join(frame.select(*by, "h"), list(by))
        cells = joined.withColumns({"row": F.col("col"), "col": F.col("h") - 1 - F.col("row")}).drop("h")
        frame = frame.select(*by, (cx + cy - (F.col("y_min") + F.col("h") * res)).alias("x_min"), (F.col("x_min") + cy - cx).alias("y_min"), F.col("w").alias("h"), F.col("h").alias("w"))
    return cells, frame


def sample_feature_map(points: DataFrame, patch: DataFrame, tile: float, size: int, cols: list[str], by=BY) -> DataFrame:
    """cols of a patch (by, row, col, cols) at points, corners aligned and borders clamped: pixel = xy / tile * (size - 1)."""
    frame = patch.select(*by).distinct().withColumns({"x_min": F.lit(0.0), "y_min": F.lit(0.0), "h": F.lit(size).cast("long"), "w": F.lit(size).cast("long")})
    return sample_bilinear(points, patch, frame, tile / (size - 1), cols, "", by)


def gate_prior(patch: DataFrame, confidence: str = "confidence", residual: str = "residual", value: str = "s", by=("patch_id",)) -> DataFrame:
    """Height bands less their patch mean, and gated = s - (1 - sigmoid(confidence)) * residual."""
    w = Window.partitionBy(*by)
    cols = {b: F.col(b) - F.avg(b).over(w) for b in ("dtm", "dsm", "ndsm") if b in patch.columns}
    return patch.withColumns({**cols, "gated": F.col(value) - (1 - 1 / (1 + F.exp(-F.col(confidence)))) * F.col(residual)})
