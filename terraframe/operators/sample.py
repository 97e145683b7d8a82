"""Sampling, batching and deterministic augmentation: every choice is a hash of a seed and an id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraframe.functions.tables import last_seen, running, written
from terraframe.operators.project import BY


def uniform(seed: str, *cols: str) -> Column:
    """A number in [0, 1) from the MD5 of seed and columns."""
    key = F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("long") / F.lit(float(2**48))


def weighted_draws(df: DataFrame, weight: str, draws: DataFrame, item: str = "item") -> DataFrame:
    """draw and item for each draw (draw, u in [0, 1)): the item whose share of the running weight holds u, borders to the right.

    Weights that are null, negative, infinite or all zero count as even. Items stand at the lower end of their share, from a
    two-level running sum; items and draws are cut by one range sort and merged in that order, so what is looked at follows their
    number, and each draw has exactly one item, however the sums are rounded.
    """
    w = F.col(weight).cast("double")
    fine = w.isNotNull() & ~F.isnan(w) & (w >= 0) & (w < float("inf"))
    ends = df.agg(F.count_if(~fine).alias("_bad"), F.sum(F.when(fine, w)).alias("_sum"))
    rows = df.crossJoin(F.broadcast(ends)).withColumn("_w", F.when((F.col("_bad") > 0) | (F.coalesce("_sum", F.lit(0.0)) <= 0), 1.0).otherwise(w))
    spans = running(rows.select(item, "_w").filter("_w > 0"), (), [item], "weights", _lo=F.col("_w"))
    kind = dict(df.dtypes)[item]
    here = spans.select((F.col("_lo") / F.col("_lo_all")).alias("_at"), F.lit(0).alias("_kind"), F.col(item).alias("_item"), F.lit(None).cast(dict(draws.dtypes)["draw"]).alias("draw"))
    asked = draws.select(F.col("u").cast("double").alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(kind).alias("_item"), "draw")
    # struct, as an item may itself be null
    one = F.when(F.col("_kind") == 0, F.struct("_item"))
    met = last_seen(here.unionByName(asked), ["_at", "_kind", "_item", "draw"], one, "_found", "draws")
    return met.filter("_kind = 1 AND _found IS NOT NULL").select("draw", F.col("_found._item").alias(item))


def region_weights(df: DataFrame, by=BY) -> DataFrame:
    """df with weight: one over the items of its cloud, over the number of clouds, so all add up to one."""
    per = df.groupBy(*by).agg(F.count("*").alias("_n"))
    per = per.withColumn("_k", F.count("*").over(Window.partitionBy()))
    return df.join(per, list(by)).withColumn("weight", 1 / (F.col("_n") * F.col("_k"))).drop("_n", "_k")


def uniform_draws(df: DataFrame, n: int, seed: str, item: str = "pid") -> DataFrame:
    """draw and item, n with replacement, every item as likely."""
    spark = df.sparkSession
    draws = spark.range(n).select(F.col("id").alias("draw")).withColumn("u", uniform(seed, "draw"))
    return weighted_draws(df.withColumn("_one", F.lit(1.0)), "_one", draws, item)


def fixed_subset(df: DataFrame, n: int, seed: str, item: str = "pid") -> DataFrame:
    """n rows without replacement, those of the smallest MD5."""
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(item).cast("string"))), item).limit(n)


def even_subset(df: DataFrame, n: int, item: str = "pid", by=BY) -> DataFrame:
    """At most n rows of each cloud at evenly spaced places, rounded half to even."""
    rows = running(df, by, [item], "places", _p=F.lit(1).cast("long"))
    places = rows.groupBy(*by).agg(F.first("_p_all").alias("_n")).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    wanted = places.select(*by, F.bround(F.col("_i") * (F.col("_n") - 1) / max(n - 1, 1), 0).cast("long").alias("_p")).distinct()
    return rows.join(wanted.hint("shuffle_merge"), [*by, "_p"], "left_semi").drop("_p", "_p_all")


def pack_batches(df: DataFrame, limit: int, shard: str = "shard", item: str = "item", size: str = "n") -> DataFrame:
    """df with batch: greedy in item order within a shard; an item over the limit stands alone.

    With running sums, the batch that an item would open ends before the first item whose sum is over its own by more than the
    limit; all items find that item at once, by a merge of the sorted sums. These steps are then doubled, two, four, eight batches at a
    time, from the first item of each shard, so the starts of all batches are known after as many rounds as the number of
    batches has binary digits, and no task holds a shard.
    """
    rows = running(df.select(shard, item, F.col(size).cast("long").alias(size)), (shard,), [item], "batch-sums", _before=F.col(size), _rank=F.lit(1).cast("long"))
    rows = written(rows.select(shard, item, size, "_before", "_rank", F.col("_rank_all").alias("_n")), "batch-ranks")
    zero = F.lit(0).cast("long")
    ends = rows.select(shard, (F.col("_before") + F.col(size)).alias("_at"), zero.alias("_kind"), "_rank", "_n")
    asked = rows.select(shard, (F.col("_before") + limit).alias("_at"), F.lit(1).cast("long").alias("_kind"), "_rank", "_n")
    # the last item of the shard whose sum, itself included, is within the limit
    fits = last_seen(ends.unionByName(asked), [shard, "_at", "_kind", "_rank"], F.when(F.col("_kind") == 0, F.struct(F.col(shard).alias("s"), F.col("_rank").alias("r"))), "_last", "batch-ends").filter("_kind = 1")
    after = F.when(F.col("_last.s").eqNullSafe(F.col(shard)), F.col("_last.r") + 1).otherwise(zero)
    jump = written(fits.select(shard, F.col("_rank").alias("_from"), F.greatest(after, F.col("_rank") + 1).alias("_to"), "_n"), "batch-jumps")
    jumps = [jump]
    while not jump.filter("_from = 0 AND _to < _n").isEmpty():
        step = jump.select(F.col(shard).alias("_s"), F.col("_from").alias("_via"), F.col("_to").alias("_next"))
        far = jump.join(step.hint("merge"), F.col(shard).eqNullSafe(F.col("_s")) & (F.col("_to") == F.col("_via")), "left")
        jump = written(far.select(shard, "_from", F.coalesce("_next", "_to").alias("_to"), "_n"), "batch-jumps")
        jumps.append(jump)
    starts = rows.filter("_rank = 0").select(F.col(shard).alias("_s"), zero.alias("_start"))
    for jump in reversed(jumps[:-1] or jumps):
        reached = starts.join(jump.hint("merge"), F.col("_s").eqNullSafe(F.col(shard)) & (F.col("_start") == F.col("_from"))).filter("_to < _n").select("_s", F.col("_to").alias("_start"))
        starts = written(starts.unionByName(reached).distinct(), "batch-starts")
    first = rows.join(starts.hint("merge"), F.col(shard).eqNullSafe(F.col("_s")) & (F.col("_rank") == F.col("_start")), "left").select(shard, item, size, F.col("_start").isNotNull().cast("long").alias("_new"))
    numbered = running(first, (shard,), [item], "batches", batch=F.col("_new"))
    return numbered.select(shard, item, size, (F.col("batch") + F.col("_new") - 1).alias("batch"))


def mix_pairs(clouds: DataFrame, by=BY) -> DataFrame:
    """clouds (one row each) with scene: consecutive clouds two by two; an odd last one stays alone."""
    return clouds.withColumn("scene", F.floor((F.row_number().over(Window.orderBy(*by)) - 1) / 2))


def stride_sample(df: DataFrame, cap: int = 200_000, item: str = "pid", by=BY) -> DataFrame:
    """Every max(1, n // cap)-th row of each cloud."""
    step = F.greatest(F.floor(F.col("_p_all") / cap), F.lit(1).cast("long"))
    return running(df, by, [item], "places", _p=F.lit(1).cast("long")).filter(F.col("_p") % step == 0).drop("_p", "_p_all")


# augmentation

def planar_params(clouds: DataFrame, seed: str, lo: float = 0.9, hi: float = 1.1, by=BY) -> DataFrame:
    """angle, sx, sy, sz and the flips fx, fy of each cloud."""
    u = lambda k: uniform(f"{seed}/{k}", *by)
    flip = lambda k: F.when(u(k) < 0.5, -1.0).otherwise(1.0)
    scale = lambda k: F.lit(lo) + u(k) * (hi - lo)
    return clouds.withColumns({"angle": u("angle") * 6.283185307179586, "sx": scale("sx"), "sy": scale("sy"), "sz": scale("sz"), "fx": flip("fx"), "fy": flip("fy")})


def augment_planar(df: DataFrame, params: DataFrame, by=BY) -> DataFrame:
    """x, y flipped, scaled and turned about the cloud's centroid, z scaled; params as planar_params gives them."""
    pivot = df.groupBy(*by).agg(F.avg("x").alias("_px"), F.avg("y").alias("_py")).join(params, list(by))
    rows = df.join(pivot, list(by))
    dx, dy = (F.col("x") - F.col("_px")) * F.col("fx") * F.col("sx"), (F.col("y") - F.col("_py")) * F.col("fy") * F.col("sy")
    c, s = F.cos("angle"), F.sin("angle")
    return rows.withColumns({"x": F.col("_px") + c * dx - s * dy, "y": F.col("_py") + s * dx + c * dy, "z": F.col("z") * F.col("sz")}).select(df.columns)


def augment_tilt(df: DataFrame, params: DataFrame, by=BY) -> DataFrame:
    """Turned about x by tilt_x, then about y by tilt_y (0 for a cloud that is left as it is)."""
    rows = df.join(params, list(by))
    y = F.cos("tilt_x") * F.col("y") - F.sin("tilt_x") * F.col("z")
    z = F.sin("tilt_x") * F.col("y") + F.cos("tilt_x") * F.col("z")
    rows = rows.withColumns({"y": y, "z": z})
    return rows.withColumns({"x": F.cos("tilt_y") * F.col("x") + F.sin("tilt_y") * F.col("z"), "z": -F.sin("tilt_y") * F.col("x") + F.cos("tilt_y") * F.col("z")}).select(df.columns)


def tilt_params(clouds: DataFrame, seed: str, most: float = 0.05, by=BY) -> DataFrame:
    """tilt_x and tilt_y of each cloud, each 0 half of the time."""
    one = lambda k: F.when(uniform(f"{seed}/{k}?", *by) < 0.5, (2 * uniform(f"{seed}/{k}", *by) - 1) * most).otherwise(0.0)
    return clouds.withColumns({"tilt_x": one("x"), "tilt_y": one("y")})


def gauss(seed: str, *cols: str) -> Column:
    """A standard normal number by Box and Muller from two hashed uniforms."""
    return F.sqrt(-2 * F.log(1 - uniform(seed + "/1", *cols))) * F.cos(6.283185307179586 * uniform(seed + "/2", *cols))


def augment_jitter(df: DataFrame, sigma: float, clip: float, seed: str) -> DataFrame:
    """x, y and z each moved by Gaussian noise of deviation sigma, cut at clip."""
    noise = lambda c: F.least(F.greatest(gauss(f"{seed}/{c}", "pid") * sigma, F.lit(-clip)), F.lit(clip))
    return df.withColumns({c: F.col(c) + noise(c) for c in "xyz"})


def augment_elastic(df: DataFrame, gran: float, mag: float, seed: str, most: int = 128, by=BY) -> DataFrame:
    """Points moved by smooth noise: Gaussian values on a grid, each axis blurred three wide twice, interpolated linearly between the eight nodes around a point, times mag.

    The grid starts a node before the cloud's corner. Its spacing is gran, or wider where an axis would otherwise have more than `most` nodes.
    """
    box = df.groupBy(*by).agg(*[F.min(c).alias(f"_lo{c}") for c in "xyz"], *[(F.max(c) - F.min(c)).alias(f"_e{c}") for c in "xyz"])
    box = box.withColumn("_g", F.greatest(F.lit(float(gran)), F.greatest("_ex", "_ey", "_ez") / max(most - 3, 1)))
    box = box.withColumns({f"_n{c}": F.floor(F.col(f"_e{c}") / F.col("_g")) + 3 for c in "xyz"})
    grid = box.select(*by, *[f"_n{c}" for c in "xyz"])
    for c in "xyz":
        grid = grid.withColumn(f"i{c}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"_n{c}") - 1)))
    grid = grid.select(*by, "ix", "iy", "iz", *[gauss(f"{seed}/{c}", *by, "ix", "iy", "iz").alias(f"n{c}") for c in "xyz"])
    for _ in range(2):
        for axis in ("ix", "iy", "iz"):
            others = [a for a in ("ix", "iy", "iz") if a != axis]
            w = Window.partitionBy(*by, *others).orderBy(axis).rowsBetween(-1, 1)
            grid = grid.withColumns({f"n{c}": F.sum(f"n{c}").over(w) / 3 for c in "xyz"})
    grid = written(grid, "elastic")
    at = df.select(*by, "pid", *"xyz").join(box, list(by))
    for c in "xyz":
        f = (F.col(c) - F.col(f"_lo{c}")) / F.col("_g") + 1
        at = at.withColumn(f"_f{c}", f).withColumn(f"_b{c}", F.floor(f))
    corner = []
    for dx in (0, 1):
        for dy in (0, 1):
            for dz in (0, 1):
                weight = F.lit(1.0)
                for c, d in (("x", dx), ("y", dy), ("z", dz)):
                    part = F.col(f"_f{c}") - F.col(f"_b{c}")
                    weight = weight * (part if d else 1 - part)
                corner.append(F.struct(*[F.least(F.col(f"_b{c}") + d, F.col(f"_n{c}") - 1).alias(f"i{c}") for c, d in (("x", dx), ("y", dy), ("z", dz))], weight.alias("weight")))
    eight = at.select(*by, "pid", F.explode(F.array(*corner)).alias("k")).select(*by, "pid", "k.*")
    move = eight.join(grid.hint("shuffle_merge"), [*by, "ix", "iy", "iz"]).groupBy(*by, "pid").agg(*[F.sum(F.col("weight") * F.col(f"n{c}")).alias(f"_d{c}") for c in "xyz"])
    return df.join(move, [*by, "pid"]).withColumns({c: F.col(c) + mag * F.col(f"_d{c}") for c in "xyz"}).select(df.columns)


def warp_patch(patch: DataFrame, size: int, params: DataFrame, bands=("dtm", "dsm", "ndsm"), by=("patch_id",), plain=()) -> DataFrame:
    """A patch (by, row, col, bands, plain) warped about its middle as augment_planar moves points, sampled between cells, edges repeated.

    params has planar_params' angle, sx, sy, fx, fy and sz. bands are heights and scale by sz; the plain ones do not.
    """
    mid = (size - 1) / 2
    at = patch.select(*by, "row", "col").join(params, list(by))
    dr, dc = F.col("row") - mid, F.col("col") - mid
    # where the inverse of turning, scaling and flipping takes each cell
    back_x, back_y = (F.cos("angle") * dc + F.sin("angle") * dr) * F.col("fx") / F.col("sx"), (F.cos("angle") * dr - F.sin("angle") * dc) * F.col("fy") / F.col("sy")
    inside = lambda v: F.least(F.greatest(mid + v, F.lit(0.0)), F.lit(float(size - 1)))
    at = at.withColumns({"_fx": inside(back_x), "_fy": inside(back_y)}).withColumns({"_bx": F.floor("_fx"), "_by": F.floor("_fy")})
    side = lambda d, f, b: (F.col(f) - F.col(b)) if d else (1 - F.col(f) + F.col(b))
    corner = [F.struct(F.least(F.col("_by") + i, F.lit(size - 1)).alias("r"), F.least(F.col("_bx") + j, F.lit(size - 1)).alias("c"), (side(i, "_fy", "_by") * side(j, "_fx", "_bx")).alias("weight")) for i in (0, 1) for j in (0, 1)]
    four = at.select(*by, "row", "col", "sz", F.explode(F.array(*corner)).alias("k")).select(*by, "row", "col", "sz", "k.*")
    src = patch.select(*by, F.col("row").alias("r"), F.col("col").alias("c"), *bands, *plain)
    return four.join(src.hint("shuffle_merge"), [*by, "r", "c"]).groupBy(*by, "row", "col").agg(*[(F.sum(F.col("weight") * F.col(b)) * F.first("sz")).alias(b) for b in bands], *[F.sum(F.col("weight") * F.col(b)).alias(b) for b in plain])


def random_dropout(df: DataFrame, ratio: float, prob: float, min_pts: int, seed: str, by=BY) -> DataFrame:
    """With probability prob a cloud loses about `ratio` of its points, unless fewer than min_pts would stay."""
    rows = df.withColumns({"_gone": (uniform(seed + "/cloud", *by) < prob) & (uniform(seed + "/point", "pid") < ratio)})
    left = rows.groupBy(*by).agg(F.count_if(~F.col("_gone")).alias("_left"))
    return rows.join(left, list(by)).filter(~F.col("_gone") | (F.col("_left") < min_pts)).drop("_gone", "_left")
