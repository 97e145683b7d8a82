"""Grouped aggregations: voxels, pooling, cloud statistics, audits and weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraframe.operators.project import BY, IGNORE_LABEL


def voxel_assign(df: DataFrame, dl: float, by=BY) -> DataFrame:
    """df with its voxel vx, vy, vz, counted from the cloud's corner."""
    low = df.groupBy(*by).agg(*[F.min(c).alias(f"_{c}") for c in "xyz"])
    return df.join(low, list(by)).withColumns({f"v{c}": F.floor((F.col(c) - F.col(f"_{c}")) / dl) for c in "xyz"}).drop("_x", "_y", "_z")


def voxel_key(by=BY) -> list[str]:
    return [*by, "vx", "vy", "vz"]


def voxel_downsample(df: DataFrame, dl: float, feats: list[str] = (), label: str | None = "label", by=BY) -> DataFrame:
    """One row a voxel: mean coordinates and features, number of points, and the majority label, ignore counted as a class."""
    placed, keys, means = voxel_assign(df, dl, by), voxel_key(by), ("x", "y", "z", *feats)
    if not label:
        return placed.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in means], F.count("*").alias("n_points"))
    # sums per voxel and label, then these few rows per voxel
    parts = placed.groupBy(*keys, label).agg(*[F.sum(c).alias(f"_s_{c}") for c in means], *[F.count(c).alias(f"_n_{c}") for c in means], F.count("*").alias("_n"))
    first = F.struct((-F.col("_n")).alias("n"), F.col(label).alias("l"))
    return parts.groupBy(*keys).agg(*[(F.sum(f"_s_{c}") / F.sum(f"_n_{c}")).alias(c) for c in means], F.sum("_n").alias("n_points"), F.min_by(label, first).alias(label))


def voxel_majority(df: DataFrame, dl: float, label: str = "label", ignore: int = IGNORE_LABEL, by=BY) -> DataFrame:
    """The majority label of each voxel without ignore; ignore only where nothing else is."""
    placed, keys = voxel_assign(df, dl, by), voxel_key(by)
    counts = placed.groupBy(*keys, label).agg(F.count("*").alias("_n"))
    order = F.struct((F.col(label) == ignore).alias("last"), (-F.col("_n")).alias("n"), F.col(label).alias("l"))
    return counts.groupBy(*keys).agg(F.min_by(label, order).alias(label))


def voxel_mean(df: DataFrame, dl: float, cols: list[str], nan_aware: bool = False, by=BY) -> DataFrame:
    """Means per voxel; NaN-aware ones leave NaN out and are null where nothing is left."""
    value = lambda c: F.when(~F.isnan(c), F.col(c)) if nan_aware else F.col(c)
    return voxel_assign(df, dl, by).groupBy(*voxel_key(by)).agg(*[F.avg(value(c)).alias(c) for c in cols])


def push_back(placed: DataFrame, voxels: DataFrame, cols: list[str], by=BY) -> DataFrame:
    """Points with the values of their voxel."""
    keys = voxel_key(by)
    return placed.drop(*cols).join(voxels.select(*keys, *cols), keys)


def pool(df: DataFrame, code: str, k: int, feats: list[str], reduce: str = "max", by=BY) -> DataFrame:
    """Clusters of the curve order: parent = code >> 3k; features reduced, coordinates averaged, grid cells shifted."""
    agg = {"max": F.max, "mean": F.avg, "sum": F.sum, "min": F.min}[reduce]
    parent = F.shiftright(F.col(code), 3 * k)
    return df.groupBy(*by, parent.alias("parent")).agg(
        *[agg(c).alias(c) for c in feats], *[F.avg(c).alias(c) for c in "xyz"], *[F.min(F.shiftright(F.col(f"g{c}"), k)).alias(f"g{c}") for c in "xyz"],
        F.min("pid").alias("representative"), F.count("*").alias("n_children"),
    )


def unpool(children: DataFrame, parents: DataFrame, code: str, k: int, feat: str, by=BY) -> DataFrame:
    """children with feat plus their parent's."""
    up = parents.select(*by, "parent", F.col(feat).alias("_up"))
    return children.withColumn("parent", F.shiftright(F.col(code), 3 * k)).join(up, [*by, "parent"]).withColumn(feat, F.col(feat) + F.col("_up")).drop("_up")


def pool_last(df: DataFrame, code: str, k: int, feat: str, by=BY) -> DataFrame:
    """The value of the last point in curve order of each cluster."""
    return df.groupBy(*by, F.shiftright(F.col(code), 3 * k).alias("parent")).agg(F.max_by(feat, F.struct(code, "pid")).alias(feat))


def cloud_sizes(df: DataFrame, by=BY) -> DataFrame:
    """n_points, batch (ordinal) and the offsets start and stop of every cloud."""
    w = Window.orderBy(*by)
    n = df.groupBy(*by).agg(F.count("*").alias("n_points"))
    stop = F.sum("n_points").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return n.withColumns({"batch": (F.row_number().over(w) - 1).cast("long"), "stop": stop}).withColumn("start", F.col("stop") - F.col("n_points"))


def norm_stats(df: DataFrame, feats: list[str], per_cloud: int | None = None, by=BY) -> DataFrame:
    """mean and std (arrays, in the order of feats), n_points and n_features, over at most per_cloud rows a cloud.

    std is the root of the population variance, at least 1e-8 before the root.
    """
    if per_cloud is not None:
        pick = F.row_number().over(Window.partitionBy(*by).orderBy(F.md5(F.col("pid").cast("string")), "pid"))
        df = df.withColumn("_k", pick).filter(F.col("_k") <= per_cloud)
    mean = lambda c: F.avg(F.col(c).cast("double"))
    square = lambda c: F.avg(F.col(c).cast("double") * F.col(c).cast("double"))
    std = lambda c: F.sqrt(F.greatest(square(c) - mean(c) * mean(c), F.lit(1e-8)))
    return df.agg(F.array(*map(mean, feats)).alias("mean"), F.array(*map(std, feats)).alias("std"), F.count("*").alias("n_points"), F.lit(len(feats)).alias("n_features"))


def class_histogram(df: DataFrame, by=BY) -> DataFrame:
    """Counts and shares of raw classes per cloud with the mapped label, and the label's share in it."""
    counts = df.groupBy(*by, "cls", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    return counts.withColumns({"share": F.col("n") / F.sum("n").over(w), "label_share": F.sum("n").over(Window.partitionBy(*by, "label")) / F.sum("n").over(w)})


def label_warnings(df: DataFrame, by=BY) -> DataFrame:
    """Shares of ignore and non-ground points per cloud, and whether they call for a warning (over 30 %, under 5 %)."""
    share = lambda k: F.avg((F.col("label") == k).cast("double"))
    return df.groupBy(*by).agg(share(IGNORE_LABEL).alias("ignore_share"), share(0).alias("other_share")).withColumns({"warn_ignore": F.col("ignore_share") > 0.3, "warn_other": F.col("other_share") < 0.05})


def label_audit(df: DataFrame, split: str = "split", by=BY) -> DataFrame:
    """Per split: tiles, points and label shares, with the warnings of the training split."""
    share = lambda k: (F.count_if(F.col("label") == k) / F.count("*"))
    out = df.groupBy(split).agg(F.count_distinct(*by).alias("n_tiles"), F.count("*").alias("n_points"), share(1).alias("ground"), share(0).alias("other"), share(IGNORE_LABEL).alias("ignored"))
    train = F.col(split) == "train"
    return out.withColumns({"warn_ignore": train & (F.col("ignored") > 0.3), "warn_other": train & (F.col("other") < 0.05)})


def wide_channels(stats: DataFrame, limit: float = 10.0) -> DataFrame:
    """channel, mean and std of the channels whose mean is beyond the limit."""
    return stats.select(F.posexplode("mean").alias("channel", "mean"), "std").select("channel", "mean", F.get("std", F.col("channel")).alias("std")).filter(F.abs("mean") > limit)


def repetition_factor(df: DataFrame, draws: int, by=BY) -> DataFrame:
    """n_tiles, views of a tile in an epoch of so many draws, and whether that is over 8."""
    return df.agg(F.count_distinct(*by).alias("n_tiles")).withColumn("views", F.lit(float(draws)) / F.greatest(F.col("n_tiles"), F.lit(1))).withColumn("warn", F.col("views") > 8)


def region_report(df: DataFrame) -> DataFrame:
    """tiles and candidates per region, per split and in all (grouping sets), with the share of candidates."""
    sets = df.groupingSets([["region"], ["split"], []], "region", "split").agg(F.count("*").alias("n_tiles"), F.sum("n_candidates").alias("n_candidates"))
    total = F.max("n_candidates").over(Window.partitionBy())
    return sets.withColumn("share", F.col("n_candidates") / total).orderBy(F.desc("n_candidates"), "region", "split")


def class_weights(df: DataFrame, label: str = "label", clip: float = 10.0, ignore: int = IGNORE_LABEL) -> DataFrame:
    """label, n and weight: inverse counts over their mean, within [1 / clip, clip]."""
    n = df.filter(F.col(label) != ignore).groupBy(label).agg(F.count("*").alias("n"))
    inverse = 1 / F.greatest(F.col("n"), F.lit(1))
    return n.withColumn("weight", F.least(F.greatest(inverse / F.avg(inverse).over(Window.partitionBy()), F.lit(1 / clip)), F.lit(float(clip))))


def candidate_counts(members: DataFrame, floor: int, key: str = "center_id") -> DataFrame:
    """n of members of each centre, at least floor."""
    return members.groupBy(*BY, key).agg(F.greatest(F.count("*"), F.lit(floor).cast("long")).alias("n"))


def batch_limit(counts: DataFrame, batch_num: int, weight: str | None = None) -> DataFrame:
    """limit: points of a batch of batch_num and a half mean items, weighted if asked, at least 1."""
    mean = F.sum(F.col("n") * F.col(weight)) / F.sum(weight) if weight else F.avg("n")
    return counts.agg(F.greatest(F.bround((batch_num + 0.5) * mean, 0).cast("long"), F.lit(1).cast("long")).alias("limit"))


#: Boxes of the six globals of the spike corrector: name, lowest, highest, value taken here. Fixed values.
GLOBALS = (("theta0", 5.0, 30.0, 10.0), ("alpha", 0.3, 0.9, 0.5), ("beta", 0.0, 0.99, 0.7), ("n_mad", 2.0, 4.0, 3.0), ("floor", 0.1, 1.0, 0.1))
RES_BOX = (0.5, 8.0)


def regime_targets(df: DataFrame, min_ground: int = 32, by=BY) -> DataFrame:
    """The six corrector globals per cloud: five fixed ones and base_res = sqrt(8 / density of ground), the middle of its box with too few."""
    ground = F.col("label") == 1
    extent = lambda c: F.max(F.when(ground, F.col(c))) - F.min(F.when(ground, F.col(c))) + 1e-9
    per = df.groupBy(*by).agg(F.count_if(ground).alias("n_ground"), (extent("x") * extent("y")).alias("_area"))
    density = F.greatest(F.col("n_ground") / F.col("_area"), F.lit(1e-6))
    res = F.when(F.col("n_ground") < min_ground, F.lit(sum(RES_BOX) / 2)).otherwise(F.sqrt(8 / density))
    fixed = {n: F.lit(min(max(v, lo), hi)) for n, lo, hi, v in GLOBALS}
    return per.withColumns({**fixed, "base_res": F.least(F.greatest(res, F.lit(RES_BOX[0])), F.lit(RES_BOX[1]))}).drop("_area")


def prediction_stats(df: DataFrame, by=BY) -> DataFrame:
    """Eight statistics of a prediction per cloud: ground share, mean height of ground over that of all, spreads, height range, size, mean probability and the ground's share of the spread.

    Heights are in tens of metres, the range is cut at 10 km before. Without ground its mean and spread are 0; null, NaN and infinity count as 0.
    """
    ground = F.col("pred") == 1
    z = F.when(ground, F.col("z"))
    finite = lambda c: F.coalesce(F.when(F.abs(c) < float("inf"), F.nanvl(c, F.lit(0.0))), F.lit(0.0))
    spread, spread_all = F.coalesce(F.stddev_pop(z), F.lit(0.0)), F.stddev_pop("z")
    stats = {
        "ground_share": F.avg(F.coalesce(ground, F.lit(False)).cast("double")),
        "dz": (F.coalesce(F.avg(z), F.lit(0.0)) - F.avg("z")) / 10,
        "std_ground": spread / 10,
        "std_all": spread_all / 10,
        "z_range": F.least(F.greatest(F.max("z") - F.min("z"), F.lit(0.0)), F.lit(1e4)) / 10,
        "log_n": F.log(F.count("*").cast("double")) - 12,
        "mean_p": F.avg("p_ground"),
        "std_ratio": spread / (spread_all + 1e-3),
    }
    return df.groupBy(*by).agg(*[finite(v).alias(k) for k, v in stats.items()])


def scene_stats(per_disc: DataFrame, scene: str) -> DataFrame:
    """The mean over a scene's discs of each statistic."""
    return per_disc.groupBy(scene).agg(*[F.avg(c).alias(c) for c in per_disc.columns if c not in (scene, *BY)])


def coverage_filter(centres: DataFrame, cells: DataFrame, x_min: float, y_min: float, res: float, min_cov: float, by=BY) -> DataFrame:
    """Centres of the clouds whose centres lie on valid cells (cloud, row, col, value) often enough."""
    at = centres.withColumns({"row": F.floor((F.col("y") - y_min) / res), "col": F.floor((F.col("x") - x_min) / res)})
    valid = at.join(cells.select(*by, "row", "col", F.col("value").isNotNull().cast("double").alias("_v")), [*by, "row", "col"], "left")
    good = valid.groupBy(*by).agg(F.avg(F.coalesce("_v", F.lit(0.0))).alias("_cov")).filter(F.col("_cov") >= min_cov)
    return centres.join(good, list(by), "left_semi")

