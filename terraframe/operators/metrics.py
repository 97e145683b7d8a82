"""Quality as aggregates: confusion, segmentation scores, elevation error, losses and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraframe.functions.quantiles import quantiles
from terraframe.functions.tables import running, written
from terraframe.operators.project import BY, IGNORE_LABEL
from terraframe.operators.surface import tin_surface

EPS = 1e-8


def confusion(df: DataFrame, pred: str = "pred", label: str = "label", by=()) -> DataFrame:
    """tp1, fp1 of non-ground and tp2, fp2 of ground, over labels 0 and 1; counts add up over clouds."""
    y, p = F.col(label), F.col(pred)
    return df.filter(y.isin(0, 1)).groupBy(*by).agg(
        F.count_if((y == 0) & (p == 0)).alias("tp1"), F.count_if((y == 1) & (p == 1)).alias("tp2"),
        F.count_if((y == 1) & (p == 0)).alias("fp1"), F.count_if((y == 0) & (p == 1)).alias("fp2"),
    )


def segmentation_metrics(conf: DataFrame) -> DataFrame:
    """IoU of non-ground and ground, accuracy, kappa, MCC and mean IoU, all x 100; guarded where a count is zero."""
    a, b, c, d = (F.col(k).cast("double") for k in ("tp1", "tp2", "fp1", "fp2"))
    n = a + b + c + d
    iou1, iou2, oa = a / (a + c + d + EPS), b / (b + c + d + EPS), (a + b) / (n + EPS)
    chance = ((a + c) * (a + d) + (b + d) * (b + c)) / (n * n + EPS)
    mcc = (a * b - c * d) / (F.sqrt((a + c) * (a + d) * (b + c) * (b + d)) + EPS)
    cols = {"iou_nonground": iou1, "iou_ground": iou2, "oa": oa, "kappa": (oa - chance) / (1 - chance + EPS), "mcc": mcc, "miou": (iou1 + iou2) / 2}
    return conf.withColumns({k: v * 100 for k, v in cols.items()})


def binary_metrics(df: DataFrame, pred: str = "pred", label: str = "label", by=()) -> DataFrame:
    """precision, recall and F1 of ground, both IoUs and accuracy in percent, MCC and kappa as they are."""
    out = segmentation_metrics(confusion(df, pred, label, by))
    b, c, d = (F.col(k).cast("double") for k in ("tp2", "fp1", "fp2"))
    precision, recall = b / (b + d + EPS), b / (b + c + EPS)
    return out.withColumns({"precision": precision * 100, "recall": recall * 100, "f1": 200 * precision * recall / (precision + recall + EPS), "mcc": F.col("mcc") / 100, "kappa": F.col("kappa") / 100})


def corners(df: DataFrame, res: float, by=BY) -> DataFrame:
    """_x0, _y0, _h, _w of each cloud: the corner of its points and its height and width in cells, one at least."""
    n = lambda c: F.greatest(F.ceil((F.max(c) - F.min(c)) / res), F.lit(1).cast("long"))
    return df.groupBy(*by).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), n("y").alias("_h"), n("x").alias("_w"))


def _surface(df: DataFrame, rows: Column, res: float, name: str, by) -> DataFrame:
    at = lambda c, n: F.least(F.floor((F.col(c) - F.col(f"_{c}0")) / res), F.col(n) - 1)
    return df.filter(rows).groupBy(*by, at("y", "_h").alias("row"), at("x", "_w").alias("col")).agg(F.avg("z").alias(name))


def dtm_errors(df: DataFrame, res: float = 1.0, pred: str = "pred", label: str = "label", by=BY, surface: str = "cell") -> DataFrame:
    """error of the predicted elevation against the true one per cell, where both exist; clouds need three points of each.

    Cells count from the corner of all points of a cloud. surface cell takes the mean height of a cell's points, tin
    the surface triangulated over the whole cloud at its centre; see tin_surface().
    """
    is_true, is_pred = F.col(label) == 1, (F.col(pred) == 1) & F.col(label).isin(0, 1)
    enough = df.groupBy(*by).agg(F.count_if(F.col(label) == 1).alias("_t"), F.count_if(is_pred).alias("_p")).filter("_t >= 3 AND _p >= 3").select(*by)
    rows = df.join(corners(df, res, by).join(enough, list(by), "left_semi"), list(by))
    if surface == "tin":
        true, made = (tin_surface(rows.filter(c), res, n, by) for c, n in ((is_true, "z_true"), (is_pred, "z_pred")))
    else:
        true, made = (_surface(rows, c, res, n, by) for c, n in ((is_true, "z_true"), (is_pred, "z_pred")))
    return true.join(made.hint("shuffle_merge"), [*by, "row", "col"]).withColumn("error", F.col("z_pred") - F.col("z_true"))


def dtm_rmse(df: DataFrame, res: float = 1.0, pred: str = "pred", label: str = "label", by=BY, surface: str = "cell") -> DataFrame:
    """sse and n per cloud over elevation cells, both 0 where its elevations aren't defined; total_rmse over all clouds, null without any cell."""
    per = dtm_errors(df, res, pred, label, by, surface).groupBy(*by).agg(F.sum(F.col("error") * F.col("error")).alias("sse"), F.count("*").alias("n"))
    every = Window.partitionBy()
    whole = df.select(*by).distinct().join(per, list(by), "left").select(*by, F.coalesce("sse", F.lit(0.0)).alias("sse"), F.coalesce("n", F.lit(0)).alias("n"))
    return whole.withColumn("total_rmse", F.when(F.sum("n").over(every) > 0, F.sqrt(F.sum("sse").over(every) / F.sum("n").over(every))))


def aggregate_error(errors: DataFrame, by=BY, clouds: DataFrame | None = None) -> DataFrame:
    """rmse, p95, p99 and max of the absolute cell errors; infinite for those of clouds that have none."""
    e = F.abs("error")
    held = written(errors.select(*by, "error"), "cell-errors")
    tails = quantiles(held, e, [0.95, 0.99], by, stored=True)
    out = held.groupBy(*by).agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.max(e).alias("max_error")).join(tails, list(by))
    out = out.select(*by, "rmse", F.get("q", F.lit(0)).alias("p95"), F.get("q", F.lit(1)).alias("p99"), "max_error")
    if clouds is None:
        return out
    inf = F.lit(float("inf"))
    return clouds.select(*by).distinct().join(out, list(by), "left").select(*by, *[F.coalesce(c, inf).alias(c) for c in ("rmse", "p95", "p99", "max_error")])


def lovasz(df: DataFrame, p: str = "p_ground", label: str = "label", ignore: int = IGNORE_LABEL, by=BY) -> DataFrame:
    """Mean over present classes of the Lovász extension of the Jaccard loss, per cloud.

    Per class the errors are sorted downwards and weighted by the steps of the Jaccard loss along that order.
    """
    rows = df.filter(F.col(label) != ignore)
    classes = rows.select(*by, "pid", F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), (F.col(label) == c).cast("double").alias("fg"), F.abs((F.col(label) == c).cast("double") - (F.col(p) if c == 1 else 1 - F.col(p))).alias("err")) for c in (0, 1)])).alias("c")).select(*by, "pid", "c.cls", "c.fg", "c.err")
    # the loss after k errors with h hits is 1 - (total - h) / (total + k - h); a row's step is that with it less that without it
    before = running(classes, (*by, "cls"), [F.desc("err"), "pid"], "errors", _hit=F.col("fg"), _k=F.lit(1).cast("long")).filter("_hit_all > 0")
    total = F.col("_hit_all")
    loss = lambda h, k: 1 - (total - h) / (total + k - h)
    step = loss(F.col("_hit") + F.col("fg"), F.col("_k") + 1) - loss(F.col("_hit"), F.col("_k"))
    per = before.groupBy(*by, "cls").agg(F.sum(F.col("err") * step).alias("loss"))
    return per.groupBy(*by).agg(F.avg("loss").alias("lovasz"))


def cross_entropy(df: DataFrame, p: str = "p_ground", label: str = "label", ignore: int = IGNORE_LABEL, by=BY) -> DataFrame:
    right = F.when(F.col(label) == 1, F.col(p)).otherwise(1 - F.col(p))
    fine = (F.col(label) != ignore) & F.col(p).isNotNull() & ~F.isnan(p)
    return df.filter(fine).groupBy(*by).agg(F.avg(-F.log(F.least(F.greatest(right, F.lit(1e-7)), F.lit(1.0)))).alias("cross_entropy"))


def ndsm_loss(df: DataFrame, pred: str, target: str, scale: float = 10.0, label: str = "label", ignore: int = IGNORE_LABEL, by=BY) -> DataFrame:
    """l1 and l2 of (pred - target) / scale over rows with both and a label that is not ignored."""
    d = (F.col(pred) - F.col(target)) / scale
    fine = d.isNotNull() & ~F.isnan(d) & (F.col(label) != ignore)
    return df.filter(fine).groupBy(*by).agg(F.avg(F.abs(d)).alias("l1"), F.avg(d * d).alias("l2"))


def evaluate(df: DataFrame, raw: str = "pred", refined: str = "refined", label: str = "label") -> DataFrame:
    """Scores of both predictions side by side (suffix _raw for the first), and how many points the second moved."""
    names = ("iou_nonground", "iou_ground", "oa", "kappa", "mcc", "miou")
    one = segmentation_metrics(confusion(df, raw, label)).select(*[F.col(n).alias(f"{n}_raw") for n in names])
    two = segmentation_metrics(confusion(df, refined, label)).select(*names)
    moved = df.agg(F.count_if(F.col(raw) != F.col(refined)).alias("n_reclassified"), F.avg((F.col(raw) != F.col(refined)).cast("double")).alias("reclassified_frac"))
    return two.crossJoin(F.broadcast(one)).crossJoin(F.broadcast(moved))  # one row each


def best_run(history: DataFrame, metric: str = "miou", epoch: str = "epoch") -> DataFrame:
    """The row with the largest finite metric, the first on ties."""
    fine = F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(metric) < float("inf"))
    return history.filter(fine).orderBy(F.desc(metric), epoch).limit(1)


def ema_best(history: DataFrame, metric: str, epoch: str = "epoch", keep: float = 0.9) -> DataFrame:
    """epoch and value of the smallest exponential moving average of a metric, in one fold over the epochs; those without a finite value are passed over."""
    fine = F.col(metric).isNotNull() & ~F.isnan(metric) & (F.abs(metric) < float("inf"))
    listed = history.filter(fine).agg(F.array_sort(F.collect_list(F.struct(F.col(epoch).cast("long").alias("e"), F.col(metric).cast("double").alias("m")))).alias("h"))
    none = F.lit(None)
    start = F.struct(none.cast("double").alias("ema"), none.cast("double").alias("best"), none.cast("long").alias("at"))

    def step(s: Column, x: Column) -> Column:
        ema = F.when(s["ema"].isNull(), x["m"]).otherwise(keep * s["ema"] + (1 - keep) * x["m"])
        better = s["best"].isNull() | (ema < s["best"])
        return F.struct(ema.alias("ema"), F.when(better, ema).otherwise(s["best"]).alias("best"), F.when(better, x["e"]).otherwise(s["at"]).alias("at"))

    return listed.select(F.aggregate("h", start, step).alias("s")).select(F.col("s.at").alias(epoch), F.col("s.best").alias("ema"))


def profile(df: DataFrame, band: float = 0.06, bins: int = 80, pct: float = 0.3, label: str = "label", by=BY) -> DataFrame:
    """Ground line of each cloud along x: x (the middle of the bin, from the cloud's corner), z and n of each bin.

    The line is made of the label-1 points whose y is within max(6 % of the extent, 1) of the median, or 15 % of the extent where that
    band holds fewer than 60 points, or of all points where it holds none. Bins part the ground points' own x range; a bin's z is a
    low percentile, gaps are filled linearly. Fewer than four ground points, or all in one bin, give no line.
    """
    held = written(df.select(*by, "x", "y", "z", label), "profile-points")
    mid = quantiles(held, "y", [0.5], by, stored=True)
    frame = held.groupBy(*by).agg((F.max("y") - F.min("y")).alias("_ey"), F.min("x").alias("_xmin")).join(mid, list(by)).withColumn("_my", F.get("q", F.lit(0))).drop("q")
    rows = held.join(frame, list(by))
    off = F.abs(F.col("y") - F.col("_my"))
    first, second = off <= F.greatest(F.col("_ey") * band, F.lit(1.0)), off <= F.col("_ey") * 0.15
    counts = rows.groupBy(*by).agg(F.count_if(first).alias("_n1"), F.count_if(second).alias("_n2"))
    inside = F.when(F.col("_n1") >= 60, first).otherwise(second | (F.col("_n2") == 0))
    line = written(rows.join(counts, list(by)).filter(inside & (F.col(label) == 1)).select(*by, (F.col("x") - F.col("_xmin")).alias("x"), "z"), "profile-line")
    ends = line.groupBy(*by).agg(F.min("x").alias("_x0"), F.max("x").alias("_x1"), F.count("*").alias("_n")).filter("_n >= 4").drop("_n")
    width = (F.col("_x1") - F.col("_x0")) / bins
    at = F.when(F.col("_x1") > F.col("_x0"), F.least(F.floor((F.col("x") - F.col("_x0")) / F.nullif(width, F.lit(0.0))), F.lit(bins - 1).cast("long"))).otherwise(F.lit(bins - 1).cast("long"))
    binned = written(line.join(ends, list(by)).select(*by, at.alias("bin"), "z"), "profile-bins")
    low = quantiles(binned, "z", [pct], (*by, "bin"), stored=True).join(binned.groupBy(*by, "bin").agg(F.count("*").alias("n")), [*by, "bin"]).select(*by, "bin", F.get("q", F.lit(0)).alias("_z"), "n")
    several = low.groupBy(*by).agg(F.count("*").alias("_k")).filter("_k >= 2").select(*by)
    every = ends.join(several, list(by), "left_semi").withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    full = every.join(low.hint("shuffle_merge"), [*by, "bin"], "left")
    w = Window.partitionBy(*by).orderBy("bin")
    back, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(0, Window.unboundedFollowing)
    seen = F.when(F.col("_z").isNotNull(), F.col("bin"))
    b0, b1 = F.last(seen, True).over(back), F.first(seen, True).over(ahead)
    z0, z1 = F.last("_z", True).over(back), F.first("_z", True).over(ahead)
    filled = F.when(b0.isNull(), z1).when(b1.isNull() | (b0 == b1), z0).otherwise(z0 + (z1 - z0) * (F.col("bin") - b0) / (b1 - b0))
    return full.withColumns({"z": filled, "x": F.col("_x0") + (F.col("bin") + 0.5) * width}).select(*by, "bin", "x", "z", F.coalesce("n", F.lit(0)).alias("n"))


def error_points(df: DataFrame, pred: str = "pred", label: str = "label", by=BY) -> DataFrame:
    """n and share per kind of outcome: correct, ground taken for other, other taken for ground."""
    kind = F.when(F.col(pred) == F.col(label), "correct").when(F.col(label) == 1, "ground_to_other").otherwise("other_to_ground")
    n = df.filter(F.col(label).isin(0, 1)).groupBy(*by, kind.alias("outcome")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def surface_cells(df: DataFrame, cell: float | None, reduce: str = "max", by=BY) -> DataFrame:
    """One representative a cell: the highest point with its place; or the mean place with the lowest z, or the mean of the lowest fifth.

    Cells count from the corner of each cloud's points; without a size they are a 160th of its longer side.
    """
    side = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")) / 160
    frame = df.groupBy(*by).agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"), F.greatest(F.lit(float(cell)) if cell else side, F.lit(1e-6)).alias("_cell"))
    keyed = df.join(frame, list(by)).withColumns({"row": F.floor((F.col("y") - F.col("_y0")) / F.col("_cell")), "col": F.floor((F.col("x") - F.col("_x0")) / F.col("_cell"))})
    keys = [*by, "row", "col"]
    if reduce == "max":
        top = F.max_by(F.struct("x", "y", "z"), F.struct(F.col("z"), (-F.col("pid")).alias("p")))
        return keyed.groupBy(*keys).agg(top.alias("t")).select(*keys, "t.x", "t.y", "t.z")
    if reduce == "min":
        return keyed.groupBy(*keys).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.min("z").alias("z"))
    held = written(keyed.select(*keys, "x", "y", "z"), "surface-cells")
    cut = quantiles(held, "z", [0.2], keys, stored=True).select(*keys, F.get("q", F.lit(0)).alias("_q"))
    return held.join(cut.hint("merge"), keys).groupBy(*keys).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg(F.when(F.col("z") <= F.col("_q"), F.col("z"))).alias("z"))


def z_range(df: DataFrame, by=BY) -> DataFrame:
    """z_lo, z_hi: the 2nd and 98th percentile; where they meet the lowest and highest z, and where these do, one unit up from the lowest."""
    held = written(df.select(*by, "z"), "heights")
    ends = held.groupBy(*by).agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"))
    q = quantiles(held, "z", [0.02, 0.98], by, stored=True).join(ends, list(by))
    flat = F.get("q", F.lit(1)) - F.get("q", F.lit(0)) < 1e-6
    lo, hi = F.when(flat, F.col("_lo")).otherwise(F.get("q", F.lit(0))), F.when(flat, F.col("_hi")).otherwise(F.get("q", F.lit(1)))
    return q.select(*by, lo.alias("z_lo"), F.when(hi - lo < 1e-6, lo + 1).otherwise(hi).alias("z_hi"))


def refine_report(df: DataFrame, res: float = 1.0, by=BY) -> DataFrame:
    """Per cloud: points moved by refinement, elevation error and ground IoU before and after."""
    def side(pred: str, tag: str) -> DataFrame:
        err = dtm_errors(df, res, pred, by=by).groupBy(*by).agg(F.sqrt(F.avg(F.col("error") * F.col("error"))).alias(f"rmse_{tag}"))
        iou = segmentation_metrics(confusion(df, pred, by=by)).select(*by, F.col("iou_ground").alias(f"iou_ground_{tag}"))
        return iou.join(err, list(by), "left")

    moved = df.groupBy(*by).agg(F.count_if(F.col("pred") != F.col("refined")).alias("n_reclassified"))
    return moved.join(side("pred", "before"), list(by), "left").join(side("refined", "after"), list(by), "left")
