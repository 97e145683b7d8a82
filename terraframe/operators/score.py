"""Scoring and voting: disc jobs, batch scorers, soft votes, averages over rotations, and a fitted baseline."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terraframe.operators.project import BY, IGNORE_LABEL
from terraframe.operators.raster import rotate90_points
from terraframe.operators.spatial import distance2, knn_join


def disc_jobs(df: DataFrame, step: float = 50.0, margin: float = 8.0, max_pts: int = 100_000, trim: bool = True, by=BY) -> DataFrame:
    """job, pid and central of every disc: one job for a cloud within max_pts, else discs on a grid.

    The central radius covers the grid; the context radius is larger by the margin or what max_pts allows at
    the cloud's density. Trimmed to max_pts: central points first, by hash.
    """
    size = df.groupBy(*by).agg(F.count("*").alias("_n"), *[F.min(c).alias(f"_lo{c}") for c in "xy"], *[F.max(c).alias(f"_hi{c}") for c in "xy"])
    small = df.join(size.filter(F.col("_n") <= max_pts).select(*by), list(by), "left_semi").select(*by, F.lit(0).cast("long").alias("job"), "pid", F.lit(True).alias("central"))
    large = size.filter(F.col("_n") > max_pts)
    central = math.sqrt(2) / 2 * step
    density = F.col("_n") / F.greatest((F.col("_hix") - F.col("_lox")) * (F.col("_hiy") - F.col("_loy")), F.lit(1e-6))
    context = F.greatest(F.lit(central + margin), F.sqrt(max_pts / (math.pi * density)))
    axis = lambda c: F.transform(F.sequence(F.lit(0).cast("long"), F.floor((F.col(f"_hi{c}") - F.col(f"_lo{c}")) / step)), lambda i: F.col(f"_lo{c}") + (i + 0.5) * step)
    discs = large.withColumn("_context", context).withColumn("x", F.explode(axis("x"))).withColumn("y", F.explode(axis("y")))
    discs = discs.withColumn("job", F.row_number().over(Window.partitionBy(*by).orderBy("x", "y")).cast("long")).select(*by, "job", "x", "y", "_context")
    # each cloud has cells of its own context radius, so a disc looks at the nine around its centre
    cell = lambda c: F.floor(F.col(c) / F.col("_context"))
    points = df.select(*by, "pid", "x", "y").join(large.select(*by, context.alias("_context")), list(by)).withColumns({"_cx": cell("x"), "_cy": cell("y")})
    asked = discs.withColumns({"_cx": F.explode(F.sequence(cell("x") - 1, cell("x") + 1))}).withColumn("_cy", F.explode(F.sequence(cell("y") - 1, cell("y") + 1)))
    asked = asked.select(*by, "_cx", "_cy", F.col("job").alias("q_job"), F.col("x").alias("q_x"), F.col("y").alias("q_y"))
    met = points.hint("shuffle_merge").join(asked, [*by, "_cx", "_cy"]).withColumn("d2", distance2(2)).filter(F.col("d2") <= F.col("_context") * F.col("_context"))
    jobs = met.select(*by, F.col("q_job").alias("job"), "pid", (F.col("d2") <= central * central).alias("central"))
    if trim:
        place = F.row_number().over(Window.partitionBy(*by, "job").orderBy(F.desc("central"), F.md5(F.concat_ws(":", "job", "pid")), "pid"))
        jobs = jobs.withColumn("_k", place).filter(F.col("_k") <= max_pts).drop("_k")
    return small.unionByName(jobs)


def score(df: DataFrame, model: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """df with p_other and p_ground from a batch scorer: a function of a frame that gives P(ground) of its rows."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in frames:
            p = model(g).astype(float)
            yield g.assign(p_other=1 - p, p_ground=p)

    return df.mapInPandas(run, f"{fields}, p_other double, p_ground double")


def soft_vote(votes: DataFrame, by=BY) -> DataFrame:
    """Per point the mean probabilities over the discs where it is central, the number of them, and pred (ties to 0)."""
    v = votes.filter("central").groupBy(*by, "pid").agg(F.sum("p_other").alias("s_other"), F.sum("p_ground").alias("s_ground"), F.count("*").alias("n_votes"))
    return v.withColumns({"p_ground": F.col("s_ground") / F.col("n_votes"), "p_other": F.col("s_other") / F.col("n_votes"), "pred": F.when(F.col("s_ground") > F.col("s_other"), 1).otherwise(0)})


def coverage_backstop(points: DataFrame, voted: DataFrame, by=BY) -> DataFrame:
    """A vote for every point: those without one take the sums and the count of the nearest voted point."""
    cols = ["s_other", "s_ground", "n_votes"]
    known = points.select(*by, "pid", "x", "y", "z").join(voted.select(*by, "pid", *cols), [*by, "pid"])
    bare = points.join(voted.select(*by, "pid"), [*by, "pid"], "left_anti")
    lent = knn_join(bare, known, 1, 3, by=by).select(*by, F.col("q_pid").alias("pid"), *cols)
    return known.select(*by, "pid", *cols).unionByName(lent)


def tta_scores(df: DataFrame, scorer: Callable[[DataFrame], DataFrame], cx: float, cy: float) -> DataFrame:
    """Scores of the four rotations of df, one below the other, with column turn."""
    out = None
    for k in range(4):
        one = scorer(rotate90_points(df, cx, cy, k)).withColumn("turn", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def tta_average(scores: DataFrame, by=BY) -> DataFrame:
    """The mean probability of each point over its rotations, and pred (ties to 0)."""
    p = scores.groupBy(*by, "pid").agg(F.avg("p_ground").alias("p_ground"))
    return p.withColumn("pred", F.when(F.col("p_ground") > 0.5, 1).otherwise(0))


def fit_ground_classifier(df: DataFrame, features: list[str], weights: DataFrame | None = None, params: tuple[float, ...] = (0.0, 0.01), valid=None):
    """The logistic model on standardised features with the best mean IoU over the regularisations tried.

    Rows of label 0 and 1 count, with the class weights (label, weight) if given; valid are the rows that choose,
    df itself by default. Returns the fitted pipeline and its mean IoU.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    from terraframe.operators.metrics import confusion, segmentation_metrics

    rows = df.filter(F.col("label") != IGNORE_LABEL).withColumn("label", F.col("label").cast("double"))
    rows = rows.join(weights.select(F.col("label").cast("double").alias("label"), "weight"), "label") if weights is not None else rows.withColumn("weight", F.lit(1.0))
    check = df if valid is None else valid
    best = None
    for reg in params:
        stages = [VectorAssembler(inputCols=features, outputCol="_raw"), StandardScaler(inputCol="_raw", outputCol="_features", withMean=True), LogisticRegression(featuresCol="_features", weightCol="weight", regParam=reg, maxIter=25)]
        model = Pipeline(stages=stages).fit(rows)
        out = model.transform(check).withColumn("pred", F.col("prediction").cast("int"))
        miou = segmentation_metrics(confusion(out)).first()["miou"]
        if best is None or miou > best[1]:
            best = (model, miou)
    return best
