"""Exact quantiles of groups of any size, by refined histograms; no task ever holds a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terraframe.functions.tables import written

#: Values that may meet in one place; buckets of a round; groups that are broadcast at most.
HELD, BUCKETS, BROADCAST_GROUPS = 65_536, 1_024, 100_000


def _same(rows: DataFrame, state: DataFrame, by: list[str], n: int) -> DataFrame:
    """rows beside what is known of their group: broadcast where that was counted as small, else merged."""
    return rows.join(F.broadcast(state) if n <= BROADCAST_GROUPS else state.hint("merge"), by)


def quantiles(df: DataFrame, value: str | Column, probs: list[float], by: list[str] | tuple[str, ...], stored: bool = False) -> DataFrame:
    """by and q, the interpolated quantiles of value at probs (as percentile gives them), for every group with a value.

    Each quantile lies between two ranks of its group. A round counts the values of the range that holds a rank in
    BUCKETS parts, with the lowest and highest value of each part, and goes on with the part that the rank falls in, until
    that has one value only or HELD values at most. Parts are even in the value and, each other round, in its logarithm, for
    values of very different size. What moves is a row a part; the values stay where they are. stored tells
    that df is a written table already. Nulls and NaN take no part.
    """
    by = list(by)
    col = F.col(value) if isinstance(value, str) else value
    rows = df.select(*by, col.cast("double").alias("_v")).filter("_v IS NOT NULL AND NOT isnan(_v)")
    rows = rows if stored else written(rows, "quantile-values")
    if rows.count() <= HELD:
        return rows.groupBy(*by).agg(F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs])).alias("q"))
    sizes = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    groups = written(sizes, "quantile-groups")
    ranks = F.array_distinct(F.array(*[F.least(F.floor(F.lit(float(p)) * (F.col("_n") - 1)) + e, F.col("_n") - 1) for p in probs for e in (0, 1)]))
    state = written(groups.select(*by, F.explode(ranks).alias("_rank"), "_lo", "_hi", F.col("_n").alias("_in")).withColumn("_left", F.col("_rank")), "quantile-ranges")
    within = (F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi"))
    scale = lambda c: F.signum(c) * (F.log2(F.nullif(F.abs(c), F.lit(0.0))) + 1100)
    turn = 0
    while True:
        wide = f"_in > {HELD} AND _lo < _hi"
        n = state.filter(wide).count()
        if not n:
            break
        # halves first, so that the span of the largest doubles doesn't overflow
        at = (lambda c: F.coalesce(scale(F.col(c)), F.lit(0.0))) if turn % 2 else lambda c: F.col(c) / 2
        share = F.coalesce((at("_v") - at("_lo")) / F.nullif(at("_hi") - at("_lo"), F.lit(0.0)), F.lit(0.0))
        part, turn = F.least(F.floor(share * BUCKETS), F.lit(BUCKETS - 1).cast("long")), turn + 1
        counts = _same(rows, state.filter(wide), by, n).filter(within).groupBy(*by, "_rank", part.alias("_part")).agg(F.first("_left").alias("_left"), F.count("*").alias("_in"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
        before = F.coalesce(F.sum("_in").over(Window.partitionBy(*by, "_rank").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        hit = counts.withColumn("_b", before).filter((F.col("_left") >= F.col("_b")) & (F.col("_left") < F.col("_b") + F.col("_in")))
        narrowed = hit.select(*by, "_rank", "_lo", "_hi", "_in", (F.col("_left") - F.col("_b")).alias("_left"))
        state = written(state.filter(f"NOT ({wide})").unionByName(narrowed), "quantile-ranges")
    known = state.filter("_lo = _hi").select(*by, "_rank", F.col("_lo").alias("_x"))
    few = state.filter("_lo < _hi")
    met = _same(rows, few, by, few.count()).filter(within).groupBy(*by, "_rank").agg(F.get(F.array_sort(F.collect_list("_v")), F.first("_left").cast("int")).alias("_x"))
    found = known.unionByName(met).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_x"))).alias("_at"))

    def one(p: float) -> Column:
        h = F.lit(float(p)) * (F.col("_n") - 1)
        low, high = F.col("_at")[F.floor(h)], F.col("_at")[F.least(F.floor(h) + 1, F.col("_n") - 1)]
        return low + (high - low) * (h - F.floor(h))

    return found.join(groups.hint("merge"), by).select(*by, F.array(*[one(p) for p in probs]).alias("q"))
