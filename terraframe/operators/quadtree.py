"""Cells of very different density: a quadtree over each cloud whose leaves hold a bounded number of points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terraframe.functions.tables import written
from terraframe.operators.project import BY

#: Halvings of a cloud's square at most.
DEPTH = 12
#: Level at which points are counted first; leaves that are broadcast at most.
MIDDLE, BROADCAST_LEAVES = 6, 100_000


def squares(df: DataFrame, by=BY) -> DataFrame:
    """_qx, _qy and _side of each cloud: the corner and side of the square that holds its points."""
    side = F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)) * (1 + 1e-9)
    return df.groupBy(*by).agg(F.min("x").alias("_qx"), F.min("y").alias("_qy"), side.alias("_side"))


def finest(df: DataFrame, depth: int = DEPTH) -> DataFrame:
    """df (with _qx, _qy, _side) with the row _fy and column _fx of each point among the cells of the last level."""
    at = lambda c: F.least(F.greatest(F.floor((F.col(c) - F.col(f"_q{c}")) / F.col("_side") * 2**depth), F.lit(0).cast("long")), F.lit(2**depth - 1).cast("long"))
    return df.withColumns({"_fx": at("x"), "_fy": at("y")})


def up(cell: str | Column, steps: Column | int) -> Column:
    cell = F.col(cell) if isinstance(cell, str) else cell
    return F.call_function("shiftright", cell, steps if isinstance(steps, Column) else F.lit(steps))


def leaves(df: DataFrame, cap: int, by=BY, depth: int = DEPTH) -> DataFrame:
    """level, cx, cy and n of the cells that part each cloud's square, empty ones too, none with more than cap points but at the last level.

    df has _fx and _fy. Points are counted in the cells of a middle level, and those of cells with more than cap points once more in the
    cells of the last level; levels above add these counts up.
    """
    def counted(rows: DataFrame, last: int, first: int) -> DataFrame:
        low = rows.groupBy(*by, up("_fx", depth - last).alias("_fx"), up("_fy", depth - last).alias("_fy")).agg(F.count("*").alias("n"))
        each = low.select(*by, "_fx", "_fy", "n", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("level"))
        return each.groupBy(*by, "level", up("_fx", F.lit(last) - F.col("level")).alias("cx"), up("_fy", F.lit(last) - F.col("level")).alias("cy")).agg(F.sum("n").alias("n"))

    middle = min(MIDDLE, depth)
    cells = written(counted(df, middle, 0), "quadtree-cells")
    if middle < depth:
        dense = cells.filter((F.col("level") == middle) & (F.col("n") > cap)).select(*by, F.col("cx").alias("_mx"), F.col("cy").alias("_my"))
        if not dense.isEmpty():
            rows = df.select(*by, "_fx", "_fy").withColumns({"_mx": up("_fx", depth - middle), "_my": up("_fy", depth - middle)})
            cells = written(cells.unionByName(counted(rows.join(dense.hint("merge"), [*by, "_mx", "_my"], "left_semi"), depth, middle + 1)), "quadtree-cells")
    split = cells.filter((F.col("n") > cap) & (F.col("level") < depth))
    quarter = F.explode(F.array(*[F.struct((F.col("cx") * 2 + i).alias("cx"), (F.col("cy") * 2 + j).alias("cy")) for i in (0, 1) for j in (0, 1)])).alias("q")
    below = split.select(*by, (F.col("level") + 1).alias("level"), quarter).select(*by, "level", "q.cx", "q.cy")
    below = below.join(cells.hint("merge"), [*by, "level", "cx", "cy"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    small = (F.col("n") <= cap) | (F.col("level") == depth)
    return written(below.filter(small).unionByName(cells.filter("level = 0").filter(small)), "quadtree-leaves")


def beside(tree: DataFrame) -> DataFrame:
    """tree (written) for a join: broadcast where it was counted as small, else merged."""
    return F.broadcast(tree) if tree.count() <= BROADCAST_LEAVES else tree.hint("merge")
