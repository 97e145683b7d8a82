"""Connected components: links become a forest, and the forest's paths are halved to its roots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terraframe.llm._common import written


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable) for every node of edges (u, v).

    Links point from the larger node to the smaller. While a node has several smaller neighbours, it keeps
    the smallest and hands the others on to it, which leaves connections as they are; once every node has one, the
    links are a forest, and each node takes its parent's parent until all point at roots. A round takes the
    smallest neighbour by an aggregate and joins it to the links, so no row ever holds the links of a hub, and
    Spark may split the hub's part of the join. Nodes and links stay in tables; the driver sees whether a round
    changed anything. Self-links and repeats are dropped; nulls must not occur.
    """
    links = written(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.lit(True).alias("handed")), "links")
    while not links.filter("handed").isEmpty():
        first = links.groupBy("u").agg(F.min("v").alias("first"))
        on = F.col("v") > F.col("first")
        met = links.join(first.hint("merge"), "u")
        links = written(met.select(F.when(on, F.col("v")).otherwise(F.col("u")).alias("u"), F.col("first").alias("v"), on.alias("handed")).distinct(), "links")
    tree = links.select(F.col("u").alias("node"), F.col("v").alias("comp"))
    while True:
        over = tree.select(F.col("node").alias("comp"), F.col("comp").alias("_next"))
        moved = written(tree.join(over, "comp", "left").select("node", F.coalesce("_next", "comp").alias("comp"), F.col("_next").isNotNull().alias("moved")), "forest")
        tree = moved.select("node", "comp")
        if moved.filter("moved").isEmpty():
            break
    return tree.unionByName(tree.select(F.col("comp").alias("node"), "comp").distinct())
