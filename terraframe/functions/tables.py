"""Tables written in the shared folder to cut lineage; see spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the session's checkpoint folder; a local one where none is set and all run on one machine."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-terraframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    path = f"{where.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over the session's shuffle partitions, few bytes or not: for groups whose work is larger than their rows."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def running(rows: DataFrame, by: tuple[str, ...] | list[str], order: list[str | Column], label: str, **values: Column) -> DataFrame:
    """rows with, under each name of values, the sum of that value over the rows before it in its group, and under <name>_all over the whole group.

    Two levels: a range sort by group and order cuts the rows into even parts, however large a group is; each part
    sums its own rows and adds what the group has in the parts before. Those offsets are at most a row a part and
    a group, and are broadcast.
    """
    own = {f"_v_{k}": v for k, v in values.items()}
    ranged = written(rows.withColumns(own).repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()), label)
    sums = ranged.groupBy(*by, "_part").agg(*[F.sum(v).alias(v) for v in own])
    group = Window.partitionBy(*by)
    before = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = sums.select(*by, "_part", *[zero(F.sum(v).over(before)).alias(f"_o{v}") for v in own], *[F.sum(f"_v_{k}").over(group).alias(f"{k}_all") for k in values])
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    keys = [*by, "_part"]
    offsets = offsets.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *offsets.columns[len(keys) :])
    same = F.lit(True)
    for i, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_k{i}"))
    out = ranged.withColumns({f"_s{v}": zero(F.sum(v).over(inside)) for v in own}).join(F.broadcast(offsets), same)
    return out.withColumns({k: F.col(f"_o_v_{k}") + F.col(f"_s_v_{k}") for k in values}).select(*rows.columns, *values, *[f"{k}_all" for k in values])


def last_seen(rows: DataFrame, order: list[str], value: Column, out: str, label: str) -> DataFrame:
    """rows with, under `out`, the last value that isn't null at or before each row in `order`, over all rows.

    As running() does, a range sort cuts rows into even parts, each part looks at its own rows, and what the last part before had
    comes from a row a part. So two sorted streams, put in one table, are merged in a single pass.
    """
    ranged = written(rows.withColumn("_value", value).repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)
    ends = ranged.filter("_value IS NOT NULL").groupBy("_part").agg(F.max_by("_value", F.struct(*order)).alias("_end"))
    parts = ranged.select("_part").distinct().join(ends, "_part", "left")
    earlier = F.last("_end", True).over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    before = parts.select("_part", earlier.alias("_before"))  # a row a part
    inside = F.last("_value", True).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn(out, inside).join(F.broadcast(before), "_part").withColumn(out, F.coalesce(out, "_before")).select(*rows.columns, out)
