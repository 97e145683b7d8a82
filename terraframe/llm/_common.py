"""Helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space, tab, line feed, vertical tab, form feed, return.
WORD_GAP = r"[\x20\x09-\x0D]+"
BITMAP_ROWS = 256
BATCH_BYTES = "4m"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one where none is set and all run on one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-terraframe-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def in_small_batches(df: DataFrame) -> DataFrame:
    """df for a function over Arrow batches: the session cuts them at BATCH_BYTES, so that long texts don't pile up between Spark and Python.

    Columns are named by place, as such functions can't take a name with a dot.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage is cut, lost executors cost nothing, and the size is known."""
    spark = df.sparkSession
    path = new_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _bit(key: tuple[str, ...]) -> tuple[Column, Column]:
    spread = F.xxhash64(*key)
    return F.pmod(spread, F.lit(BITMAP_ROWS)).cast("int"), F.pmod(F.shiftright(spread, 8), F.lit(32768)).cast("int")


def bitmap(rows: DataFrame, *key: str) -> DataFrame:
    """The keys of rows as a bitmap of fixed size (BITMAP_ROWS x 32,768 bits, 1 MB), written: small enough to broadcast at any size."""
    row, bit = _bit(key)
    return written(rows.groupBy(row.alias("_slot")).agg(F.bitmap_construct_agg(bit.cast("long")).alias("_bits")), "bitmap")


def marked(rows: DataFrame, bits: DataFrame, *key: str) -> DataFrame:
    """rows with _marked: true for every key of the bitmap, and for a few others whose bit is set by chance."""
    row, bit = _bit(key)
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    tested = rows.withColumn("_slot", row).join(F.broadcast(bits), "_slot", "left")
    return tested.withColumn("_marked", F.coalesce(F.getbit(byte, bit.bitwiseAND(7)), F.lit(0)) == 1).drop("_slot", "_bits")


def less(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """rows (doc_id, ...) whose doc_id is not in gone (_gone, of the same type).

    Most rows pass by the bitmap of gone and stay where they are; only rows that it marks are joined.
    """
    flagged = marked(rows.withColumn("_key", F.col("doc_id")), bitmap(gone.select(F.col("_gone").alias("_key")), "_key"), "_key").drop("_key")
    doubtful = flagged.filter("_marked")
    left = doubtful.join(gone.hint("merge"), doubtful["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")
    return flagged.filter("NOT _marked").unionByName(left).drop("_marked")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less columns of these names: what an operator makes replaces input columns of the same name."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Texts of one byte a character take the fast built-in, which does the same there."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_count(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, WORD_GAP), lambda w: w != "")), F.lit(0)).cast("long")


def prefix_sums(rows: DataFrame, order: list[str], value: str, out: str, label: str) -> DataFrame:
    """rows with `out`: the sum of `value` over all rows before, in `order`.

    Two levels: a range sort cuts the rows into even, ordered parts, however few keys they have; each part
    sums its own rows and adds the totals of the parts before it. The totals are one row a partition, so
    the window over them and their broadcast stay small at any size.
    """
    ranged = rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    parts = written(ranged, label)
    totals = parts.groupBy("_part").agg(F.sum(value).alias("_total"))
    offsets = totals.select("_part", F.coalesce(F.sum("_total").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    local = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    summed = parts.join(F.broadcast(offsets), "_part")
    return summed.withColumn(out, F.col("_offset") + F.coalesce(F.sum(value).over(local), F.lit(0))).drop("_part", "_offset")
