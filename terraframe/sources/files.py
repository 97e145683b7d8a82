"""Sources and sinks: point tables, uncompressed LAS, headers, listings, height grids, tiles, classified output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terraframe.operators.project import BY, NOISE
from terraframe.sources.las import SPLIT, LasSource

def clean_points(df: DataFrame, drop_noise: bool = True) -> DataFrame:
    """Points with their defaults: one return, no intensity, not withheld; noise and withheld points dropped."""
    have = set(df.columns)
    one = lambda c, d, t: (F.coalesce(F.col(c), F.lit(d)) if c in have else F.lit(d)).cast(t)
    out = df.withColumns({"nret": one("nret", 1, "int"), "rnum": one("rnum", 1, "int"), "intensity": one("intensity", 0.0, "double"), "withheld": one("withheld", False, "boolean")})
    return out.filter(~F.col("cls").isin(*NOISE) & ~F.col("withheld")) if drop_noise else out


def _las(spark: SparkSession):
    """A reader of LAS files; see sources.las."""
    spark.dataSource.register(LasSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("las")


def read_points(spark: SparkSession, path: str, drop_noise: bool = True, las: bool | None = None, split: int = SPLIT) -> DataFrame:
    """Points of a Parquet table, or of the .las files of a path or folder (las; told by the path's ending if None), in ranges of `split` bytes."""
    las = path.lower().rstrip("/").endswith(".las") if las is None else las
    rows = _las(spark).option("split", str(split)).load(path) if las else spark.read.parquet(path)
    return clean_points(rows, drop_noise)


def write_las(df: DataFrame, path: str, file: str = "cloud") -> None:
    """Points as LAS files, one for each value of `file`, which one task writes; parts of a large cloud need names of their own."""
    df.sparkSession.dataSource.register(LasSource)
    rows = clean_points(df, drop_noise=False).withColumn("file", F.col(file).cast("string"))
    cols = ["file", "pid", "x", "y", "z", "cls", "nret", "rnum", "intensity", "withheld"]
    rows.select(*cols).repartition("file").sortWithinPartitions("file", "pid").write.format("las").mode("append").save(path)


def las_headers(spark: SparkSession, path: str, bounds_only: bool = False) -> DataFrame:
    """path, version, count, bounds and density of LAS files; only the first bytes of each are read, and files of another kind are left out."""
    out = _las(spark).option("headers", "true").load(path)
    return out.select("path", "min_x", "max_x", "min_y", "max_y") if bounds_only else out


def list_files(spark: SparkSession, folder: str, suffixes: str) -> DataFrame:
    """key and size of the files below a folder whose suffix matches, whatever its case; contents are not read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.col("path").alias("key"), F.col("length").alias("size"))
    return rows.filter(F.col("key").rlike(rf"(?i)\.({suffixes})$")).dropDuplicates(["key"]).orderBy("key")


def list_clouds(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder, "las|laz|copc\\.laz")


def list_rasters(spark: SparkSession, folder: str) -> DataFrame:
    return list_files(spark, folder, "tif|tiff|asc")


def read_ascii_grid(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """cells (raster_id, row, col, value) and frames (raster_id, x_min, y_min, res, h, w) of ASCII height grids.

    Row 0 is the southernmost; NoData is null.
    """
    text = spark.read.text(path, wholetext=True).withColumn("raster_id", F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", ""))
    field = lambda k: F.regexp_extract("value", rf"(?im)^\s*{k}\s+(\S+)", 1)
    corner = lambda axis: F.when(field(f"{axis}llcorner") != "", field(f"{axis}llcorner").cast("double")).otherwise(field(f"{axis}llcenter").cast("double") - field("cellsize").cast("double") / 2)
    head = text.select("raster_id", corner("x").alias("x_min"), corner("y").alias("y_min"), field("cellsize").cast("double").alias("res"), field("nrows").cast("long").alias("h"), field("ncols").cast("long").alias("w"), field("nodata_value").try_cast("double").alias("nodata"), F.regexp_replace(F.regexp_replace("value", r"(?im)^\s*[a-z_]+\s+\S+\s*$", ""), r"^\s+|\s+$", "").alias("body"))
    long = head.select("raster_id", "h", "w", "nodata", F.posexplode(F.split("body", r"\s+")).alias("i", "v"))
    value = F.col("v").cast("double")
    cells = long.select("raster_id", (F.col("h") - 1 - F.floor(F.col("i") / F.col("w"))).alias("row"), (F.col("i") % F.col("w")).alias("col"), F.when((F.col("nodata").isNull() | (value != F.col("nodata"))) & ~F.isnan(value), value).alias("value"))
    return cells, head.drop("body", "nodata")


def classified(df: DataFrame, by=BY) -> DataFrame:
    """What the classified output stores: class 2 for ground, 1 for the rest, intensity within 16 bits, returns within 1 and 15.

    Intensities of a cloud whose largest is beyond 65535 are scaled down; null and NaN are 0. true_class is
    2 for ground, 0 for ignored, 1 otherwise, where there is a true label.
    """
    top = df.groupBy(*by).agg(F.max(F.when(~F.isnan("intensity"), F.col("intensity"))).alias("_top"))
    rows = df.join(top, list(by))
    scaled = F.col("intensity") * F.when(F.col("_top") > 65535, 65535 / F.col("_top")).otherwise(1.0)
    clip = lambda c: F.least(F.greatest(F.coalesce(F.col(c), F.lit(1)), F.lit(1)), F.lit(15)).cast("int") if c in df.columns else F.lit(1)
    out = {"classification": F.when(F.col("pred") == 1, 2).otherwise(1), "intensity": F.floor(F.least(F.greatest(F.coalesce(F.nanvl(scaled, F.lit(0.0)), F.lit(0.0)), F.lit(0.0)), F.lit(65535.0))).cast("int"), "nret": clip("nret"), "rnum": clip("rnum")}
    if "label" in df.columns:
        out["true_class"] = F.when(F.col("label") == 1, 2).when(F.col("label") == 2, 0).otherwise(1)
    return rows.withColumns(out).drop("_top")


def write_classified(df: DataFrame, path: str, by=BY) -> None:
    classified(df, by).write.mode("overwrite").partitionBy(*by).parquet(path)


def read_classified(spark: SparkSession, path: str) -> DataFrame:
    """Classified output with its codes taken back to pred, and label where true_class is stored."""
    rows = spark.read.parquet(path)
    rows = rows.withColumn("pred", F.when(F.col("classification") == 2, 1).otherwise(0))
    return rows.withColumn("label", F.when(F.col("true_class") == 2, 1).when(F.col("true_class") == 0, 2).otherwise(0)) if "true_class" in rows.columns else rows


def write_tiles(df: DataFrame, path: str, by=BY) -> None:
    """Tiles by cloud; a rerun replaces only the clouds it brings."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def tile_defaults(df: DataFrame) -> DataFrame:
    """Tiles with the columns that older ones lack: intensity 0, and the return ratio, 1 without counts."""
    have = set(df.columns)
    ratio = F.col("rnum").cast("double") / F.greatest("nret", F.lit(1)) if {"rnum", "nret"} <= have else F.lit(1.0)
    return df.withColumns({"intensity": F.coalesce(F.col("intensity"), F.lit(0.0)) if "intensity" in have else F.lit(0.0), "ret_ratio": F.coalesce(F.col("ret_ratio"), ratio, F.lit(1.0)) if "ret_ratio" in have else F.coalesce(ratio, F.lit(1.0))})


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return tile_defaults(spark.read.option("mergeSchema", "true").parquet(path))


def append_history(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def write_norm_stats(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)


def write_refine_impact(history: DataFrame, path: str) -> None:
    """Raw against refined scores per epoch, as CSV with a header."""
    history.orderBy("epoch").write.mode("overwrite").option("header", "true").csv(path)


def latest_history(spark: SparkSession, path: str) -> DataFrame:
    """The last record of each epoch."""
    rows = spark.read.json(path)
    last = F.row_number().over(Window.partitionBy("epoch").orderBy(F.desc("_metadata.file_modification_time"), F.desc("_metadata.file_name")))
    return rows.withColumn("_k", last).filter("_k = 1").drop("_k")
