"""Incremental work: finished outputs are skipped because the stream remembers the files it has read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terraframe.operators.voxel import voxel_downsample
from terraframe.sources.files import clean_points, write_tiles


def tile_stream(spark: SparkSession, source: str, schema: T.StructType | str, target: str, dl: float, checkpoint: str):
    """A query that subsamples each new batch of point files into tiles and ends when none is left.

    Every file holds whole clouds. A batch that is run again after a failure replaces the clouds it wrote before.
    """
    points = spark.readStream.schema(schema).parquet(source)

    def put(batch: DataFrame, _: int) -> None:
        write_tiles(voxel_downsample(clean_points(batch), dl, ["intensity"], None), target)

    return points.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def vote_stream(votes: DataFrame, ts: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Running soft votes per point and window of event time; votes later than the watermark no longer count."""
    return votes.withWatermark(ts, late).groupBy(F.window(ts, window), "cloud", "pid").agg(F.sum("p_ground").alias("s_ground"), F.count("*").alias("n_votes"))
