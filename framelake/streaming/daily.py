"""The batch operators' relatives on streams: daily means with late data, and a file-drop source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.functions.dates import name_timestamp


def daily_stream(events: DataFrame, ts: str, keys: list[str], value: str, late: str = "1 day") -> DataFrame:
    """Mean, maximum and count per key and day of a stream; a day is emitted once it is over by ``late``."""
    timed = events.withColumn("_t", F.col(ts).cast("timestamp")).withWatermark("_t", late)
    out = timed.groupBy(F.window("_t", "1 day"), *keys).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.count("*").alias("n"))
    return out.select(F.to_date("window.start").alias("day"), *keys, "mean", "max", "n")


def dropped_frames(spark: SparkSession, folder: str, pattern: str = "*.{jpg,JPG,png}") -> DataFrame:
    """Files as they arrive in a folder: path, bytes, and the time in the name."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", F.col("length").alias("filesize"), "content", name_timestamp(F.col("path")).alias("timestamp"))
