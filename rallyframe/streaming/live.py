"""Windows over streams: rallies as session windows, detection rates in sliding windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.config import ShotConfig


def event_time(points: DataFrame) -> DataFrame:
    """Adds event_time, the point's seconds as a timestamp."""
    return points.withColumn("event_time", F.timestamp_micros((F.col("timestamp_seconds") * 1000000).cast("long")))


def stream_rallies(points: DataFrame, config: ShotConfig = ShotConfig(), late: str = "10 seconds") -> DataFrame:
    """A row for each rally of a track once the watermark has passed it: first and last time, points. Points later than `late`
    are dropped."""
    gap = f"{int(config.maximum_gap_seconds * 1000)} milliseconds"
    sessions = event_time(points).withWatermark("event_time", late).groupBy("track_id", F.session_window("event_time", gap).alias("w"))
    out = sessions.agg(F.min("timestamp_seconds").alias("start_time"), F.max("timestamp_seconds").alias("end_time"), F.count("*").alias("trajectory_points"))
    return out.where(F.col("trajectory_points") >= config.minimum_rally_points).drop("w")


def stream_detection_rate(points: DataFrame, size: str = "5 seconds", slide: str = "1 second", late: str = "10 seconds") -> DataFrame:
    """Points and detected points of each window of a track."""
    windows = event_time(points).withWatermark("event_time", late).groupBy("track_id", F.window("event_time", size, slide).alias("w"))
    return windows.agg(F.count("*").alias("points"), F.count_if(~F.col("predicted")).alias("detected")).select("track_id", F.col("w.start").alias("window_start"), "points", "detected")
