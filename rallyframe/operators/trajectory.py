"""Bounces: 3-point motion windows over a track, their score, candidates, and de-duplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.config import BounceConfig
from rallyframe.functions import geometry as G
from rallyframe.sources.tracks import order_in_track


def motion_windows(points: DataFrame, config: BounceConfig = BounceConfig()) -> DataFrame:
    """A row for each point between two others: both velocities, the turn, and the bounce score.

    All windows share one partitioning, so the plan has one exchange and one sort."""
    w = order_in_track()
    fields = ("timestamp_seconds", "x", "y", "predicted")
    lagged = points.select("*", *(F.lag(c).over(w).alias(f"p_{c}") for c in fields), *(F.lead(c).over(w).alias(f"n_{c}") for c in fields))
    lagged = lagged.where(F.col("p_timestamp_seconds").isNotNull() & F.col("n_timestamp_seconds").isNotNull())
    c = F.col
    least = config.minimum_time_delta
    dt1, dt2 = c("timestamp_seconds") - c("p_timestamp_seconds"), c("n_timestamp_seconds") - c("timestamp_seconds")
    moved = lagged.select(
        "*",
        G.velocity(c("x") - c("p_x"), dt1, least).alias("vx_before"),
        G.velocity(c("y") - c("p_y"), dt1, least).alias("vy_before"),
        G.velocity(c("n_x") - c("x"), dt2, least).alias("vx_after"),
        G.velocity(c("n_y") - c("y"), dt2, least).alias("vy_after"),
        G.distance(c("p_x"), c("p_y"), c("x"), c("y")).alias("moved_before"),
        G.distance(c("x"), c("y"), c("n_x"), c("n_y")).alias("moved_after"),
        ((c("p_predicted").cast("int") + c("predicted").cast("int") + c("n_predicted").cast("int")) / 3.0).alias("ratio"),
    )
    turned = moved.select("*", G.direction_change(c("vx_before"), c("vy_before"), c("vx_after"), c("vy_after")).alias("direction_change"), ((c("vy_before") > 0) & (c("vy_after") < 0)).alias("vertical_reversal"))
    raw = (
        F.when(c("vertical_reversal"), F.lit(config.reversal_weight)).otherwise(F.lit(0.0))
        + F.least(c("direction_change") / float(max(config.strong_direction_change_degrees, 1.0)), F.lit(1.0)) * config.direction_weight
        + (1.0 - c("ratio")) * config.quality_weight
    )
    scored = turned.withColumn("raw_score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
    sufficient = (c("moved_before") >= config.minimum_motion_pixels) & (c("moved_after") >= config.minimum_motion_pixels)
    candidate = sufficient & (c("direction_change") >= config.minimum_direction_change_degrees) & (c("ratio") <= config.maximum_prediction_ratio) & (c("raw_score") >= config.score_threshold)
    return scored.select(
        "track_id",
        "frame_number",
        "timestamp_seconds",
        "x",
        "y",
        *(F.round(v, 3).alias(v) for v in ("vx_before", "vy_before", "vx_after", "vy_after")),
        F.round(G.magnitude(c("vx_before"), c("vy_before")), 3).alias("speed_before"),
        F.round(G.magnitude(c("vx_after"), c("vy_after")), 3).alias("speed_after"),
        "direction_change",
        "vertical_reversal",
        F.round("ratio", 3).alias("prediction_ratio"),
        sufficient.alias("sufficient_motion"),
        F.round("raw_score", 4).alias("bounce_score"),
        candidate.alias("is_candidate"),
    )


def bounce_candidates(points: DataFrame, config: BounceConfig = BounceConfig()) -> DataFrame:
    return motion_windows(points, config).where("is_candidate").drop("is_candidate")


def deduplicated(candidates: DataFrame, config: BounceConfig = BounceConfig()) -> DataFrame:
    """The best candidate of each group; a group ends where the next candidate is more than the gap away from the last.
    Equal scores: the earliest."""
    w = Window.partitionBy("track_id").orderBy("frame_number")
    starts = F.coalesce(F.col("frame_number") - F.lag("frame_number").over(w) > config.minimum_frame_gap, F.lit(True))
    grouped = candidates.withColumn("starts", starts).withColumn("bounce_group", F.sum(F.col("starts").cast("int")).over(w))
    best = Window.partitionBy("track_id", "bounce_group").orderBy(F.desc("bounce_score"), "frame_number")
    return grouped.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place", "starts")


def trajectory_summary(points: DataFrame, config: BounceConfig = BounceConfig()) -> DataFrame:
    """By track: windows, reversals, candidates, and bounces left after de-duplication."""
    windows = motion_windows(points, config)
    sums = windows.groupBy("track_id").agg(F.count("*").alias("windows"), F.count_if("vertical_reversal").alias("reversals"), F.count_if("is_candidate").alias("candidates"), F.round(F.max("bounce_score"), 4).alias("best_score"))
    kept = deduplicated(windows.where("is_candidate"), config).groupBy("track_id").agg(F.count("*").alias("bounces"))
    return sums.join(kept, "track_id", "left").fillna(0, ["bounces"])
