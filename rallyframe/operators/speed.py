"""Speeds and distances along tracks: the ball against its last detected point, players against their last sample."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.config import PLAYER_SPEED, CourtConfig, SpeedConfig
from rallyframe.functions import geometry as G
from rallyframe.operators.court import mapped


def _running(moved: DataFrame, keys: tuple[str, ...], config: SpeedConfig) -> DataFrame:
    """Adds what runs along the track over the valid steps (speed > 0): total, peak, mean, and the mean of the last few.

    The last few valid speeds aren't a row frame, so each is a lag over the valid rows alone."""
    w = Window.partitionBy(*keys).orderBy("timestamp_seconds", "frame_number")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    speed = F.when(F.col("speed_kmh") > 0, F.col("speed_kmh"))
    over = f"OVER (PARTITION BY {', '.join(keys)} ORDER BY timestamp_seconds, frame_number)"

    def back(k: int) -> Column:
        if k == 0:
            return F.last(speed, ignorenulls=True).over(upto)
        return F.expr(f"IF(speed_kmh > 0, lag(valid_kmh, {k}) IGNORE NULLS {over}, lag(valid_kmh, {k + 1}) IGNORE NULLS {over})")

    names = [f"back_{k}" for k in reversed(range(config.smoothing_window))]
    mm = F.when(F.col("speed_kmh") > 0, F.round(F.col("step") * NANO).cast("long"))
    out = moved.withColumn("valid_kmh", speed).withColumns(
        {
            "total_distance": F.round(F.coalesce(F.sum(mm).over(upto), F.lit(0)) / (NANO / 1000)) / 1000.0,
            "peak_kmh": F.coalesce(F.max(speed).over(upto), F.lit(0.0)),
            "average_kmh": _mean(F.sum(_thousandths(speed)).over(upto), F.count(speed).over(upto)),
            **{n: back(int(n[5:])) for n in names},
        }
    )
    many = reduce(Column.__add__, [F.col(n).isNotNull().cast("int") for n in names])
    total = reduce(Column.__add__, [F.coalesce(_thousandths(F.col(n)), F.lit(0)) for n in names])
    return out.withColumn("smoothed_kmh", _mean(total, many)).drop("valid_kmh", *names)


#: Distances are summed in whole billionths and speeds in whole thousandths, so that no sum depends on its order.
NANO = 1e9


def _thousandths(v: Column) -> Column:
    return F.round(v * 1000.0).cast("long")


def _mean(total: Column, n: Column) -> Column:
    """The mean of n values in thousandths (3 places); 0 of none."""
    return F.when(n == 0, F.lit(0.0)).otherwise(F.round(total / F.greatest(n, F.lit(1))) / 1000.0)


def ball_speed(points: DataFrame, h: G.Matrix, config: SpeedConfig = SpeedConfig(), court: CourtConfig = CourtConfig()) -> DataFrame:
    """Speed of each point against the last detected one before it (an as-of lookup by last(ignore nulls), no join)."""
    w = Window.partitionBy("track_id").orderBy("timestamp_seconds", "frame_number")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    at = F.when(~F.col("predicted"), F.struct("timestamp_seconds", "court_x", "court_y"))
    seen = mapped(points, h, court).withColumn("prev", F.last(at, ignorenulls=True).over(before))
    c = F.col
    dt = c("timestamp_seconds") - c("prev.timestamp_seconds")
    counts = c("prev").isNotNull() & (dt > 0) & ((~c("predicted")) | F.lit(not config.ignore_predicted))
    step = F.when(counts, G.distance(c("prev.court_x"), c("prev.court_y"), c("court_x"), c("court_y"))).otherwise(0.0)
    moved = seen.withColumns({"step": step, "dt": F.when(counts, dt).otherwise(0.0)})
    moved = moved.withColumn("speed_kmh", G.kmh(c("step"), c("dt"), config.minimum_time_delta, config.minimum_distance_meters, config.maximum_speed_kmh))
    out = _running(moved, ("track_id",), config)
    return out.select("track_id", "frame_number", "timestamp_seconds", "predicted", "court_x", "court_y", F.round("step", 4).alias("frame_distance"), "speed_kmh", "smoothed_kmh", "average_kmh", "peak_kmh", "total_distance")


def player_motion(players: DataFrame, h: G.Matrix, config: SpeedConfig = PLAYER_SPEED, court: CourtConfig = CourtConfig()) -> DataFrame:
    """Motion of each sample of track_id, player_label against the sample before it, valid or not."""
    w = Window.partitionBy("track_id", "player_label").orderBy("timestamp_seconds", "frame_number")
    seen = mapped(players, h, court).withColumns({f"p_{k}": F.lag(k).over(w) for k in ("timestamp_seconds", "court_x", "court_y")})
    c = F.col
    dt = c("timestamp_seconds") - c("p_timestamp_seconds")
    counts = c("p_timestamp_seconds").isNotNull() & (dt > 0)
    step = F.when(counts, F.round(G.distance(c("p_court_x"), c("p_court_y"), c("court_x"), c("court_y")), 4)).otherwise(0.0)
    moved = seen.withColumns({"step": step, "dt": F.when(counts, dt).otherwise(0.0)})
    moved = moved.withColumn("speed_kmh", G.kmh(c("step"), c("dt"), config.minimum_time_delta, config.minimum_distance_meters, config.maximum_speed_kmh))
    out = _running(moved, ("track_id", "player_label"), config)
    return out.select(
        "track_id", "player_label", "frame_number", G.fixed(F.col("court_x"), 3).alias("court_x"), G.fixed(F.col("court_y"), 3).alias("court_y"), "inside", "zone",
        F.col("step").alias("frame_distance"), "speed_kmh", "smoothed_kmh", "average_kmh", "peak_kmh", "total_distance",
    )


def speed_summary(speeds: DataFrame, *by: str) -> DataFrame:
    """Of each group: samples, valid ones, distance, mean and top speed, and the last smoothed speed."""
    valid = F.col("speed_kmh") > 0
    return speeds.groupBy(*by).agg(
        F.count("*").alias("samples"),
        F.count_if(valid).alias("valid_samples"),
        F.round(F.sum(F.when(valid, F.col("frame_distance")).otherwise(0.0)), 2).alias("distance"),
        F.round(F.coalesce(F.avg(F.when(valid, F.col("speed_kmh"))), F.lit(0.0)), 2).alias("average_kmh"),
        F.round(F.max("speed_kmh"), 3).alias("top_kmh"),
        F.max_by("smoothed_kmh", "frame_number").alias("latest_smoothed_kmh"),
        F.lit("estimated_court_plane").alias("speed_type"),
    )
