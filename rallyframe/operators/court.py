"""Court mapping of bounces, line calls and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.config import CourtConfig
from rallyframe.functions import geometry as G


def mapped(points: DataFrame, h: G.Matrix, court: CourtConfig = CourtConfig()) -> DataFrame:
    """Adds court_x, court_y (metres), inside and zone to points with x, y (pixels)."""
    x, y = G.project(h, F.col("x"), F.col("y"))
    out = points.withColumns({"court_x": x, "court_y": y})
    cx, cy = F.col("court_x"), F.col("court_y")
    return out.withColumns({"inside": G.inside(cx, cy, court), "zone": G.zone(cx, cy, court)})


def mapped_by_video(points: DataFrame, calibrations: DataFrame, key: str = "video_id", court: CourtConfig = CourtConfig()) -> DataFrame:
    """As mapped(), with the homography of each point's video; points without one get nulls. A calibration is a row for a
    video, so AQE decides whether that side is small enough to send."""
    joined = points.join(calibrations.select(key, "homography"), key, "left")
    x, y = G.project(F.col("homography"), F.col("x"), F.col("y"))
    out = joined.withColumns({"court_x": x, "court_y": y}).drop("homography")
    return out.withColumns({"inside": G.inside(F.col("court_x"), F.col("court_y"), court), "zone": G.zone(F.col("court_x"), F.col("court_y"), court)})


def line_calls(bounces: DataFrame, h: G.Matrix, court: CourtConfig = CourtConfig()) -> DataFrame:
    """IN or OUT, flags, zone and distances to the lines of each bounce."""
    out = mapped(bounces, h, court)
    cx, cy = F.col("court_x"), F.col("court_y")
    call = G.line_call(cx, cy, court)
    distances = G.boundary_distances(cx, cy, court)
    out = out.withColumns({**call, **{f"to_{k}": v for k, v in distances.items()}})
    nearest = G.nearest_boundary({k: F.col(f"to_{k}") for k in distances})
    return out.withColumns(
        {
            "zone": F.when(F.col("call") == "OUT", "out").otherwise(F.col("zone")),
            "nearest": nearest["name"],
            "to_nearest": nearest["distance"],
            "accepted": F.col("bounce_score") >= court.minimum_bounce_score,
        }
    )


def call_summary(calls: DataFrame, *by: str) -> DataFrame:
    a = F.col("accepted")
    return calls.groupBy(*by).agg(
        F.count("*").alias("bounces"),
        F.count_if(a).alias("accepted"),
        F.count_if(a & (F.col("call") == "IN")).alias("calls_in"),
        F.count_if(a & (F.col("call") == "OUT")).alias("calls_out"),
        F.count_if(a & F.col("near_line")).alias("near_line"),
    )


def reprojection_error(pairs: DataFrame, h: G.Matrix, *by: str) -> DataFrame:
    """Mean distance (6 places) of projected image points to their court points: x, y, court_x, court_y."""
    x, y = G.project(h, F.col("x"), F.col("y"), None)
    error = G.distance(x, y, F.col("court_x"), F.col("court_y"))
    return pairs.groupBy(*by).agg(F.round(F.avg(error), 6).alias("mean_error"), F.count("*").alias("points"))
