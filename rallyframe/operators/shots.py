"""Rallies and shots of a track, and the features of each shot."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.config import ShotConfig
from rallyframe.functions import geometry as G
from rallyframe.operators import folds
from rallyframe.sources.tracks import order_in_track


def rallies(points: DataFrame, config: ShotConfig = ShotConfig()) -> DataFrame:
    """The points of all rallies, with rally_id from 1. A longer gap than allowed ends a rally; short ones get no number."""
    w = order_in_track()
    gap = F.col("timestamp_seconds") - F.lag("timestamp_seconds").over(w) > config.maximum_gap_seconds
    parts = points.withColumn("starts", F.coalesce(gap, F.lit(False)).cast("int"))
    parts = parts.withColumn("part", F.sum("starts").over(w))
    parts = parts.withColumn("part_points", F.count("*").over(Window.partitionBy("track_id", "part")))
    kept = parts.where(F.col("part_points") >= config.minimum_rally_points)
    number = F.dense_rank().over(Window.partitionBy("track_id").orderBy("part"))
    return kept.withColumn("rally_id", number.cast("long")).drop("starts", "part", "part_points")


#: A point of a shot, with the points before it in the shot: one (p_) and two (pp_).
SHOT_POINT = "track_id long, rally_id long, shot_in_rally long, shot_id long, place long, frame_number long, timestamp_seconds double, x double, y double, predicted boolean, p_timestamp_seconds double, p_x double, p_y double, pp_x double, pp_y double"


class Splitter:
    """Splits the points of a rally (frame_number, timestamp_seconds, x, y, ...), one by one. A sharp turn or a long duration starts a new
    shot with the last two points; steps that are too small neither turn nor end a shot. Only the points of one shot are held."""

    def __init__(self, config: ShotConfig):
        self.config, self.own, self.last = config, [], None

    def add(self, point: tuple) -> list | None:
        """The shot that this point ends."""
        done = None
        if self.own:
            dx, dy = point[2] - self.own[-1][2], point[3] - self.own[-1][3]
            if math.sqrt(dx * dx + dy * dy) >= self.config.minimum_motion_pixels:
                angle, turn = math.degrees(math.atan2(dy, dx)), 0.0
                if self.last is not None:
                    turn = abs(angle - self.last)
                    turn = min(turn, 360.0 - turn)
                ends = turn >= self.config.direction_change_degrees or point[1] - self.own[0][1] >= self.config.maximum_shot_seconds
                if ends and len(self.own) >= self.config.minimum_shot_points:
                    done, self.own = self.own, self.own[-1:]
                self.last = angle
        self.own.append(point)
        return done

    def rest(self) -> list | None:
        return self.own if len(self.own) >= self.config.minimum_shot_points else None


class TrackShots:
    """The shots of all rallies of a track, numbered in each rally and through the track."""

    def __init__(self, config: ShotConfig):
        self.config, self.rally, self.splitter, self.in_rally, self.shots = config, None, None, 0, 0

    def told(self, shot: list | None):
        if not shot:
            return []
        self.in_rally += 1
        self.shots += 1
        lag = lambda k, back: shot[k - back][1:4] if k >= back else (None,) * 3
        return [(self.rally, self.in_rally, self.shots, k, *point, *lag(k, 1), *lag(k, 2)[1:]) for k, point in enumerate(shot)]

    def step(self, rally: int, *point):
        if rally == self.rally:
            return self.told(self.splitter.add(point))
        out = self.end()
        self.rally, self.splitter, self.in_rally = rally, Splitter(self.config), 0
        self.splitter.add(point)
        return out

    def end(self):
        return self.told(self.splitter.rest()) if self.splitter else []


class RallyCounts:
    """First and last time, points and shots of a rally, told at its end."""

    def __init__(self, config: ShotConfig):
        self.splitter, self.first, self.last, self.points, self.shots = Splitter(config), math.inf, -math.inf, 0, 0

    def step(self, *point):
        self.first, self.last = min(self.first, point[1]), max(self.last, point[1])
        self.points += 1
        self.shots += self.splitter.add(point) is not None
        return ()

    def end(self):
        return [(self.first, self.last, self.points, self.shots + (self.splitter.rest() is not None))]


def shot_points(rally_points: DataFrame, config: ShotConfig = ShotConfig()) -> DataFrame:
    """The points of each shot in order; neighbouring shots share points. An ordered fold over each track: where a shot ends depends on
    where it began, and its points bring what they follow."""
    order = ["rally_id", "timestamp_seconds", "frame_number"]
    return folds.folded(rally_points, ["track_id"], order, ["rally_id", "frame_number", "timestamp_seconds", "x", "y", "predicted"], lambda: TrackShots(config), SHOT_POINT)


def shot_features(shot_rows: DataFrame) -> DataFrame:
    """The features of each shot, named as in the dataset; shot_id counts through all rallies of a track."""
    c = F.col
    dt = c("timestamp_seconds") - c("p_timestamp_seconds")
    heading = lambda x0, y0, x1, y1: F.when(c(x0).isNotNull(), G.heading(c(x1) - c(x0), c(y1) - c(y0)))
    steps = shot_rows.withColumns({"moved": G.distance(c("p_x"), c("p_y"), c("x"), c("y")), "angle": heading("p_x", "p_y", "x", "y"), "p_angle": heading("pp_x", "pp_y", "p_x", "p_y")})
    steps = steps.withColumns({"speed": F.when(dt > 0, F.try_divide(c("moved"), dt)), "turn": G.wrapped_difference(c("p_angle"), c("angle"))})
    first, last = (lambda k: F.min_by(k, "place")), (lambda k: F.max_by(k, "place"))
    r = lambda v: F.round(F.coalesce(v, F.lit(0.0)), 4)
    return steps.groupBy("track_id", "rally_id", "shot_in_rally", "shot_id").agg(
        first("frame_number").alias("start_frame"),
        last("frame_number").alias("end_frame"),
        r(first("timestamp_seconds")).alias("start_time"),
        r(last("timestamp_seconds")).alias("end_time"),
        r(F.greatest(F.lit(0.0), last("timestamp_seconds") - first("timestamp_seconds"))).alias("duration_seconds"),
        F.count("*").alias("point_count"),
        r(first("x")).alias("start_x"),
        r(first("y")).alias("start_y"),
        r(last("x")).alias("end_x"),
        r(last("y")).alias("end_y"),
        r(last("x") - first("x")).alias("delta_x"),
        r(last("y") - first("y")).alias("delta_y"),
        r(G.distance(first("x"), first("y"), last("x"), last("y"))).alias("displacement_pixels"),
        r(F.sum("moved")).alias("trajectory_distance_pixels"),
        r(F.avg("speed")).alias("average_speed_pixels_per_second"),
        r(F.max("speed")).alias("maximum_speed_pixels_per_second"),
        r(F.min("speed")).alias("minimum_speed_pixels_per_second"),
        r(F.avg("angle")).alias("average_direction_degrees"),
        r(F.avg("turn")).alias("mean_direction_change_degrees"),
        r(F.max("turn")).alias("max_direction_change_degrees"),
        r(F.avg(c("predicted").cast("int"))).alias("predicted_point_ratio"),
    )


def rally_summary(rally_points: DataFrame, config: ShotConfig = ShotConfig()) -> DataFrame:
    """A row for each rally, with its number of shots; one fold gives both."""
    out = folds.folded(rally_points, ["track_id", "rally_id"], ["timestamp_seconds", "frame_number"], ["frame_number", "timestamp_seconds", "x", "y"], lambda: RallyCounts(config), "track_id long, rally_id long, start_time double, end_time double, trajectory_points long, shot_count long")
    return out.withColumns({k: F.round(k, 3) for k in ("start_time", "end_time")})


def visible_runs(frames: DataFrame, minimum_frames: int = 30) -> DataFrame:
    """Runs of consecutive frames with `visible` of at least that length: track_id, start_frame, end_frame (inclusive)."""
    w = Window.partitionBy("track_id").orderBy("frame_number")
    seen = frames.where("visible")
    islands = seen.withColumn("island", F.col("frame_number") - F.row_number().over(w))
    runs = islands.groupBy("track_id", "island").agg(F.min("frame_number").alias("start_frame"), F.max("frame_number").alias("end_frame"), F.count("*").alias("frames"))
    return runs.where(F.col("frames") >= minimum_frames).drop("island")


def clip_windows(runs: DataFrame, fps: float = 30.0, every: float = 1.5, half: float = 0.5, most: int | None = None) -> DataFrame:
    """Clips around centres every `every` seconds of each run, `half` seconds to either side, inside the run; numbered. most: the first so
    many of a track."""
    step, reach = int(every * fps), int(half * fps)
    centres = runs.where(F.col("end_frame") - F.col("start_frame") >= reach).select("track_id", "start_frame", "end_frame", F.explode(F.sequence(F.col("start_frame") + reach, F.col("end_frame"), F.lit(step).cast("long"))).alias("center_frame"))
    clips = centres.select("track_id", F.greatest("start_frame", F.col("center_frame") - reach).alias("clip_start"), F.least("end_frame", F.col("center_frame") + reach).alias("clip_end"), "center_frame")
    number = F.row_number().over(Window.partitionBy("track_id").orderBy("center_frame"))
    clips = clips.withColumn("number", number)
    kept = clips if most is None else clips.where(F.col("number") <= most)
    return kept.withColumn("clip_id", F.format_string("shot_%04d", "number")).drop("number")


def clip_frames(frames: DataFrame, clips: DataFrame, bucket: int = 64) -> DataFrame:
    """The frames of each clip: an interval join on buckets of frames, so it is an equi-join at any size."""
    wide = clips.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("clip_start") / bucket), F.floor((F.col("clip_end") - 1) / bucket))))
    cut = frames.withColumn("bucket", F.floor(F.col("frame_number") / bucket))
    return cut.join(wide, ["track_id", "bucket"]).where("frame_number >= clip_start AND frame_number < clip_end").drop("bucket")

