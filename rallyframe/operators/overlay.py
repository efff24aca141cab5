"""Texts and sizes of what is written on frames, and documents about whole videos."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

c = F.col
#: The height that font sizes are given for.
BASE_HEIGHT = 720


def font_scale(height: Column, base: float = 0.6) -> Column:
    return base * (height / BASE_HEIGHT)


def font_thickness(height: Column, base: int = 2) -> Column:
    return F.greatest(F.lit(1), F.floor(base * (height / BASE_HEIGHT)).cast("int"))


def time_caption(seconds: Column) -> Column:
    """Halves go to the even digit."""
    return F.format_string("Time: %.2fs", F.bround(seconds, 2))


def speed_caption(kmh: Column) -> Column:
    """Null where there is no speed."""
    return F.when(kmh.isNotNull(), F.format_string("~%.1f km/h", F.bround(kmh, 1)))


def score_caption(player: str, points: Column, games: Column, sets: Column) -> Column:
    """player: A or B."""
    return F.concat(F.lit(f"{player}: "), points, F.lit(" | "), games.cast("string"), F.lit(" | "), sets.cast("string"))


def recent(points: DataFrame, size: int = 40) -> DataFrame:
    """Adds `history`, the last `size` points of a track up to each one (frame_number, x, y), oldest first."""
    w = Window.partitionBy("track_id").orderBy("timestamp_seconds", "frame_number").rowsBetween(1 - size, 0)
    return points.withColumn("history", F.collect_list(F.struct("frame_number", "x", "y")).over(w))


def suggested_players(clips: DataFrame, positions: DataFrame) -> DataFrame:
    """Adds suggested_player to clips: whoever stands lower in court metres at the centre frame, `unknown` unless both are seen. A guess
    for whoever labels. positions: track_id, frame_number, a_y, b_y."""
    at = positions.select("track_id", c("frame_number").alias("center_frame"), "a_y", "b_y")
    joined = clips.join(at, ["track_id", "center_frame"], "left")
    guess = F.when(c("a_y") < c("b_y"), "player_a").when(c("a_y").isNotNull() & c("b_y").isNotNull(), "player_b").otherwise("unknown")
    return joined.withColumn("suggested_player", guess).drop("a_y", "b_y")


def video_summaries(quality: DataFrame, videos: DataFrame) -> DataFrame:
    """A nested document for each video: what it is and how much was detected; ready for write.json."""
    counts = [k for k in quality.columns if k != "video_id"]
    about = [k for k in videos.columns if k != "video_id"]
    joined = videos.join(quality, "video_id", "left")
    return joined.select("video_id", F.struct(*about).alias("video"), F.struct(*(F.coalesce(c(k), F.lit(0)).alias(k) for k in counts)).alias("detection"))


def tracking_documents(videos: DataFrame, tracked: DataFrame, summary: DataFrame) -> DataFrame:
    """A nested document for each video of tracked balls (video_id, frame_number, source, ...): what it is, how many frames were processed,
    seen and predicted, and the tracker's summary. Its frames go to their own documents (write_frame_documents)."""
    counts = tracked.groupBy("video_id").agg(F.count("*").alias("processed_frames"), F.count_if(c("source") == "detected").alias("visible_detection_frames"), F.count_if(c("source") == "predicted").alias("prediction_frames"))
    of = lambda df: F.struct(*(c(k) for k in df.columns if k != "video_id"))
    joined = videos.join(counts, "video_id", "left").join(summary, "video_id", "left")
    zero = [F.coalesce(c(k), F.lit(0)).alias(k) for k in ("processed_frames", "visible_detection_frames", "prediction_frames")]
    return joined.select("video_id", of(videos).alias("video"), *zero, of(summary).alias("tracking_summary"))


def player_documents(videos: DataFrame, labels: DataFrame) -> DataFrame:
    """A nested document for each video of labels (video_id, frame_number, track, player_label): processed frames, and the last label of each
    track by its id. A video has as many entries as tracks."""
    last = labels.groupBy("video_id", "track").agg(F.max_by("player_label", "frame_number").alias("label"))
    maps = last.groupBy("video_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("track", "label")))).alias("track_to_player_label"))
    frames = labels.groupBy("video_id").agg(F.count_distinct("frame_number").alias("processed_frames"))
    about = F.struct(*(c(k) for k in videos.columns if k != "video_id")).alias("video")
    out = videos.join(frames, "video_id", "left").join(maps, "video_id", "left")
    return out.select("video_id", about, F.coalesce("processed_frames", F.lit(0)).alias("processed_frames"), F.coalesce("track_to_player_label", F.create_map().cast("map<string,string>")).alias("track_to_player_label"))


def frames_metadata(frames: DataFrame, videos: DataFrame, fps: Column) -> DataFrame:
    """A nested document for each video: its path, how many frames were taken of it, and each with its number, second and file name. frames:
    what every_nth() takes, so as many as its cap allows."""
    at = c("frame_number") / fps
    one = F.struct("frame_number", F.round(at, 3).alias("timestamp_seconds"), F.format_string("frame_%06d.jpg", "frame_number").alias("filename"))
    lists = frames.join(videos, "video_id").groupBy("video_id").agg(F.sort_array(F.collect_list(one)).alias("frames"))
    out = videos.join(lists, "video_id", "left").withColumn("frames", F.coalesce("frames", F.array().cast("array<struct<frame_number:bigint,timestamp_seconds:double,filename:string>>")))
    return out.select("video_id", c("path").alias("video"), F.size("frames").cast("long").alias("total_extracted_frames"), "frames")
