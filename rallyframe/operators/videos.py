"""Videos as rows: what a probe tells of a file, named and checked; first frames; upload names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col


def fourcc_text(code: Column) -> Column:
    """The four letters of a codec number, the first in its lowest byte; `Unknown` if it isn't positive or has none."""
    letters = F.concat(*(F.chr(F.shiftright(code.cast("long"), 8 * i).bitwiseAND(255)) for i in range(4)))
    text = F.trim(letters)
    return F.when((code <= 0) | (text == ""), "Unknown").otherwise(text)


def aspect_ratio(width: Column, height: Column) -> Column:
    """As whole numbers without a common divisor; Euclid's steps on two 32-bit numbers are fewer than 48."""
    start = F.struct(width.cast("long").alias("a"), height.cast("long").alias("b"))
    step = lambda s, _: F.struct(F.when(s["b"] == 0, s["a"]).otherwise(s["b"]).alias("a"), F.when(s["b"] == 0, F.lit(0).cast("long")).otherwise(s["a"] % s["b"]).alias("b"))
    divisor = F.aggregate(F.sequence(F.lit(1), F.lit(48)), start, step, lambda s: s["a"])
    part = lambda v: F.floor(v / divisor).cast("string")
    return F.when((width <= 0) | (height <= 0), "Unknown").otherwise(F.concat(part(width), F.lit(":"), part(height)))


def duration_text(seconds: Column) -> Column:
    """HH:MM:SS of whole seconds, halves to even; never below zero."""
    whole = F.greatest(F.lit(0).cast("long"), F.bround(seconds, 0).cast("long"))
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)


def described(probes: DataFrame) -> DataFrame:
    """The metadata of each video. probes: path, bytes, fps, frame_count, width, height, fourcc; one that tells no rate, frame or size is
    refused."""
    bad = F.when(c("fps") <= 0, "no frame rate in ").when(c("frame_count") <= 0, "no frames in ").when((c("width") <= 0) | (c("height") <= 0), "no size in ")
    checked = probes.where(F.when(bad.isNotNull(), F.raise_error(F.concat(bad, "path")).cast("boolean")).otherwise(True))
    name = F.element_at(F.split("path", "/"), -1)
    seconds = c("frame_count") / c("fps")
    return checked.select(
        name.alias("filename"), c("path").alias("absolute_path"), F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1)).alias("extension"), c("bytes").alias("file_size_bytes"),
        F.round(c("bytes") / (1024 * 1024), 2).alias("file_size_mb"), F.round("fps", 2).alias("fps"), "frame_count", "width", "height", F.concat_ws("x", c("width").cast("string"), c("height").cast("string")).alias("resolution"),
        aspect_ratio(c("width"), c("height")).alias("aspect_ratio"), F.round(seconds, 2).alias("duration_seconds"), duration_text(seconds).alias("duration_formatted"), fourcc_text(c("fourcc")).alias("codec"),
    )


def first_frames(videos: DataFrame, frames: DataFrame) -> DataFrame:
    """The first frame of each video; one without frames is refused."""
    first = frames.groupBy("video_id").agg(F.min_by(F.struct("*"), "frame_number").alias("frame"))
    joined = videos.select("video_id").join(first, "video_id", "left")
    missing = F.raise_error(F.concat(F.lit("no first frame of video "), c("video_id").cast("string")))
    return joined.where(F.when(c("frame").isNull(), missing.cast("boolean")).otherwise(True)).select("frame.*")


def safe_name(name: Column) -> Column:
    """A file name without path separators and characters that shells and file systems treat specially."""
    return F.regexp_replace(name, r'[/\\<>:"|?*]', "_")
