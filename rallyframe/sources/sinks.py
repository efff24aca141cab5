"""Outputs: nested JSON documents, features as CSV, calibrations that pass their check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_frame_documents(documents: DataFrame, path: str) -> None:
    """One JSON line for each frame, in a folder for each video: a video of any length needs no single task."""
    documents.write.partitionBy("video_id").json(path)


def write_features(features: DataFrame, path: str) -> None:
    features.write.option("header", True).csv(path)


def write_calibrations(solved: DataFrame, path: str) -> None:
    """Refuses the whole write if a calibration wasn't accepted."""
    checked = solved.where(F.when(F.col("accepted"), True).otherwise(F.raise_error(F.concat(F.lit("not accepted: "), "calibration_id")).cast("boolean")))
    checked.write.json(path)


def annotation_template(clips: DataFrame, fps: float) -> DataFrame:
    """Rows to label by hand, in load_annotations' columns. Clips with a suggested_player (overlay.suggested_players) bring it along."""
    text = F.lit("")
    guess = F.coalesce("suggested_player", text) if "suggested_player" in clips.columns else text
    return clips.select(
        F.col("clip_id").alias("shot_id"), F.col("track_id").cast("string").alias("video"), F.lit(None).cast("int").alias("rally_id"), F.col("clip_start").cast("int").alias("start_frame"),
        F.col("clip_end").cast("int").alias("end_frame"), F.col("center_frame").cast("int").alias("center_frame"), F.round((F.col("clip_end") - F.col("clip_start")) / fps, 3).alias("duration_sec"),
        guess.alias("suggested_player"), F.lit("unlabeled").alias("label"), text.alias("confidence"), text.alias("labeled_by"), text.alias("notes"),
    )


def write_documents(documents: DataFrame, path: str) -> None:
    """One JSON line for each document."""
    documents.write.json(path)


def existing_clips(annotations: DataFrame, clips: DataFrame) -> DataFrame:
    """The annotations whose clip is there."""
    return annotations.join(clips.select("shot_id").distinct(), "shot_id", "left_semi")
