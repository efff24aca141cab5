"""Inputs: track points, calibrations, annotations, videos."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

POINT = "track_id long, frame_number long, timestamp_seconds double, x double, y double, predicted boolean"
#: Hours of the event table that make a second of a track.
TIME_SCALE = 3.6e10


def order_in_track() -> Window:
    return Window.partitionBy("track_id").orderBy("timestamp_seconds", "frame_number")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One track for each user of the event table: POINT and event_id. The key has its last name before the windows, so what follows finds
    the rows where they are."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("track_id"), "event_type", "value", "props")
    track = Window.partitionBy("track_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        "track_id",
        "event_id",
        (F.row_number().over(track.orderBy("ts", "event_id")) - 1).cast("long").alias("frame_number"),
        ((us - F.min(us).over(track)) / F.lit(TIME_SCALE)).alias("timestamp_seconds"),
        F.col("value").alias("x"),
        (F.get_json_object("props", "$.k").cast("double") * 5).alias("y"),
        (F.col("event_type") == "error").alias("predicted"),
    )


def load_trajectory(spark: SparkSession, path: str) -> DataFrame:
    """Points of JSON documents with a `trajectory` list; a missing `predicted` is false. The file's name is the video."""
    point = T.StructType.fromDDL("frame_number long, timestamp_seconds double, x double, y double, predicted boolean, source string, confidence double, segment_id int")
    schema = T.StructType([T.StructField("trajectory", T.ArrayType(point))])
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("video", F.input_file_name())
    missing = F.raise_error(F.concat(F.lit("no trajectory in "), "video")).cast(T.ArrayType(point))
    checked = raw.withColumn("trajectory", F.coalesce("trajectory", missing))
    return checked.select("video", F.inline("trajectory")).withColumn("predicted", F.coalesce("predicted", F.lit(False)))


ANNOTATION = "shot_id string, video string, rally_id int, start_frame int, end_frame int, center_frame int, duration_sec double, suggested_player string, label string, confidence string, labeled_by string, notes string"


def load_annotations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATION).csv(path, header=True)


def load_dataset(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A CSV of shot features; an empty one is refused."""
    df = spark.read.schema(schema).csv(path, header=True) if schema else spark.read.csv(path, header=True, inferSchema=True)
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def load_calibration(spark: SparkSession, path: str) -> DataFrame:
    """calibration_id (the file's name where it has none), court_type, homography (3 x 3 by rows, under either of its names), and the error
    that the file tells."""
    schema = "calibration_id string, court_type string, court_dimensions struct<type:string>, homography array<array<double>>, homography_matrix array<array<double>>, reprojection_error_meters double, frame_of_reference string"
    raw = spark.read.schema(schema).json(path, multiLine=True).withColumn("calibration_id", F.coalesce("calibration_id", F.regexp_extract(F.input_file_name(), r"([^/]*)\.[^.]*$", 1)))
    return raw.select("calibration_id", F.coalesce("court_type", "court_dimensions.type").alias("court_type"), F.coalesce("homography", "homography_matrix").alias("homography"), "reprojection_error_meters", "frame_of_reference")


def load_keypoints(spark: SparkSession, path: str) -> DataFrame:
    """calibration_id, name, x, y, court_x, court_y of the key points of calibration files: a list of points with image and court
    coordinates, or a map from names to image coordinates (whose court coordinates are null)."""
    text = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    points = F.get_json_object("value", "$.keypoints")
    name = F.coalesce(F.get_json_object("value", "$.calibration_id"), F.regexp_extract("file", r"([^/]*)\.[^.]*$", 1))
    listed = F.from_json(points, "array<struct<name:string,image_coords:array<double>,court_coords:array<double>>>")
    named = F.transform(F.map_entries(F.from_json(points, "map<string,array<double>>")), lambda e: F.struct(e["key"].alias("name"), e["value"].alias("image_coords"), F.lit(None).cast("array<double>").alias("court_coords")))
    every = text.select(name.alias("calibration_id"), F.explode(F.when(points.startswith("["), listed).otherwise(named)).alias("p"))
    at = lambda kind, i: F.get(F.col(f"p.{kind}_coords"), F.lit(i))
    return every.select("calibration_id", "p.name", at("image", 0).alias("x"), at("image", 1).alias("y"), at("court", 0).alias("court_x"), at("court", 1).alias("court_y"))


VIDEO_TYPES = ("mp4", "mov", "avi", "mkv", "webm")


def video_files(spark: SparkSession, path: str) -> DataFrame:
    """path, extension, bytes and acceptability (known type, not empty, at most 100 MB) of files, without reading them."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("length").alias("bytes"))
    files = files.withColumn("extension", F.lower(F.element_at(F.split("path", r"\."), -1)))
    ok = F.col("extension").isin(*VIDEO_TYPES) & (F.col("bytes") > 0) & (F.col("bytes") <= 100 * 1024 * 1024)
    return files.withColumn("acceptable", ok)


#: The adapter of event_tracks() in SQL.
TRACKS_SQL = f"""tracks AS (
  SELECT user_id AS track_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_number,
    (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / CAST({TIME_SCALE} AS DOUBLE) AS timestamp_seconds,
    value AS x, CAST(json_extract_string(props, '$.k') AS DOUBLE) * 5 AS y, event_type = 'error' AS predicted
  FROM events
)"""
