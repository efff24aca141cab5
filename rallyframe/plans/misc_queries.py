"""Smaller queries: seeking frames, camera motion, splits, sessions, semi joins and roll-ups, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rallyframe.operators import classifier, overlay, pixels, shots, videos
from rallyframe.operators import detections as D
from rallyframe.plans.detection_queries import _CLIPS_SQL, BOXES_SQL, boxes, labelled
from rallyframe.plans.track_queries import CALLS_SQL, bounces, line_calls
from rallyframe.sources import sinks
from rallyframe.sources.tracks import TRACKS_SQL, event_tracks, table
from rallyframe.streaming import live

c = F.col


def frames_at(spark, sf_dir):
    """Seeks a timestamp in every frame of every video."""
    frames = boxes(spark, sf_dir).select("video_id", "frame_number").distinct()
    videos = frames.groupBy("video_id").agg(F.lit(25.0).alias("fps"), ((F.max("frame_number") + 1) / 25.0).alias("duration_seconds"))
    wanted = frames.select("video_id", (c("frame_number") / 25.0 + 0.013).alias("wanted_seconds"))
    return D.at_timestamps(frames, wanted, videos).select("video_id", "frame_number", F.round("wanted_seconds", 4).alias("wanted_seconds"))


def every_frame_at(spark, sf_dir):
    """The name under which frames_at() had no bound before."""
    return frames_at(spark, sf_dir)


def camera_motion(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((c("event_id") % 97).alias("video_id"), ((c("event_id") * 13) % (c("event_id") % 97 + 1)).cast("double").alias("difference"))
    return pixels.camera_motion(e)


def stratified_split(spark, sf_dir):
    return classifier.stratified_split(labelled(spark, sf_dir), "label", "o_orderkey").select("o_orderkey", "label", "is_test")


def session_rallies(spark, sf_dir):
    return live.stream_rallies(event_tracks(spark, sf_dir)).select("track_id", F.round("start_time", 4).alias("start_time"), F.round("end_time", 4).alias("end_time"), "trajectory_points")


def detection_rate(spark, sf_dir):
    out = live.stream_detection_rate(event_tracks(spark, sf_dir))
    return out.select("track_id", F.unix_seconds("window_start").alias("window_start"), "points", "detected")


def called_bounces(spark, sf_dir):
    called = line_calls(spark, sf_dir).where("call = 'IN'").select(F.concat_ws("-", "track_id", "frame_number").alias("shot_id"))
    wanted = bounces(spark, sf_dir).select(F.concat_ws("-", "track_id", "frame_number").alias("shot_id"), "bounce_score")
    return sinks.existing_clips(wanted, called)


def call_rollup(spark, sf_dir):
    return line_calls(spark, sf_dir).rollup("call", "zone").agg(F.count("*").alias("bounces"), F.count_if("near_line").alias("near_line"))


def frames_with_analytics(spark, sf_dir):
    frames = boxes(spark, sf_dir).select("video_id", "frame_number").distinct()
    found = D.ball_candidates(boxes(spark, sf_dir)).groupBy("video_id", "frame_number").agg(F.max_by("candidate_id", F.struct("ranking_score", "candidate_id")).alias("last_candidate"))
    return frames.join(found, ["video_id", "frame_number"], "left").select("frame_number", F.coalesce("last_candidate", F.lit(-1)).alias("candidate"))


def candidate_union(spark, sf_dir):
    b = boxes(spark, sf_dir).select("frame_number", "candidate_id", "confidence")
    bag = b.where("confidence > 0.5").withColumn("source", F.lit("detector")).unionByName(b.where("candidate_id = 2").withColumn("source", F.lit("bright_contour")))
    return bag.groupBy("source", "frame_number").agg(F.count("*").alias("candidates"))


def probes(spark, sf_dir):
    """A probe of a video for each order."""
    k = c("o_orderkey")
    code = F.get(F.array(*(F.lit(x) for x in (828601953, 1145656920, 0, 875967080))), (k % 4).cast("int"))
    path = F.concat(F.lit("/videos/"), c("o_custkey").cast("string"), F.lit("/Match "), k.cast("string"), F.get(F.array(F.lit(".MP4"), F.lit(".mov"), F.lit(".Tar.AVI")), (k % 3).cast("int")))
    return table(spark, sf_dir, "orders").select(path.alias("path"), (k * 12345 + 7).alias("bytes"), (20 + k % 41 + 0.97).alias("fps"), (k % 300000 + 1).alias("frame_count"), (c("o_custkey") % 16 * 120 + 120).alias("width"), (k % 9 * 120 + 120).alias("height"), code.alias("fourcc"))


def video_metadata(spark, sf_dir):
    return videos.described(probes(spark, sf_dir))


def first_frames(spark, sf_dir):
    frames = boxes(spark, sf_dir).select("video_id", "frame_number").distinct()
    return videos.first_frames(frames.select("video_id").distinct(), frames)


def safe_names(spark, sf_dir):
    p = table(spark, sf_dir, "pages").select("page_id", videos.safe_name(c("url")).alias("safe_name"))
    return p


def captions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", c("value"), (c("event_id") % 2000 + 100).alias("height"))
    speed = overlay.speed_caption(F.when(c("event_id") % 3 > 0, c("event_id") % 400 / 4.0))
    score = overlay.score_caption("A", F.lit("40"), c("event_id") % 7, c("event_id") % 3)
    return e.select("event_id", overlay.time_caption(c("event_id") / 4.0).alias("time"), speed.alias("speed"), score.alias("score"), F.round(overlay.font_scale(c("height")), 6).alias("font_scale"), overlay.font_thickness(c("height")).alias("font_thickness"))


def recent_points(spark, sf_dir):
    out = overlay.recent(event_tracks(spark, sf_dir))
    return out.select("track_id", "frame_number", F.size("history").cast("long").alias("points"), F.get("history", 0)["frame_number"].alias("oldest"), F.round(F.aggregate("history", F.lit(0.0), lambda a, h: a + h["x"]), 4).alias("sum_x"))


def suggested_clips(spark, sf_dir):
    runs = shots.visible_runs(event_tracks(spark, sf_dir).withColumn("visible", ~c("predicted")), 8)
    seen = lambda k: F.when((c("event_id") + k) % 5 > 0, c("event_id") * (k + 7) % 24)
    positions = event_tracks(spark, sf_dir).select("track_id", "frame_number", seen(0).alias("a_y"), seen(2).alias("b_y"))
    return overlay.suggested_players(shots.clip_windows(runs, fps=4.0), positions)


def suggested_players(spark, sf_dir):
    return suggested_clips(spark, sf_dir).select("track_id", "clip_id", "center_frame", "suggested_player")


QUERIES = {f.__name__: f for f in (video_metadata, first_frames, safe_names, captions, recent_points, suggested_players, frames_at, every_frame_at, camera_motion, stratified_split, session_rallies, detection_rate, called_bounces, call_rollup, frames_with_analytics, candidate_union)}

_NAMES = "['forehand', 'backhand', 'serve', 'volley']"

ORACLE = {
    "video_metadata": """WITH p AS (SELECT '/videos/' || o_custkey || '/Match ' || o_orderkey || ['.MP4', '.mov', '.Tar.AVI'][o_orderkey % 3 + 1] AS path, o_orderkey * 12345 + 7 AS bytes, 20 + o_orderkey % 41 + CAST(0.97 AS DOUBLE) AS fps,
        o_orderkey % 300000 + 1 AS n, o_custkey % 16 * 120 + 120 AS w, o_orderkey % 9 * 120 + 120 AS h, ['avc1', 'XVID', 'Unknown', 'h264'][o_orderkey % 4 + 1] AS codec FROM orders),
      d AS (SELECT *, n / fps AS s, CAST(round_even(n / fps, 0) AS BIGINT) AS whole FROM p)
      SELECT split_part(path, '/', 4) AS filename, path AS absolute_path, lower('.' || string_split(path, '.')[-1]) AS extension, bytes AS file_size_bytes, round(bytes / CAST(1048576 AS DOUBLE), 2) AS file_size_mb, round(fps, 2) AS fps, n AS frame_count,
        w AS width, h AS height, w || 'x' || h AS resolution, (w // gcd(w, h)) || ':' || (h // gcd(w, h)) AS aspect_ratio, round(s, 2) AS duration_seconds, printf('%02d:%02d:%02d', whole // 3600, whole // 60 % 60, whole % 60) AS duration_formatted, codec FROM d""",
    "first_frames": f"WITH {BOXES_SQL} SELECT video_id, min(frame_number) AS frame_number FROM boxes GROUP BY 1",
    "safe_names": """SELECT page_id, replace(replace(replace(replace(replace(replace(replace(replace(replace(url, '/', '_'), chr(92), '_'), '<', '_'), '>', '_'), ':', '_'), '"', '_'), '|', '_'), '?', '_'), '*', '_') AS safe_name FROM pages""",
    "captions": """WITH e AS (SELECT event_id, event_id % 2000 + 100 AS h FROM events)
      SELECT event_id, printf('Time: %.2fs', event_id / CAST(4 AS DOUBLE)) AS time, CASE WHEN event_id % 3 > 0 THEN printf('~%.1f km/h', (event_id % 400) / CAST(4 AS DOUBLE)) END AS speed, 'A: 40 | ' || event_id % 7 || ' | ' || event_id % 3 AS score,
        round(CAST(0.6 AS DOUBLE) * (h / CAST(720 AS DOUBLE)), 6) AS font_scale, greatest(1, CAST(floor(2 * (h / CAST(720 AS DOUBLE))) AS INT)) AS font_thickness FROM e""",
    "recent_points": f"""WITH {TRACKS_SQL} SELECT track_id, frame_number, count(*) OVER w AS points, first_value(frame_number) OVER w AS oldest, round(list_sum(list(x) OVER w), 4) AS sum_x FROM tracks
      WINDOW w AS (PARTITION BY track_id ORDER BY timestamp_seconds, frame_number ROWS BETWEEN 39 PRECEDING AND CURRENT ROW)""",
    "suggested_players": f"""WITH {_CLIPS_SQL}, p AS (SELECT track_id, frame_number, CASE WHEN event_id % 5 > 0 THEN event_id * 7 % 24 END AS a, CASE WHEN (event_id + 2) % 5 > 0 THEN event_id * 9 % 24 END AS b FROM tracks)
      SELECT c.track_id, clip_id, center_frame, CASE WHEN a < b THEN 'player_a' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'player_b' ELSE 'unknown' END AS suggested_player FROM clips c LEFT JOIN p ON p.track_id = c.track_id AND p.frame_number = center_frame""",
    **dict.fromkeys(("frames_at", "every_frame_at"), f"""WITH {BOXES_SQL}, f AS (SELECT DISTINCT video_id, frame_number FROM boxes),
      w AS (SELECT video_id, frame_number / CAST(25 AS DOUBLE) + CAST(0.013 AS DOUBLE) AS wanted_seconds FROM f)
      SELECT f.video_id, f.frame_number, round(wanted_seconds, 4) AS wanted_seconds FROM w JOIN f ON f.video_id = w.video_id AND f.frame_number = CAST(round(wanted_seconds * 25) AS BIGINT)"""),
    "camera_motion": """WITH e AS (SELECT event_id % 97 AS video_id, CAST((event_id * 13) % (event_id % 97 + 1) AS DOUBLE) AS d FROM events)
      SELECT video_id, round(avg(d), 4) AS mean_difference, CASE WHEN avg(d) < 5 THEN 'STATIC' WHEN avg(d) < 15 THEN 'MOSTLY_STATIC' ELSE 'MOVING' END AS camera FROM e GROUP BY 1""",
    "stratified_split": f"""WITH l AS (SELECT o_orderkey, {_NAMES}[o_orderkey % 4 + 1] AS label FROM orders),
      p AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS place, count(*) OVER (PARTITION BY label) AS n FROM l)
      SELECT o_orderkey, label, place <= greatest(round(n * CAST(0.2 AS DOUBLE)), 1) AND n >= 2 AS is_test FROM p""",
    "session_rallies": f"""WITH {TRACKS_SQL}, u AS (SELECT *, CAST(floor(timestamp_seconds * 1000000) AS BIGINT) AS us FROM tracks),
      g AS (SELECT *, CAST(coalesce(us - lag(us) OVER (PARTITION BY track_id ORDER BY us, frame_number) > 1250000, FALSE) AS INT) AS starts FROM u),
      s AS (SELECT *, sum(starts) OVER (PARTITION BY track_id ORDER BY us, frame_number) AS part FROM g)
      SELECT track_id, round(min(timestamp_seconds), 4) AS start_time, round(max(timestamp_seconds), 4) AS end_time, count(*) AS trajectory_points FROM s GROUP BY track_id, part HAVING count(*) >= 4""",
    "detection_rate": f"""WITH {TRACKS_SQL}, w AS (SELECT track_id, predicted, unnest(range(CAST(floor(timestamp_seconds) AS BIGINT) - 4, CAST(floor(timestamp_seconds) AS BIGINT) + 1)) AS window_start FROM tracks)
      SELECT track_id, window_start, count(*) AS points, count(*) FILTER (NOT predicted) AS detected FROM w GROUP BY 1, 2""",
    "called_bounces": f"WITH {CALLS_SQL} SELECT b.track_id || '-' || b.frame_number AS shot_id, b.score AS bounce_score FROM bounces b JOIN calls c USING (track_id, frame_number) WHERE call = 'IN'",
    "call_rollup": f"WITH {CALLS_SQL} SELECT call, zone, count(*) AS bounces, count(*) FILTER (near_line) AS near_line FROM calls GROUP BY ROLLUP (call, zone)",
    "frames_with_analytics": f"""WITH {BOXES_SQL}, best AS (SELECT frame_number, candidate_id, row_number() OVER (PARTITION BY frame_number ORDER BY ranking_score DESC, candidate_id DESC) AS place FROM ranked)
      SELECT f.frame_number, coalesce(candidate_id, -1) AS candidate FROM (SELECT DISTINCT frame_number FROM boxes) f LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (frame_number)""",
    "candidate_union": f"""WITH {BOXES_SQL}, bag AS (SELECT 'detector' AS source, frame_number FROM boxes WHERE confidence > 0.5 UNION ALL SELECT 'bright_contour', frame_number FROM boxes WHERE candidate_id = 2)
      SELECT source, frame_number, count(*) AS candidates FROM bag GROUP BY 1, 2""",
}

