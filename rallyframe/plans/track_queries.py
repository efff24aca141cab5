"""Queries over tracks: bounces, court calls, speeds, rallies and shots, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.config import CourtConfig
from rallyframe.functions import geometry as G
from rallyframe.operators import court, shots, speed, trajectory
from rallyframe.sources.tracks import TRACKS_SQL, event_tracks

#: Maps the test corners (100, 100)-(500, 700) to a singles court.
AFFINE: G.Matrix = ((8.23 / 400, 0.0, -8.23 / 4), (0.0, 23.77 / 600, -23.77 / 6), (0.0, 0.0, 1.0))
#: A camera's view: not affine.
PROJECTIVE: G.Matrix = ((0.02, 0.001, -2.0), (0.0005, 0.04, -4.0), (0.00001, 0.0008, 1.0))
COURT = CourtConfig()


def players(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_tracks(spark, sf_dir).withColumn("player_label", F.when(F.col("event_id") % 2 == 0, "A").otherwise("B"))


def motion_windows(spark, sf_dir):
    return trajectory.motion_windows(event_tracks(spark, sf_dir)).drop("timestamp_seconds")


def bounce_candidates(spark, sf_dir):
    return trajectory.bounce_candidates(event_tracks(spark, sf_dir)).select("track_id", "frame_number", "direction_change", "vertical_reversal", "prediction_ratio", "bounce_score")


def bounces(spark, sf_dir) -> DataFrame:
    return trajectory.deduplicated(trajectory.bounce_candidates(event_tracks(spark, sf_dir)))


def bounce_dedup(spark, sf_dir):
    return bounces(spark, sf_dir).select("track_id", F.col("bounce_group").cast("long").alias("bounce_group"), "frame_number", "bounce_score")


def line_calls(spark, sf_dir):
    out = court.line_calls(bounces(spark, sf_dir), AFFINE)
    return out.select("track_id", "frame_number", "court_x", "court_y", "call", "strictly_inside", "near_line", "zone", "nearest", "to_nearest", "accepted")


def call_summary(spark, sf_dir):
    return court.call_summary(court.line_calls(bounces(spark, sf_dir), AFFINE), "zone")


def projective_points(spark, sf_dir):
    x, y = G.project(PROJECTIVE, F.col("x"), F.col("y"))
    out = event_tracks(spark, sf_dir).select("event_id", "x", "y", x.alias("court_x"), y.alias("court_y"))
    bx, by = G.project(G.inverse(PROJECTIVE), F.col("court_x"), F.col("court_y"), 1)
    side = G.court_side(F.col("court_y"), COURT)
    return out.select("event_id", "court_x", "court_y", side.alias("side"), (F.abs(bx - F.col("x")) < 0.5).alias("back_x"), (F.abs(by - F.col("y")) < 0.5).alias("back_y"))


def reprojection_error(spark, sf_dir):
    x, y = G.project(AFFINE, F.col("x"), F.col("y"), None)
    pairs = event_tracks(spark, sf_dir).select("track_id", "x", "y", (x + F.col("frame_number") % 3 * 0.1).alias("court_x"), (y - F.col("frame_number") % 2 * 0.2).alias("court_y"))
    return court.reprojection_error(pairs, AFFINE, "track_id")


def ball_speed(spark, sf_dir):
    return speed.ball_speed(event_tracks(spark, sf_dir), AFFINE).drop("timestamp_seconds")


def ball_speed_summary(spark, sf_dir):
    return speed.speed_summary(speed.ball_speed(event_tracks(spark, sf_dir), AFFINE), "track_id")


def player_motion(spark, sf_dir):
    return speed.player_motion(players(spark, sf_dir), AFFINE)


def player_summary(spark, sf_dir):
    return speed.speed_summary(speed.player_motion(players(spark, sf_dir), AFFINE), "track_id", "player_label")


def rallies(spark, sf_dir):
    return shots.rallies(event_tracks(spark, sf_dir)).select("track_id", "rally_id", "frame_number")


def shot_rows(spark, sf_dir) -> DataFrame:
    return shots.shot_points(shots.rallies(event_tracks(spark, sf_dir)))


def shot_points(spark, sf_dir):
    return shot_rows(spark, sf_dir).select("track_id", "rally_id", "shot_in_rally", "frame_number")


def shot_features(spark, sf_dir):
    return shots.shot_features(shot_rows(spark, sf_dir))


def rally_summary(spark, sf_dir):
    return shots.rally_summary(shots.rallies(event_tracks(spark, sf_dir)))


def trajectory_summary(spark, sf_dir):
    return trajectory.trajectory_summary(event_tracks(spark, sf_dir))


WINDOWS_SQL = f"""{TRACKS_SQL},
lagged AS (
  SELECT *, lag(timestamp_seconds) OVER w AS pt, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(predicted) OVER w AS pp,
    lead(timestamp_seconds) OVER w AS nt, lead(x) OVER w AS nx, lead(y) OVER w AS ny, lead(predicted) OVER w AS np
  FROM tracks WINDOW w AS (PARTITION BY track_id ORDER BY timestamp_seconds, frame_number)
),
moved AS (
  SELECT *, CASE WHEN timestamp_seconds - pt < 0.001 THEN 0 ELSE (x - px) / (timestamp_seconds - pt) END AS vx1,
    CASE WHEN timestamp_seconds - pt < 0.001 THEN 0 ELSE (y - py) / (timestamp_seconds - pt) END AS vy1,
    CASE WHEN nt - timestamp_seconds < 0.001 THEN 0 ELSE (nx - x) / (nt - timestamp_seconds) END AS vx2,
    CASE WHEN nt - timestamp_seconds < 0.001 THEN 0 ELSE (ny - y) / (nt - timestamp_seconds) END AS vy2,
    sqrt((x - px) * (x - px) + (y - py) * (y - py)) AS d1, sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y)) AS d2,
    (CAST(pp AS INT) + CAST(predicted AS INT) + CAST(np AS INT)) / CAST(3 AS DOUBLE) AS ratio
  FROM lagged WHERE pt IS NOT NULL AND nt IS NOT NULL
),
turned AS (
  SELECT *, vy1 > 0 AND vy2 < 0 AS rev, sqrt(vx1 * vx1 + vy1 * vy1) * sqrt(vx2 * vx2 + vy2 * vy2) AS size FROM moved
),
angled AS (
  SELECT *, CASE WHEN size = 0 THEN CAST(0 AS DOUBLE)
    ELSE round(degrees(acos(greatest(CAST(-1 AS DOUBLE), least(CAST(1 AS DOUBLE), (vx1 * vx2 + vy1 * vy2) / size)))), 3) END AS ang FROM turned
),
scored AS (
  SELECT *, greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), CASE WHEN rev THEN CAST(0.45 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END
    + least(ang / CAST(45 AS DOUBLE), CAST(1 AS DOUBLE)) * CAST(0.35 AS DOUBLE) + (1 - ratio) * CAST(0.2 AS DOUBLE))) AS raw FROM angled
),
windows AS (
  SELECT *, d1 >= 2 AND d2 >= 2 AS sufficient, d1 >= 2 AND d2 >= 2 AND ang >= 20 AND ratio <= 0.5 AND raw >= CAST(0.55 AS DOUBLE) AS is_candidate,
    round(raw, 4) AS score FROM scored
)"""

BOUNCES_SQL = f"""{WINDOWS_SQL},
candidates AS (SELECT * FROM windows WHERE is_candidate),
marked AS (SELECT *, coalesce(frame_number - lag(frame_number) OVER (PARTITION BY track_id ORDER BY frame_number) > 4, TRUE) AS starts FROM candidates),
grouped AS (SELECT *, sum(CAST(starts AS INT)) OVER (PARTITION BY track_id ORDER BY frame_number) AS bounce_group FROM marked),
placed AS (SELECT *, row_number() OVER (PARTITION BY track_id, bounce_group ORDER BY score DESC, frame_number) AS place FROM grouped),
bounces AS (SELECT * FROM placed WHERE place = 1)"""


def _court_sql(source: str, name: str) -> str:
    return f"""{name}_xy AS (
  SELECT *, round((CAST({AFFINE[0][0]!r} AS DOUBLE) * x + CAST(0 AS DOUBLE) * y + CAST({AFFINE[0][2]!r} AS DOUBLE)) / (CAST(0 AS DOUBLE) * x + CAST(0 AS DOUBLE) * y + CAST(1 AS DOUBLE)) * CAST(10000 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS court_x,
    round((CAST(0 AS DOUBLE) * x + CAST({AFFINE[1][1]!r} AS DOUBLE) * y + CAST({AFFINE[1][2]!r} AS DOUBLE)) / (CAST(0 AS DOUBLE) * x + CAST(0 AS DOUBLE) * y + CAST(1 AS DOUBLE)) * CAST(10000 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS court_y
  FROM {source}
),
{name} AS (
  SELECT *, court_x BETWEEN 0 AND 8.23 AND court_y BETWEEN 0 AND 23.77 AS inside,
    CASE WHEN NOT (court_x BETWEEN 0 AND 8.23 AND court_y BETWEEN 0 AND 23.77) THEN 'out' ELSE
      CASE WHEN court_y < CAST(23.77 AS DOUBLE) / 3 THEN 'far_backcourt' WHEN court_y < 2 * CAST(23.77 AS DOUBLE) / 3 THEN 'midcourt' ELSE 'near_backcourt' END
      || CASE WHEN court_x < CAST(8.23 AS DOUBLE) / 2 THEN '_left' ELSE '_right' END END AS zone
  FROM {name}_xy
)"""


CALLS_SQL = f"""{BOUNCES_SQL},
{_court_sql("bounces", "located")},
flagged AS (
  SELECT *, court_x BETWEEN -0.05 AND CAST(8.23 AS DOUBLE) + 0.05 AND court_y BETWEEN -0.05 AND CAST(23.77 AS DOUBLE) + 0.05 AS within,
    [round(court_x, 4), round(CAST(8.23 AS DOUBLE) - court_x, 4), round(court_y, 4), round(CAST(23.77 AS DOUBLE) - court_y, 4)] AS d
  FROM located
),
calls AS (
  SELECT track_id, frame_number, court_x, court_y, CASE WHEN within THEN 'IN' ELSE 'OUT' END AS call, inside AS strictly_inside,
    within AND (abs(court_x) <= 0.05 OR abs(court_x - CAST(8.23 AS DOUBLE)) <= 0.05 OR abs(court_y) <= 0.05 OR abs(court_y - CAST(23.77 AS DOUBLE)) <= 0.05) AS near_line,
    CASE WHEN within THEN zone ELSE 'out' END AS zone,
    CASE WHEN abs(d[1]) <= least(abs(d[2]), abs(d[3]), abs(d[4])) THEN 'left' WHEN abs(d[2]) <= least(abs(d[3]), abs(d[4])) THEN 'right' WHEN abs(d[3]) <= abs(d[4]) THEN 'far' ELSE 'near' END AS nearest,
    CASE WHEN abs(d[1]) <= least(abs(d[2]), abs(d[3]), abs(d[4])) THEN d[1] WHEN abs(d[2]) <= least(abs(d[3]), abs(d[4])) THEN d[2] WHEN abs(d[3]) <= abs(d[4]) THEN d[3] ELSE d[4] END AS to_nearest,
    score >= 0.55 AS accepted
  FROM flagged
)"""


def _running_sql(source: str, keys: str) -> str:
    """valid speeds (speed_kmh > 0) run along the track."""
    return f"""running AS (
  SELECT *, round(CAST(coalesce(sum(CASE WHEN speed_kmh > 0 THEN CAST(round(step * CAST(1e9 AS DOUBLE)) AS BIGINT) END) OVER u, 0) AS DOUBLE) / CAST(1e6 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS total_distance,
    coalesce(max(CASE WHEN speed_kmh > 0 THEN speed_kmh END) OVER u, 0) AS peak_kmh,
    round(coalesce(CAST(sum(CASE WHEN speed_kmh > 0 THEN CAST(round(speed_kmh * 1000) AS BIGINT) END) OVER u AS DOUBLE) / CAST(count(CASE WHEN speed_kmh > 0 THEN 1 END) OVER u AS DOUBLE), 0)) / CAST(1000 AS DOUBLE) AS average_kmh,
    list_reverse(list_reverse(list_filter(list(CASE WHEN speed_kmh > 0 THEN speed_kmh END) OVER u, lambda v: v IS NOT NULL))[1:5]) AS recent
  FROM {source} WINDOW u AS (PARTITION BY {keys} ORDER BY timestamp_seconds, frame_number ROWS UNBOUNDED PRECEDING)
),
speeds AS (SELECT *, CASE WHEN len(recent) > 0 THEN round(CAST(list_sum(list_transform(recent, lambda v: CAST(round(v * 1000) AS BIGINT))) AS DOUBLE) / len(recent)) / CAST(1000 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS smoothed_kmh FROM running)"""


def _kmh_sql(most: int) -> str:
    return f"CASE WHEN dt < 0.001 OR step < 0.01 OR step / CASE WHEN dt < 0.001 THEN 1 ELSE dt END * CAST(3.6 AS DOUBLE) > {most} THEN CAST(0 AS DOUBLE) ELSE round(step / dt * CAST(3.6 AS DOUBLE), 3) END"


BALL_SQL = f"""{TRACKS_SQL},
{_court_sql("tracks", "located")},
seen AS (
  SELECT *, lag(CASE WHEN NOT predicted THEN timestamp_seconds END IGNORE NULLS) OVER w AS pt, lag(CASE WHEN NOT predicted THEN court_x END IGNORE NULLS) OVER w AS px,
    lag(CASE WHEN NOT predicted THEN court_y END IGNORE NULLS) OVER w AS py
  FROM located WINDOW w AS (PARTITION BY track_id ORDER BY timestamp_seconds, frame_number)
),
stepped AS (
  SELECT *, CASE WHEN pt IS NOT NULL AND timestamp_seconds - pt > 0 AND NOT predicted THEN sqrt((court_x - px) * (court_x - px) + (court_y - py) * (court_y - py)) ELSE CAST(0 AS DOUBLE) END AS step,
    CASE WHEN pt IS NOT NULL AND timestamp_seconds - pt > 0 AND NOT predicted THEN timestamp_seconds - pt ELSE CAST(0 AS DOUBLE) END AS dt FROM seen
),
moved AS (SELECT *, {_kmh_sql(300)} AS speed_kmh FROM stepped),
{_running_sql("moved", "track_id")}"""

PLAYER_SQL = f"""{TRACKS_SQL},
labelled AS (SELECT *, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS player_label FROM tracks),
{_court_sql("labelled", "located")},
seen AS (
  SELECT *, lag(timestamp_seconds) OVER w AS pt, lag(court_x) OVER w AS px, lag(court_y) OVER w AS py
  FROM located WINDOW w AS (PARTITION BY track_id, player_label ORDER BY timestamp_seconds, frame_number)
),
stepped AS (
  SELECT *, CASE WHEN pt IS NOT NULL AND timestamp_seconds - pt > 0 THEN round(sqrt((court_x - px) * (court_x - px) + (court_y - py) * (court_y - py)), 4) ELSE CAST(0 AS DOUBLE) END AS step,
    CASE WHEN pt IS NOT NULL AND timestamp_seconds - pt > 0 THEN timestamp_seconds - pt ELSE CAST(0 AS DOUBLE) END AS dt FROM seen
),
moved AS (SELECT *, {_kmh_sql(40)} AS speed_kmh FROM stepped),
{_running_sql("moved", "track_id, player_label")}"""


def _summary_sql(keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS samples, count(*) FILTER (speed_kmh > 0) AS valid_samples,
  round(sum(CASE WHEN speed_kmh > 0 THEN round(step, 4) ELSE 0 END), 2) AS distance,
  round(coalesce(avg(CASE WHEN speed_kmh > 0 THEN speed_kmh END), 0), 2) AS average_kmh, round(max(speed_kmh), 3) AS top_kmh,
  max_by(smoothed_kmh, frame_number) AS latest_smoothed_kmh, 'estimated_court_plane' AS speed_type FROM speeds GROUP BY {keys}"""


RALLIES_SQL = f"""{TRACKS_SQL},
gaps AS (SELECT *, CAST(coalesce(timestamp_seconds - lag(timestamp_seconds) OVER (PARTITION BY track_id ORDER BY timestamp_seconds, frame_number) > 1.25, FALSE) AS INT) AS starts FROM tracks),
parts AS (SELECT *, sum(starts) OVER (PARTITION BY track_id ORDER BY timestamp_seconds, frame_number) AS part FROM gaps),
sized AS (SELECT *, count(*) OVER (PARTITION BY track_id, part) AS part_points FROM parts),
rallies AS (SELECT *, dense_rank() OVER (PARTITION BY track_id ORDER BY part) AS rally_id FROM sized WHERE part_points >= 4)"""

SHOTS_SQL = f"""{RALLIES_SQL},
ordered AS (
  SELECT *, row_number() OVER w AS i, lag(x) OVER w AS lx, lag(y) OVER w AS ly, lag(timestamp_seconds) OVER w AS lt
  FROM rallies WINDOW w AS (PARTITION BY track_id, rally_id ORDER BY timestamp_seconds, frame_number)
),
steps AS (SELECT *, sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)) AS d, degrees(atan2(y - ly, x - lx)) AS ang FROM ordered),
fold AS (
  SELECT track_id, rally_id, CAST(1 AS BIGINT) AS i, CAST(1 AS BIGINT) AS shot, timestamp_seconds AS began, CAST(1 AS BIGINT) AS size, CAST(NULL AS DOUBLE) AS last_angle, FALSE AS split FROM steps WHERE i = 1
  UNION ALL
  SELECT track_id, rally_id, i, CASE WHEN split THEN shot + 1 ELSE shot END, CASE WHEN split THEN lt ELSE began END, CASE WHEN split THEN 2 ELSE size + 1 END,
    CASE WHEN d < 4 THEN last_angle ELSE ang END, split
  FROM (
    SELECT s.track_id, s.rally_id, s.i, f.shot, f.began, f.size, f.last_angle, s.d, s.ang, s.lt,
      s.d >= 4 AND f.size >= 2 AND (coalesce(least(abs(s.ang - f.last_angle), 360 - abs(s.ang - f.last_angle)), 0) >= 35 OR s.timestamp_seconds - f.began >= 2.5) AS split
    FROM fold f JOIN steps s ON s.track_id = f.track_id AND s.rally_id = f.rally_id AND s.i = f.i + 1
  )
),
members AS (
  SELECT track_id, rally_id, shot, i FROM fold
  UNION ALL SELECT track_id, rally_id, shot, i - 1 FROM fold WHERE split
),
long_enough AS (SELECT track_id, rally_id, shot FROM members GROUP BY ALL HAVING count(*) >= 2),
shots AS (
  SELECT m.track_id, m.rally_id, dense_rank() OVER (PARTITION BY m.track_id, m.rally_id ORDER BY m.shot) AS shot_in_rally, m.i, o.frame_number, o.timestamp_seconds AS t, o.x, o.y, o.predicted
  FROM members m JOIN long_enough USING (track_id, rally_id, shot) JOIN ordered o USING (track_id, rally_id, i)
)"""

FEATURES_SQL = f"""{SHOTS_SQL},
pairs AS (
  SELECT *, lag(t) OVER w AS lt, lag(x) OVER w AS lx, lag(y) OVER w AS ly FROM shots WINDOW w AS (PARTITION BY track_id, rally_id, shot_in_rally ORDER BY i)
),
legs AS (
  SELECT *, sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)) AS moved, CASE WHEN t - lt > 0 THEN sqrt((x - lx) * (x - lx) + (y - ly) * (y - ly)) / (t - lt) END AS speed,
    CASE WHEN lx IS NULL THEN NULL WHEN x = lx AND y = ly THEN 0 ELSE degrees(atan2(y - ly, x - lx)) END AS angle FROM pairs
),
turns AS (
  SELECT *, abs(angle - lag(angle) OVER (PARTITION BY track_id, rally_id, shot_in_rally ORDER BY i)) AS raw_turn FROM legs
)
SELECT track_id, rally_id, shot_in_rally, min_by(frame_number, i) AS start_frame, max_by(frame_number, i) AS end_frame,
  round(min_by(t, i), 4) AS start_time, round(max_by(t, i), 4) AS end_time, round(greatest(0, max_by(t, i) - min_by(t, i)), 4) AS duration_seconds, count(*) AS point_count,
  round(min_by(x, i), 4) AS start_x, round(min_by(y, i), 4) AS start_y, round(max_by(x, i), 4) AS end_x, round(max_by(y, i), 4) AS end_y,
  round(max_by(x, i) - min_by(x, i), 4) AS delta_x, round(max_by(y, i) - min_by(y, i), 4) AS delta_y,
  round(sqrt((max_by(x, i) - min_by(x, i)) * (max_by(x, i) - min_by(x, i)) + (max_by(y, i) - min_by(y, i)) * (max_by(y, i) - min_by(y, i))), 4) AS displacement_pixels,
  round(coalesce(sum(moved), 0), 4) AS trajectory_distance_pixels, round(coalesce(avg(speed), 0), 4) AS average_speed_pixels_per_second, round(coalesce(max(speed), 0), 4) AS maximum_speed_pixels_per_second,
  round(coalesce(min(speed), 0), 4) AS minimum_speed_pixels_per_second, round(coalesce(avg(angle), 0), 4) AS average_direction_degrees,
  round(coalesce(avg(least(raw_turn, 360 - raw_turn)), 0), 4) AS mean_direction_change_degrees, round(coalesce(max(least(raw_turn, 360 - raw_turn)), 0), 4) AS max_direction_change_degrees,
  round(avg(CAST(predicted AS INT)), 4) AS predicted_point_ratio,
  row_number() OVER (PARTITION BY track_id ORDER BY rally_id, shot_in_rally) AS shot_id
FROM turns GROUP BY track_id, rally_id, shot_in_rally"""

_PROJECT = "(CAST({0!r} AS DOUBLE) * x + CAST({1!r} AS DOUBLE) * y + CAST({2!r} AS DOUBLE))"
_P = [_PROJECT.format(*row) for row in PROJECTIVE]

QUERIES = {
    f.__name__: f
    for f in (
        motion_windows, bounce_candidates, bounce_dedup, line_calls, call_summary, projective_points, reprojection_error, ball_speed, ball_speed_summary,
        player_motion, player_summary, rallies, shot_points, shot_features, rally_summary, trajectory_summary,
    )
}

ORACLE = {
    "motion_windows": f"""WITH {WINDOWS_SQL} SELECT track_id, frame_number, x, y, round(vx1, 3) AS vx_before, round(vy1, 3) AS vy_before, round(vx2, 3) AS vx_after, round(vy2, 3) AS vy_after,
      round(sqrt(vx1 * vx1 + vy1 * vy1), 3) AS speed_before, round(sqrt(vx2 * vx2 + vy2 * vy2), 3) AS speed_after, ang AS direction_change, rev AS vertical_reversal,
      round(ratio, 3) AS prediction_ratio, sufficient AS sufficient_motion, score AS bounce_score, is_candidate FROM windows""",
    "bounce_candidates": f"WITH {WINDOWS_SQL} SELECT track_id, frame_number, ang AS direction_change, rev AS vertical_reversal, round(ratio, 3) AS prediction_ratio, score AS bounce_score FROM windows WHERE is_candidate",
    "bounce_dedup": f"WITH {BOUNCES_SQL} SELECT track_id, CAST(bounce_group AS BIGINT) AS bounce_group, frame_number, score AS bounce_score FROM bounces",
    "line_calls": f"WITH {CALLS_SQL} SELECT * FROM calls",
    "call_summary": f"""WITH {CALLS_SQL} SELECT zone, count(*) AS bounces, count(*) FILTER (accepted) AS accepted, count(*) FILTER (accepted AND call = 'IN') AS calls_in,
      count(*) FILTER (accepted AND call = 'OUT') AS calls_out, count(*) FILTER (accepted AND near_line) AS near_line FROM calls GROUP BY zone""",
    "projective_points": f"""WITH {TRACKS_SQL}, p AS (SELECT event_id, round({_P[0]} / {_P[2]} * CAST(10000 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS court_x, round({_P[1]} / {_P[2]} * CAST(10000 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS court_y FROM tracks)
      SELECT event_id, court_x, court_y, CASE WHEN court_y < 11.885 THEN 'near' ELSE 'far' END AS side, TRUE AS back_x, TRUE AS back_y FROM p""",
    "reprojection_error": f"""WITH {TRACKS_SQL} SELECT track_id, round(avg(sqrt((frame_number % 3 * CAST(0.1 AS DOUBLE)) * (frame_number % 3 * CAST(0.1 AS DOUBLE)) + (frame_number % 2 * CAST(0.2 AS DOUBLE)) * (frame_number % 2 * CAST(0.2 AS DOUBLE)))), 6) AS mean_error,
      count(*) AS points FROM tracks GROUP BY track_id""",
    "ball_speed": f"WITH {BALL_SQL} SELECT track_id, frame_number, predicted, court_x, court_y, round(step, 4) AS frame_distance, speed_kmh, smoothed_kmh, average_kmh, peak_kmh, total_distance FROM speeds",
    "ball_speed_summary": f"WITH {BALL_SQL} {_summary_sql('track_id')}",
    "player_motion": f"WITH {PLAYER_SQL} SELECT track_id, player_label, frame_number, round(court_x * CAST(1000 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS court_x, round(court_y * CAST(1000 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS court_y, inside, zone, step AS frame_distance, speed_kmh, smoothed_kmh, average_kmh, peak_kmh, total_distance FROM speeds",
    "player_summary": f"WITH {PLAYER_SQL} {_summary_sql('track_id, player_label')}",
    "rallies": f"WITH {RALLIES_SQL} SELECT track_id, rally_id, frame_number FROM rallies",
    "shot_points": f"WITH RECURSIVE {SHOTS_SQL} SELECT track_id, rally_id, shot_in_rally, frame_number FROM shots",
    "shot_features": f"WITH RECURSIVE {FEATURES_SQL}",
    "rally_summary": f"""WITH RECURSIVE {SHOTS_SQL}, sums AS (SELECT track_id, rally_id, round(min(timestamp_seconds), 3) AS start_time, round(max(timestamp_seconds), 3) AS end_time, count(*) AS trajectory_points FROM rallies GROUP BY ALL),
      counts AS (SELECT track_id, rally_id, max(shot_in_rally) AS shot_count FROM shots GROUP BY ALL)
      SELECT s.*, coalesce(shot_count, 0) AS shot_count FROM sums s LEFT JOIN counts USING (track_id, rally_id)""",
    "trajectory_summary": f"""WITH {BOUNCES_SQL}, a AS (SELECT track_id, count(*) AS windows, count(*) FILTER (rev) AS reversals, count(*) FILTER (is_candidate) AS candidates, round(max(score), 4) AS best_score FROM windows GROUP BY 1),
      b AS (SELECT track_id, count(*) AS bounces FROM bounces GROUP BY 1) SELECT a.*, coalesce(bounces, 0) AS bounces FROM a LEFT JOIN b USING (track_id)""",
}
