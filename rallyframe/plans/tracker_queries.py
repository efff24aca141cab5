"""Queries over trackers, each with its SQL: the folds over frames are recursive there."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.operators import court, trackers
from rallyframe.operators import detections as D
from rallyframe.plans.detection_queries import _ZONES_SQL, BOXES_SQL, boxes
from rallyframe.plans.track_queries import AFFINE, _court_sql
from rallyframe.sources.tracks import TRACKS_SQL, event_tracks

c = F.col


def ball_frames(spark, sf_dir) -> DataFrame:
    """The frames of each video with their ball candidates. A fifth of the boxes is said to stand still."""
    frames = boxes(spark, sf_dir).select("video_id", "frame_number").distinct().withColumn("timestamp_seconds", c("frame_number") / 25.0)
    still = (c("frame_number") * 4 + c("candidate_id")) * 29 % 100 < 20
    found = D.ball_candidates(boxes(spark, sf_dir)).select("video_id", "frame_number", c("candidate_id").alias("id"), c("center_x").alias("x"), c("center_y").alias("y"), "confidence", c("ranking_score").alias("score"), still.alias("is_static"))
    return trackers.frames_with_candidates(frames, found)


def _people(spark, sf_dir) -> DataFrame:
    people = D.zone_rejections(boxes(spark, sf_dir)).where("player_zone IS NOT NULL")
    return people.select("video_id", "frame_number", "player_zone", (c("candidate_id") + c("frame_number") % 3).alias("id"), c("foot_x").alias("x"), c("foot_y").alias("y"), "confidence", c("area").alias("score"))


def people_frames(spark, sf_dir) -> DataFrame:
    frames = boxes(spark, sf_dir).select("video_id", "frame_number").distinct().withColumn("timestamp_seconds", c("frame_number") / 25.0)
    return trackers.frames_with_candidates(frames, _people(spark, sf_dir))


def zone_frames(spark, sf_dir) -> DataFrame:
    """people_frames() for each zone as a video of its own: number 2 * video_id for the far one, one more for the near one."""
    number = lambda zone: c("video_id") * 2 + (zone == "near").cast("int")
    frames = boxes(spark, sf_dir).select("video_id", "frame_number").distinct().withColumn("timestamp_seconds", c("frame_number") / 25.0)
    frames = frames.withColumn("zone", F.explode(F.array(F.lit("far"), F.lit("near")))).withColumn("video_id", number(c("zone")))
    return trackers.frames_with_candidates(frames, _people(spark, sf_dir).withColumn("video_id", number(c("player_zone"))))


def smoothed_ball(spark, sf_dir):
    return trackers.folded(ball_frames(spark, sf_dir), trackers.SmoothedBall, trackers.SmoothedBall.schema)


def kalman_ball(spark, sf_dir):
    return trackers.folded(ball_frames(spark, sf_dir), trackers.KalmanBall, trackers.KalmanBall.schema)


def segmented_ball(spark, sf_dir):
    return trackers.folded(ball_frames(spark, sf_dir), trackers.SegmentedBall, trackers.SegmentedBall.schema)


def stable_labels(spark, sf_dir):
    out = trackers.folded(people_frames(spark, sf_dir), trackers.StableLabels, trackers.StableLabels.schema)
    return out.select("video_id", "frame_number", F.explode("labels").alias("track", "player_label"))


def zone_players(spark, sf_dir):
    out = trackers.folded(zone_frames(spark, sf_dir), trackers.ZonePlayer, trackers.ZonePlayer.schema)
    return out.select(F.floor(c("video_id") / 2).alias("video_id"), F.when(c("video_id") % 2 == 0, "far").otherwise("near").alias("zone"), "frame_number", "id", "x", "y", "reason")


def court_players(spark, sf_dir):
    frames = boxes(spark, sf_dir).select("video_id", "frame_number").distinct().withColumn("timestamp_seconds", c("frame_number") / 25.0)
    people = court.mapped(_people(spark, sf_dir), AFFINE).withColumns({"x": c("court_x"), "y": c("court_y")})
    return trackers.folded(trackers.frames_with_candidates(frames, people), trackers.CourtPlayers, trackers.CourtPlayers.schema)


def walkers(spark, sf_dir) -> DataFrame:
    """Four persons to a frame, each near its own place, of any confidence; some are in nobody's sight."""
    b = boxes(spark, sf_dir).where("(frame_number * 7 + candidate_id * 3) % 11 > 1")
    x1, y1 = c("candidate_id") * 45 + F.floor(c("x1") % 40), c("candidate_id") % 2 * 100 + F.floor(c("y1") % 50)
    return b.select("video_id", "frame_number", c("candidate_id").alias("id"), "confidence", x1.cast("double").alias("x1"), y1.cast("double").alias("y1"), (x1 + 50 + c("frame_number") % 13).cast("double").alias("x2"), (y1 + 120 + c("frame_number") % 7).cast("double").alias("y2"))


def person_tracks(spark, sf_dir):
    return trackers.person_tracks(walkers(spark, sf_dir))


def associated_labels(spark, sf_dir):
    """Stable labels by the track ids that association gives."""
    people = walkers(spark, sf_dir).join(trackers.person_tracks(walkers(spark, sf_dir)), ["video_id", "frame_number", "id"])
    people = people.select("video_id", "frame_number", c("track_id").alias("id"), ((c("x1") + c("x2")) / 2).alias("x"), c("y2").alias("y"), "confidence", ((c("x2") - c("x1")) * (c("y2") - c("y1"))).alias("score"))
    frames = people.select("video_id", "frame_number").distinct().withColumn("timestamp_seconds", c("frame_number") / 25.0)
    out = trackers.folded(trackers.frames_with_candidates(frames, people), trackers.StableLabels, trackers.StableLabels.schema)
    return out.select("video_id", "frame_number", F.explode("labels").alias("track", "player_label"))


def track_summary(spark, sf_dir):
    return trackers.track_summary(smoothed_ball(spark, sf_dir))


def trajectory_segments(spark, sf_dir):
    out = segmented_ball(spark, sf_dir).where("status = 'DETECTED'")
    return out.groupBy("video_id").agg(F.count_distinct("segment_id").alias("segments"), F.count("*").alias("confirmed"))


def _located(spark, sf_dir) -> DataFrame:
    return court.mapped(event_tracks(spark, sf_dir), AFFINE).withColumn("confidence", c("event_id") % 10 / 10.0)


def windowed_player_speed(spark, sf_dir):
    return trackers.windowed_player_speed(_located(spark, sf_dir)).select("track_id", "frame_number", "speed_kmh")


def median_ball_speed(spark, sf_dir):
    return trackers.median_ball_speed(_located(spark, sf_dir).where("NOT predicted")).select("track_id", "frame_number", "speed_kmh")


QUERIES = {
    f.__name__: f
    for f in (smoothed_ball, kalman_ball, segmented_ball, stable_labels, zone_players, court_players, person_tracks, associated_labels, track_summary, trajectory_segments, windowed_player_speed, median_ball_speed)
}

_FRAMES_SQL = f"""{BOXES_SQL},
found AS (SELECT frame_number, list(struct_pack(x := center_x, y := center_y, confidence := confidence, score := ranking_score, still := (frame_number * 4 + candidate_id) * 29 % 100 < 20) ORDER BY ranking_score DESC, candidate_id) AS c FROM ranked GROUP BY 1),
frames AS (
  SELECT video_id, f.frame_number, f.frame_number / CAST(25 AS DOUBLE) AS t, row_number() OVER (PARTITION BY video_id ORDER BY f.frame_number) AS n, coalesce(c, []) AS c
  FROM (SELECT DISTINCT video_id, frame_number FROM boxes) f LEFT JOIN found USING (frame_number)
)"""

_D = "CAST(sqrt((o.x - px) * (o.x - px) + (o.y - py) * (o.y - py)) AS DOUBLE)"

SMOOTHED_SQL = f"""{_FRAMES_SQL},
ball AS (
  SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS frame_number, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS seen_at, CAST(0 AS DOUBLE) AS vx, CAST(0 AS DOUBLE) AS vy, 0 AS missed, '' AS source FROM frames
  UNION ALL
  SELECT video_id, n, frame_number,
    CASE WHEN one IS NOT NULL THEN nx WHEN missed + 1 > 8 THEN NULL ELSE px END, CASE WHEN one IS NOT NULL THEN ny WHEN missed + 1 > 8 THEN NULL ELSE py END,
    CASE WHEN one IS NOT NULL THEN t WHEN missed + 1 > 8 OR px IS NULL THEN NULL ELSE t END,
    CASE WHEN one IS NULL THEN CASE WHEN missed + 1 > 8 THEN 0 ELSE vx END WHEN x IS NULL THEN 0 WHEN t - seen_at >= 0.001 THEN CAST(0.55 AS DOUBLE) * (nx - x) / (t - seen_at) + (1 - CAST(0.55 AS DOUBLE)) * vx ELSE vx END,
    CASE WHEN one IS NULL THEN CASE WHEN missed + 1 > 8 THEN 0 ELSE vy END WHEN x IS NULL THEN 0 WHEN t - seen_at >= 0.001 THEN CAST(0.55 AS DOUBLE) * (ny - y) / (t - seen_at) + (1 - CAST(0.55 AS DOUBLE)) * vy ELSE vy END,
    CASE WHEN one IS NOT NULL THEN 0 ELSE missed + 1 END, CASE WHEN one IS NOT NULL THEN 'detected' WHEN missed + 1 > 8 OR px IS NULL THEN 'lost' ELSE 'predicted' END
  FROM (
    SELECT *, CASE WHEN x IS NULL THEN one.x ELSE CAST(0.65 AS DOUBLE) * one.x + (1 - CAST(0.65 AS DOUBLE)) * x END AS nx, CASE WHEN x IS NULL THEN one.y ELSE CAST(0.65 AS DOUBLE) * one.y + (1 - CAST(0.65 AS DOUBLE)) * y END AS ny
    FROM (
      SELECT *, CASE WHEN px IS NULL THEN c[1] ELSE c[-list_max(list_filter(list_transform(c, lambda o, i: CASE WHEN {_D} <= 180 THEN
        struct_pack(s := round(CAST(0.55 AS DOUBLE) * o.score + CAST(0.45 AS DOUBLE) * greatest(CAST(0 AS DOUBLE), 1 - {_D} / 180), 4), k := -i) END), lambda v: v IS NOT NULL)).k] END AS one
      FROM (
        SELECT b.* EXCLUDE (n, frame_number, source), f.n, f.frame_number, f.t, f.c, CASE WHEN seen_at IS NULL OR f.t - seen_at <= 0 THEN x ELSE x + vx * (f.t - seen_at) END AS px, CASE WHEN seen_at IS NULL OR f.t - seen_at <= 0 THEN y ELSE y + vy * (f.t - seen_at) END AS py
        FROM ball b JOIN frames f ON f.video_id = b.video_id AND f.n = b.n + 1
      )
    )
  )
),
tracked AS (
  SELECT video_id, frame_number, round(x * 1000) / CAST(1000 AS DOUBLE) AS x, round(y * 1000) / CAST(1000 AS DOUBLE) AS y, round(vx * 1000) / CAST(1000 AS DOUBLE) AS vx, round(vy * 1000) / CAST(1000 AS DOUBLE) AS vy, source, missed FROM ball WHERE n > 0
)"""

KALMAN_SQL = f"""{_FRAMES_SQL},
ball AS (
  SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS frame_number, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS vx, CAST(0 AS DOUBLE) AS vy,
    CAST(0 AS DOUBLE) AS ka, CAST(0 AS DOUBLE) AS kb, CAST(0 AS DOUBLE) AS kc, CAST(NULL AS DOUBLE) AS seen_at, 0 AS missed, '' AS source FROM frames
  UNION ALL
  SELECT video_id, n, frame_number, CASE WHEN one IS NULL THEN CASE WHEN px IS NULL OR missed + 1 >= 10 THEN NULL ELSE px END WHEN px IS NULL THEN one.x ELSE px + pa / (pa + 25) * (one.x - px) END,
    CASE WHEN one IS NULL THEN CASE WHEN px IS NULL OR missed + 1 >= 10 THEN NULL ELSE py END WHEN px IS NULL THEN one.y ELSE py + pa / (pa + 25) * (one.y - py) END,
    CASE WHEN px IS NULL OR (one IS NULL AND missed + 1 >= 10) THEN 0 WHEN one IS NULL THEN vx ELSE vx + pb / (pa + 25) * (one.x - px) END,
    CASE WHEN px IS NULL OR (one IS NULL AND missed + 1 >= 10) THEN 0 WHEN one IS NULL THEN vy ELSE vy + pb / (pa + 25) * (one.y - py) END,
    CASE WHEN one IS NULL THEN pa WHEN px IS NULL THEN 1000 ELSE pa - pa * pa / (pa + 25) END, CASE WHEN one IS NULL THEN pb WHEN px IS NULL THEN 0 ELSE pb - pa * pb / (pa + 25) END,
    CASE WHEN one IS NULL THEN pc WHEN px IS NULL THEN 1000 ELSE pc - pb * pb / (pa + 25) END,
    t, CASE WHEN one IS NULL THEN missed + 1 ELSE 0 END, CASE WHEN one IS NOT NULL THEN 'detected' WHEN px IS NULL OR missed + 1 >= 10 THEN 'lost' ELSE 'predicted' END
  FROM (
    SELECT *, c[-list_max(list_filter(list_transform(c, lambda o, i: CASE WHEN px IS NULL THEN struct_pack(s := o.confidence, k := -i) WHEN {_D} < 150 THEN
      struct_pack(s := o.confidence * (1 - CAST(0.3 AS DOUBLE) * least(CAST(1 AS DOUBLE), {_D} / 150)), k := -i) END), lambda v: v IS NOT NULL)).k] AS one
    FROM (
      SELECT b.* EXCLUDE (n, frame_number, source), f.n, f.frame_number, f.t, f.c, x + vx * (f.t - seen_at) AS px, y + vy * (f.t - seen_at) AS py,
        ka + 2 * (f.t - seen_at) * kb + (f.t - seen_at) * (f.t - seen_at) * kc + 10 AS pa, kb + (f.t - seen_at) * kc AS pb, kc + 100 AS pc
      FROM ball b JOIN frames f ON f.video_id = b.video_id AND f.n = b.n + 1
    )
  )
)"""

_FIXED = lambda v: f"CASE WHEN {v} < 0 THEN -1 ELSE 1 END * floor(abs({v}) * 1000 + CAST(0.5 AS DOUBLE)) / CAST(1000 AS DOUBLE)"

#: The fold of segmented_ball over any `frames` (video_id, frame_number, t, n, c).
SEGMENTS_FOLD_SQL = f"""ball AS (
  SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS frame_number, CAST(NULL AS DOUBLE) AS kx, CAST(NULL AS DOUBLE) AS ky, CAST(0 AS DOUBLE) AS vx, CAST(0 AS DOUBLE) AS vy,
    CAST(0 AS DOUBLE) AS ka, CAST(0 AS DOUBLE) AS kb, CAST(0 AS DOUBLE) AS kc, CAST(NULL AS DOUBLE) AS seen_at, CAST(NULL AS DOUBLE) AS lx, CAST(NULL AS DOUBLE) AS ly, CAST(NULL AS DOUBLE) AS lt, CAST(NULL AS DOUBLE) AS lv,
    0 AS misses, 0 AS segment, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS DOUBLE) AS confidence, '' AS status FROM frames
  UNION ALL
  SELECT video_id, n, frame_number, CASE WHEN hit THEN nx WHEN gone THEN NULL ELSE px END, CASE WHEN hit THEN ny WHEN gone THEN NULL ELSE py END,
    CASE WHEN hit THEN nvx WHEN gone THEN 0 ELSE vx END, CASE WHEN hit THEN nvy WHEN gone THEN 0 ELSE vy END,
    CASE WHEN NOT hit THEN pa WHEN fresh THEN 1000 ELSE pa - pa * pa / (pa + 25) END, CASE WHEN NOT hit THEN pb WHEN fresh THEN 0 ELSE pb - pa * pb / (pa + 25) END, CASE WHEN NOT hit THEN pc WHEN fresh THEN 1000 ELSE pc - pb * pb / (pa + 25) END,
    t, CASE WHEN hit THEN one.x ELSE lx END, CASE WHEN hit THEN one.y ELSE ly END, CASE WHEN hit THEN t ELSE lt END, CASE WHEN hit THEN sqrt(nvx * nvx + nvy * nvy) ELSE lv END,
    CASE WHEN hit THEN 0 ELSE misses + 1 END, segment + CASE WHEN hit AND misses > 0 AND NOT reachable THEN 1 WHEN NOT hit AND gone THEN 1 ELSE 0 END,
    CASE WHEN hit THEN one.x WHEN shown THEN {_FIXED("px")} END, CASE WHEN hit THEN one.y WHEN shown THEN {_FIXED("py")} END, CASE WHEN hit THEN one.confidence WHEN shown THEN 0 END,
    CASE WHEN hit THEN 'DETECTED' WHEN shown THEN 'PREDICTED_' || (misses + 1) ELSE 'LOST' END
  FROM (
    SELECT *, CASE WHEN fresh THEN one.x ELSE px + pa / (pa + 25) * (one.x - px) END AS nx, CASE WHEN fresh THEN one.y ELSE py + pa / (pa + 25) * (one.y - py) END AS ny,
      CASE WHEN fresh THEN 0 ELSE vx + pb / (pa + 25) * (one.x - px) END AS nvx, CASE WHEN fresh THEN 0 ELSE vy + pb / (pa + 25) * (one.y - py) END AS nvy,
      NOT hit AND px IS NOT NULL AND misses + 1 <= 3 AS shown, NOT hit AND misses + 1 > 10 AND NOT (px IS NOT NULL AND misses + 1 <= 3) AS gone
    FROM (
      SELECT *, px IS NULL OR (misses > 0 AND NOT reachable) AS fresh FROM (
        SELECT *, coalesce(best.s >= CAST(0.3 AS DOUBLE), FALSE) AS hit,
          coalesce(t - lt <= CAST(0.5 AS DOUBLE) AND NOT (sqrt((one.x - lx) * (one.x - lx) + (one.y - ly) * (one.y - ly)) > 3 * lv * (t - lt) AND sqrt((one.x - lx) * (one.x - lx) + (one.y - ly) * (one.y - ly)) > 200), FALSE) AS reachable
        FROM (
          SELECT *, c[-best.k] AS one FROM (
            SELECT *, list_max(list_transform(c, lambda o, i: struct_pack(s := CAST(0.25 AS DOUBLE) * o.confidence + CAST(0.25 AS DOUBLE) * o.score
              + CASE WHEN px IS NULL THEN CAST(0.15 AS DOUBLE) WHEN {_D} < 80 THEN CAST(0.35 AS DOUBLE) * (1 - {_D} / 80) ELSE CAST(-0.3 AS DOUBLE) END + CASE WHEN o.still THEN CAST(-0.4 AS DOUBLE) ELSE CAST(0.15 AS DOUBLE) END, k := -i))) AS best
            FROM (
              SELECT b.* EXCLUDE (n, frame_number, x, y, confidence, status), f.n, f.frame_number, f.t, f.c, kx + vx * (f.t - seen_at) AS px, ky + vy * (f.t - seen_at) AS py,
                ka + 2 * (f.t - seen_at) * kb + (f.t - seen_at) * (f.t - seen_at) * kc + 10 AS pa, kb + (f.t - seen_at) * kc AS pb, kc + 100 AS pc
              FROM ball b JOIN frames f ON f.video_id = b.video_id AND f.n = b.n + 1
            )
          )
        )
      )
    )
  )
),
segmented AS (SELECT video_id, frame_number, x, y, confidence, status, segment AS segment_id FROM ball WHERE n > 0)"""

SEGMENTS_SQL = f"{_FRAMES_SQL},\n{SEGMENTS_FOLD_SQL}"

_PEOPLE_SQL = f"""{_ZONES_SQL},
people AS (SELECT video_id, frame_number, zone, candidate_id + frame_number % 3 AS id, foot_x AS x, foot_y AS y, confidence, area AS score FROM zoned WHERE rejection_reason IS NULL),
numbered AS (SELECT video_id, frame_number, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) AS n FROM (SELECT DISTINCT video_id, frame_number FROM boxes))"""

#: The fold of stable_labels over any `people` (video_id, frame_number, id, y, score).
LABELS_FOLD_SQL = """turns AS (
  SELECT video_id, frame_number, CAST(id AS VARCHAR) AS track, row_number() OVER (PARTITION BY video_id, frame_number ORDER BY y, score DESC, id) AS place, row_number() OVER (PARTITION BY video_id ORDER BY frame_number, y, score DESC, id) AS n FROM people
),
named AS (
  SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS frame_number, '' AS track, '' AS player_label, CAST([] AS VARCHAR[]) AS used, CAST([] AS STRUCT(k VARCHAR, v VARCHAR)[]) AS known FROM turns
  UNION ALL
  SELECT video_id, n, frame_number, track, label, list_append(used, label), list_append(list_filter(known, lambda e: e.k <> track), struct_pack(k := track, v := label))
  FROM (
    SELECT *, CASE WHEN old IS NULL THEN CASE WHEN place = 1 THEN 'Player A' WHEN NOT list_contains(used, 'Player B') THEN 'Player B' WHEN NOT list_contains(used, 'Player A') THEN 'Player A' ELSE 'Track ' || track END
      WHEN list_contains(used, old) AND old IN ('Player A', 'Player B') THEN CASE WHEN NOT list_contains(used, 'Player A') THEN 'Player A' WHEN NOT list_contains(used, 'Player B') THEN 'Player B' ELSE 'Track ' || track END ELSE old END AS label
    FROM (
      SELECT t.video_id, t.n, t.frame_number, t.track, t.place, s.known, CASE WHEN t.place = 1 THEN [] ELSE s.used END AS used, list_filter(s.known, lambda e: e.k = t.track)[1].v AS old
      FROM named s JOIN turns t ON t.video_id = s.video_id AND t.n = s.n + 1
    )
  )
)"""

LABELS_SQL = f"{_PEOPLE_SQL},\n{LABELS_FOLD_SQL}"

ZONES_FOLD_SQL = f"""{_PEOPLE_SQL},
lists AS (SELECT video_id, frame_number, zone, list(struct_pack(id := id, x := x, y := y, confidence := confidence, score := score) ORDER BY score DESC, id) AS c FROM people GROUP BY ALL),
frames AS (SELECT n.video_id, z.zone, n.n, n.frame_number, coalesce(c, []) AS c FROM numbered n CROSS JOIN (VALUES ('far'), ('near')) z(zone) LEFT JOIN lists l ON l.frame_number = n.frame_number AND l.video_id = n.video_id AND l.zone = z.zone),
fold AS (
  SELECT DISTINCT video_id, zone, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS frame_number, CAST(NULL AS DOUBLE) AS ax, CAST(NULL AS DOUBLE) AS ay, 0 AS missed, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS y, CAST(NULL AS VARCHAR) AS reason FROM frames
  UNION ALL
  SELECT video_id, zone, n, frame_number, CASE WHEN one IS NOT NULL THEN one.x WHEN missed + 1 > 30 THEN NULL ELSE px END, CASE WHEN one IS NOT NULL THEN one.y WHEN missed + 1 > 30 THEN NULL ELSE py END,
    CASE WHEN one IS NOT NULL THEN 0 ELSE missed + 1 END, one.id, one.x, one.y, CASE WHEN len(c) = 1 THEN 'only_candidate' WHEN len(c) > 1 THEN 'best_scored' END
  FROM (
    SELECT *, c[-list_max(list_transform(c, lambda o, i: struct_pack(s := CAST(0.3 AS DOUBLE) * o.confidence + CAST(0.001 AS DOUBLE) * sqrt(o.score)
      + CASE WHEN px IS NOT NULL AND {_D} < 200 THEN CAST(0.7 AS DOUBLE) * (1 - {_D} / 200) ELSE 0 END, k := -i))).k] AS one
    FROM (SELECT f.video_id, f.zone, f.n, f.frame_number, f.c, s.ax AS px, s.ay AS py, s.missed FROM fold s JOIN frames f ON f.video_id = s.video_id AND f.zone = s.zone AND f.n = s.n + 1)
  )
)"""

PAIRS_SQL = f"""{_PEOPLE_SQL},
{_court_sql("people", "located")},
lists AS (SELECT video_id, frame_number, list(struct_pack(id := id, y := court_y, confidence := confidence, score := score) ORDER BY score DESC, id) AS c FROM located GROUP BY ALL),
frames AS (SELECT n.video_id, n.n, n.frame_number, coalesce(c, []) AS c FROM numbered n LEFT JOIN lists USING (video_id, frame_number)),
fold AS (
  SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS frame_number, CAST([] AS BIGINT[]) AS a_ids, CAST([] AS BIGINT[]) AS b_ids, CAST(NULL AS BIGINT) AS player_a, CAST(NULL AS BIGINT) AS player_b FROM frames
  UNION ALL
  SELECT video_id, n, frame_number, CASE WHEN a IS NULL THEN a_ids ELSE list_distinct(list_append(a_ids, a)) END, CASE WHEN b IS NULL THEN b_ids ELSE list_distinct(list_append(b_ids, b)) END, a, b
  FROM (
    SELECT *, CASE WHEN len(c) = 1 THEN CASE WHEN single_a THEN c[1].id END WHEN len(c) > 1 THEN CASE WHEN p.y >= q.y THEN p.id ELSE q.id END END AS a,
      CASE WHEN len(c) = 1 THEN CASE WHEN NOT single_a THEN c[1].id END WHEN len(c) > 1 THEN CASE WHEN p.y >= q.y THEN q.id ELSE p.id END END AS b
    FROM (
      SELECT *, list_contains(a_ids, c[1].id) OR (NOT list_contains(b_ids, c[1].id) AND c[1].y >= CAST(11.885 AS DOUBLE)) AS single_a, c[CASE WHEN len(c) = 2 THEN 1 ELSE -r[1].k END] AS p, c[CASE WHEN len(c) = 2 THEN 2 ELSE -r[2].k END] AS q
      FROM (
        SELECT f.video_id, f.n, f.frame_number, f.c, s.a_ids, s.b_ids, list_reverse_sort(list_transform(f.c, lambda o, i: struct_pack(s := CAST(0.4 AS DOUBLE) * o.confidence + CAST(0.001 AS DOUBLE) * sqrt(o.score)
          + CASE WHEN list_contains(s.a_ids, o.id) OR list_contains(s.b_ids, o.id) THEN CAST(0.5 AS DOUBLE) ELSE 0 END, k := -i))) AS r
        FROM fold s JOIN frames f ON f.video_id = s.video_id AND f.n = s.n + 1
      )
    )
  )
)"""

_BOX = "struct_pack(id := t.id, x1 := t.x1 + t.vx * (f - t.seen), y1 := t.y1 + t.vy * (f - t.seen), x2 := t.x2 + t.vx * (f - t.seen), y2 := t.y2 + t.vy * (f - t.seen), seen := t.seen)"
_SIDE = lambda k: f"least(t.{k}2, d.{k}2) - greatest(t.{k}1, d.{k}1)"
_BOTH = f"(({_SIDE('x')}) * ({_SIDE('y')}))"
_OVERLAP = f"CASE WHEN {_SIDE('x')} <= 0 OR {_SIDE('y')} <= 0 THEN 0 ELSE floor({_BOTH} / ((t.x2 - t.x1) * (t.y2 - t.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) - {_BOTH}) * CAST(1e6 AS DOUBLE) + CAST(0.5 AS DOUBLE)) END"


def _matched(tracks: str, dets: str, least: int) -> str:
    """Pairs (ts, ds) taken greedily, most overlap first."""
    pairs = f"flatten(list_transform({tracks}, lambda t: list_transform({dets}, lambda d: struct_pack(s := -({_OVERLAP}), ts := [t.id], ds := [d.k]))))"
    return f"""list_reduce([struct_pack(s := CAST(0 AS DOUBLE), ts := CAST([] AS BIGINT[]), ds := CAST([] AS BIGINT[]))] || list_sort(list_filter({pairs}, lambda p: p.s <= -{least})),
      lambda acc, p: CASE WHEN list_contains(acc.ts, p.ts[1]) OR list_contains(acc.ds, p.ds[1]) THEN acc ELSE struct_pack(s := acc.s, ts := acc.ts || p.ts, ds := acc.ds || p.ds) END)"""


_NOW = "struct_pack(id := i, x1 := b.x1, y1 := b.y1, x2 := b.x2, y2 := b.y2, vx := coalesce(((b.x1 + b.x2) / 2 - (o.x1 + o.x2) / 2) / (f - o.seen), 0), vy := coalesce(((b.y1 + b.y2) / 2 - (o.y1 + o.y2) / 2) / (f - o.seen), 0), seen := f)"

ASSOCIATION_SQL = f"""{BOXES_SQL},
walked AS (
  SELECT video_id, frame_number, candidate_id AS id, confidence, CAST(candidate_id * 45 + floor(x1 % 40) AS DOUBLE) AS x1, CAST(candidate_id % 2 * 100 + floor(y1 % 50) AS DOUBLE) AS y1 FROM boxes WHERE (frame_number * 7 + candidate_id * 3) % 11 > 1
),
walkers AS (SELECT *, x1 + 50 + frame_number % 13 AS x2, y1 + 120 + frame_number % 7 AS y2 FROM walked),
seen AS (
  SELECT video_id, frame_number, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) AS n, list(struct_pack(k := k, id := id, confidence := confidence, x1 := x1, y1 := y1, x2 := x2, y2 := y2) ORDER BY k) AS c
  FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame_number ORDER BY confidence DESC, id) AS k FROM walkers) GROUP BY video_id, frame_number
),
fold AS (
  SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS f, CAST(0 AS BIGINT) AS born, CAST([] AS STRUCT(id BIGINT, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, vx DOUBLE, vy DOUBLE, seen BIGINT)[]) AS tracks, CAST([] AS STRUCT(d BIGINT, i BIGINT)[]) AS given FROM seen
  UNION ALL
  SELECT video_id, n, f, born + len(fresh),
    list_sort(list_filter(tracks, lambda t: NOT list_contains(list_transform(given, lambda g: g.i), t.id)) || list_transform(given, lambda g: list_transform([struct_pack(i := g.i, b := list_filter(c, lambda d: d.k = g.d)[1], o := list_filter(tracks, lambda t: t.id = g.i)[1])], lambda z: {_NOW.replace('b.', 'z.b.').replace('o.', 'z.o.').replace(':= i,', ':= z.i,')})[1])), given
  FROM (
    SELECT *, list_transform(range(1, len(m1.ds) + 1), lambda j: struct_pack(d := m1.ds[j], i := m1.ts[j])) || list_transform(range(1, len(m2.ds) + 1), lambda j: struct_pack(d := m2.ds[j], i := m2.ts[j]))
      || list_transform(fresh, lambda d, j: struct_pack(d := d.k, i := born + j)) AS given
    FROM (
      SELECT *, list_filter(high, lambda d: NOT list_contains(m1.ds, d.k)) AS fresh, {_matched("list_filter(moved, lambda t: f - t.seen = 1 AND NOT list_contains(m1.ts, t.id))", "low", 500000)} AS m2
      FROM (
        SELECT *, {_matched("moved", "high", 200000)} AS m1
        FROM (
          SELECT *, list_transform(tracks, lambda t: {_BOX}) AS moved, list_filter(c, lambda d: d.confidence >= CAST(0.25 AS DOUBLE)) AS high, list_filter(c, lambda d: d.confidence >= CAST(0.1 AS DOUBLE) AND d.confidence < CAST(0.25 AS DOUBLE)) AS low
          FROM (SELECT s.video_id, s.n, s.frame_number AS f, s.c, g.born, list_filter(g.tracks, lambda t: s.frame_number - t.seen <= 30) AS tracks FROM fold g JOIN seen s ON s.video_id = g.video_id AND s.n = g.n + 1)
        )
      )
    )
  )
),
associated AS (
  SELECT g.video_id, g.f AS frame_number, list_filter(s.c, lambda d: d.k = g.one.d)[1].id AS id, g.one.i AS track_id
  FROM (SELECT video_id, n, f, unnest(given) AS one FROM fold) g JOIN seen s ON s.video_id = g.video_id AND s.n = g.n
)"""

_STEPS = "sqrt((court_x - lag(court_x) OVER w) * (court_x - lag(court_x) OVER w) + (court_y - lag(court_y) OVER w) * (court_y - lag(court_y) OVER w))"

ORACLE = {
    "person_tracks": f"WITH RECURSIVE {ASSOCIATION_SQL} SELECT * FROM associated",
    "associated_labels": f"""WITH RECURSIVE {ASSOCIATION_SQL}, people AS (SELECT video_id, frame_number, track_id AS id, y2 AS y, (x2 - x1) * (y2 - y1) AS score FROM associated JOIN walkers USING (video_id, frame_number, id)),
      {LABELS_FOLD_SQL} SELECT video_id, frame_number, track, player_label FROM named WHERE n > 0""",
    "segmented_ball": f"WITH RECURSIVE {SEGMENTS_SQL} SELECT * FROM segmented",
    "trajectory_segments": f"WITH RECURSIVE {SEGMENTS_SQL} SELECT video_id, count(DISTINCT segment_id) AS segments, count(*) AS confirmed FROM segmented WHERE status = 'DETECTED' GROUP BY 1",
    "stable_labels": f"WITH RECURSIVE {LABELS_SQL} SELECT video_id, frame_number, track, player_label FROM named WHERE n > 0",
    "zone_players": f"WITH RECURSIVE {ZONES_FOLD_SQL} SELECT video_id, zone, frame_number, id, x, y, reason FROM fold WHERE n > 0",
    "court_players": f"WITH RECURSIVE {PAIRS_SQL} SELECT video_id, frame_number, player_a, player_b FROM fold WHERE n > 0",
    "kalman_ball": f"""WITH RECURSIVE {KALMAN_SQL} SELECT video_id, frame_number, round(x * 1000) / CAST(1000 AS DOUBLE) AS x, round(y * 1000) / CAST(1000 AS DOUBLE) AS y,
      round(vx * 1000) / CAST(1000 AS DOUBLE) AS vx, round(vy * 1000) / CAST(1000 AS DOUBLE) AS vy, source, missed FROM ball WHERE n > 0""",
    "smoothed_ball": f"WITH RECURSIVE {SMOOTHED_SQL} SELECT * FROM tracked",
    "track_summary": f"""WITH RECURSIVE {SMOOTHED_SQL} SELECT video_id, count(*) FILTER (source = 'detected') AS detected, count(*) FILTER (source = 'predicted') AS predicted, count(*) FILTER (source = 'lost') AS lost,
      max_by(vx, frame_number) AS last_vx, max_by(vy, frame_number) AS last_vy, max_by(missed, frame_number) AS last_missed FROM tracked GROUP BY 1""",
    "windowed_player_speed": f"""WITH {TRACKS_SQL}, {_court_sql("tracks", "located")},
      s AS (SELECT *, timestamp_seconds - lag(timestamp_seconds) OVER w AS dt, {_STEPS} AS d, row_number() OVER w AS place FROM located WINDOW w AS (PARTITION BY track_id ORDER BY timestamp_seconds, frame_number)),
      k AS (SELECT *, sum(CASE WHEN dt > 0 AND d < 5 THEN d END) OVER r / sum(CASE WHEN dt > 0 AND d < 5 THEN dt END) OVER r * CAST(3.6 AS DOUBLE) AS kmh FROM s WINDOW r AS (PARTITION BY track_id ORDER BY timestamp_seconds, frame_number ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))
      SELECT track_id, frame_number, CASE WHEN place >= 5 AND kmh < 40 THEN round(kmh, 3) END AS speed_kmh FROM k""",
    "median_ball_speed": f"""WITH {TRACKS_SQL}, {_court_sql("tracks", "located")},
      s AS (SELECT *, timestamp_seconds - lag(timestamp_seconds) OVER w AS dt, {_STEPS} AS d, least(event_id % 10, lag(event_id % 10) OVER w) AS conf FROM located WHERE NOT predicted WINDOW w AS (PARTITION BY track_id ORDER BY timestamp_seconds, frame_number)),
      v AS (SELECT *, CASE WHEN dt > 0 AND d < 15 AND d / dt * CAST(3.6 AS DOUBLE) > 10 AND d / dt * CAST(3.6 AS DOUBLE) < 300 AND conf > 2 THEN d / dt * CAST(3.6 AS DOUBLE) END AS sample FROM s),
      m AS (SELECT *, count(sample) OVER r AS n, median(sample) OVER r AS mid FROM v WINDOW r AS (PARTITION BY track_id ORDER BY timestamp_seconds, frame_number ROWS BETWEEN 13 PRECEDING AND CURRENT ROW))
      SELECT track_id, frame_number, CASE WHEN n >= 2 THEN round(mid, 3) END AS speed_kmh FROM m""",
}
