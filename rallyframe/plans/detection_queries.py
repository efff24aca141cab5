"""Queries over detections, frames, lines, scores and annotations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rallyframe.operators import detections as D
from rallyframe.operators import metrics, overlay, scoring, shots
from rallyframe.plans.track_queries import AFFINE
from rallyframe.sources.tracks import TRACKS_SQL, event_tracks, table

c = F.col


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four boxes to a frame of 1280 by 720, from consecutive events; a hundred frames to a video."""
    e = table(spark, sf_dir, "events").select("event_id", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    frame = F.floor(c("event_id") / 4)
    x1, y1 = c("value") * 5, c("k") * 7
    return e.select(
        F.floor(frame / 100).alias("video_id"), frame.alias("frame_number"), (c("event_id") % 4).alias("candidate_id"), x1.alias("x1"), y1.alias("y1"),
        (x1 + 1 + c("event_id") % 61).alias("x2"), (y1 + 1 + c("event_id") % 83).alias("y2"), (c("event_id") * 37 % 100 / 100.0).alias("confidence"),
        (c("event_id") * 53 % 100 / 100.0).alias("color_score"), F.lit(1280.0).alias("frame_width"), F.lit(720.0).alias("frame_height"),
    )


BOXES_SQL = """boxes AS (
  SELECT event_id // 4 // 100 AS video_id, event_id // 4 AS frame_number, event_id % 4 AS candidate_id, value * 5 AS x1, k * 7 AS y1, value * 5 + 1 + event_id % 61 AS x2, k * 7 + 1 + event_id % 83 AS y2,
    (event_id * 37 % 100) / CAST(100 AS DOUBLE) AS confidence, (event_id * 53 % 100) / CAST(100 AS DOUBLE) AS color_score, CAST(1280 AS DOUBLE) AS frame_width, CAST(720 AS DOUBLE) AS frame_height
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
),
geo AS (
  SELECT *, greatest(CAST(0 AS DOUBLE), x2 - x1) AS box_width, greatest(CAST(0 AS DOUBLE), y2 - y1) AS box_height, (x1 + x2) / 2 AS center_x, (y1 + y2) / 2 AS center_y, (x1 + x2) / 2 AS foot_x, y2 AS foot_y FROM boxes
),
shaped AS (SELECT *, box_width * box_height AS area, round(coalesce(box_width / nullif(box_height, 0), 0) * CAST(10000 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS aspect_ratio, round(box_width * box_height / (frame_width * frame_height) * CAST(1e8 AS DOUBLE)) / CAST(1e8 AS DOUBLE) AS area_ratio FROM geo),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY video_id, frame_number ORDER BY ranking_score DESC, candidate_id) AS rank
  FROM (SELECT *, round(confidence * CAST(0.75 AS DOUBLE) + color_score * CAST(0.25 AS DOUBLE), 4) AS ranking_score FROM shaped WHERE area >= 2 AND area_ratio <= 0.01 AND aspect_ratio BETWEEN 0.35 AND 2.8)
)"""


def candidate_ranking(spark, sf_dir):
    return D.ball_candidates(boxes(spark, sf_dir)).select("frame_number", "candidate_id", "aspect_ratio", "area_ratio", "ranking_score", "rank")


def predictions(spark, sf_dir) -> DataFrame:
    b = boxes(spark, sf_dir).where("candidate_id = 0 AND frame_number % 3 <> 0")
    return b.select("video_id", "frame_number", (c("x1") + 20).alias("predicted_x"), (c("y1") + 10).alias("predicted_y"))


def temporal_candidates(spark, sf_dir):
    out = D.temporal_candidates(D.ball_candidates(boxes(spark, sf_dir)), predictions(spark, sf_dir))
    return out.select("frame_number", "candidate_id", "prediction_distance", "temporal_score")


def fallback_candidates(spark, sf_dir):
    found = D.ball_candidates(boxes(spark, sf_dir)).select("video_id", "frame_number", "candidate_id", "confidence")
    fallback = boxes(spark, sf_dir).where("candidate_id = 1").select("video_id", "frame_number", "candidate_id", "confidence")
    return D.with_fallback(found, fallback)


def select_players(spark, sf_dir):
    return D.select_players(D.court_people(boxes(spark, sf_dir))).select("frame_number", "candidate_id", "selection_score", "player_label", "court_side")


def court_rejections(spark, sf_dir):
    return D.court_rejections(boxes(spark, sf_dir), AFFINE).select("frame_number", "candidate_id", "court_x", "court_y", "rejection_reason")


def zone_rejections(spark, sf_dir):
    return D.zone_rejections(boxes(spark, sf_dir)).select("frame_number", "candidate_id", "player_zone", "rejection_reason")


def rejection_histogram(spark, sf_dir):
    return D.reason_histogram(D.zone_rejections(boxes(spark, sf_dir)))


def _frames(spark, sf_dir) -> DataFrame:
    return boxes(spark, sf_dir).select("video_id", "frame_number").distinct()


def detection_quality(spark, sf_dir):
    return D.detection_quality(D.presence(D.marked(boxes(spark, sf_dir).repartition(*D.FRAME))), "video_id")


def segments(spark, sf_dir) -> DataFrame:
    b = boxes(spark, sf_dir)
    return b.select("video_id", (c("frame_number") * 4 + c("candidate_id")).alias("line_id"), "x1", "y1", (c("x1") + c("candidate_id") * 90 + 3).alias("x2"), (c("y1") + c("frame_number") % 5 * 60).alias("y2"), "frame_width", "frame_height")


def court_lines(spark, sf_dir):
    return D.court_lines(D.lines(segments(spark, sf_dir))).select("video_id", "line_id", "orientation", "length_pixels", "place", "is_court")


def line_summary(spark, sf_dir):
    return D.line_summary(D.lines(segments(spark, sf_dir)), "video_id")


def frame_stride(spark, sf_dir):
    out = D.every_nth(_frames(spark, sf_dir), 3, 10)
    return out.select("video_id", "frame_number", D.timestamp_text(c("frame_number") / 25.0).alias("at"))


def letterbox(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (c("o_orderkey") % 1900 + 1).cast("double").alias("frame_width"), (c("o_custkey") % 1000 + 1).cast("double").alias("frame_height"))
    return D.letterbox(o).drop("frame_width", "frame_height")


def quality_flags(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (c("event_id") * 7 % 256).cast("double").alias("brightness"), (c("event_id") * 11 % 200).cast("double").alias("sharpness"))
    return D.quality_flags(e).select("event_id", "is_dark", "is_overexposed", "is_blurry", F.array_join("issues", ",").alias("issues"), "acceptable")


def frame_documents(spark, sf_dir):
    docs = D.frame_documents(D.marked(boxes(spark, sf_dir).repartition(*D.FRAME)))
    return docs.select("frame_number", F.size("players").cast("long").alias("players"), F.array_join(F.transform("players", lambda p: p["label"]), ",").alias("labels"), F.round("ball.x", 3).alias("ball_x"), F.round("ball.y", 3).alias("ball_y"))


def _overlay(spark, sf_dir) -> DataFrame:
    return D.overlay_plan(D.marked(boxes(spark, sf_dir).repartition("video_id")))


def overlay_plan(spark, sf_dir):
    return _overlay(spark, sf_dir).groupBy("frame_number", "primitive").agg(F.count("*").alias("drawn"))


def visible(spark, sf_dir) -> DataFrame:
    return event_tracks(spark, sf_dir).withColumn("visible", ~c("predicted"))


def clip_windows(spark, sf_dir):
    return shots.clip_windows(shots.visible_runs(visible(spark, sf_dir), 8), fps=4.0)


def clip_frames(spark, sf_dir):
    clips = shots.clip_windows(shots.visible_runs(visible(spark, sf_dir), 8), fps=4.0)
    return shots.clip_frames(visible(spark, sf_dir).select("track_id", "frame_number", "event_id"), clips).select("track_id", "clip_id", "frame_number", "event_id")


def points(spark, sf_dir, match: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", c("user_id").alias("track_id"), F.get_json_object("props", "$.k").cast("double").alias("k"))
    number = F.row_number().over(Window.partitionBy("match_id").orderBy("ts", "event_id")).cast("long")
    return e.withColumn("match_id", F.expr(match)).select("match_id", number.alias("point_number"), F.when(c("k") < 50, "A").otherwise("B").alias("winner"))


_BOARD = ("match_id", "point_number", "winner", "rejected", "in_tiebreak", *scoring.COUNTS, "match_winner")


def scoreboard(spark, sf_dir):
    return scoring.scoreboard(points(spark, sf_dir, "track_id")).select(*_BOARD)


def long_matches(spark, sf_dir):
    return scoring.scoreboard(points(spark, sf_dir, "track_id % 3")).select(*_BOARD)


def score_display(spark, sf_dir):
    return scoring.displayed(scoring.scoreboard(points(spark, sf_dir, "track_id"))).select("match_id", "point_number", "show_a", "show_b", "status", "leader")


def final_states(spark, sf_dir):
    return scoring.final_states(scoring.scoreboard(points(spark, sf_dir, "track_id")))


def match_statistics(spark, sf_dir):
    return scoring.match_statistics(scoring.scoreboard(points(spark, sf_dir, "track_id")), "all_points").drop("games_events")


def match_statistics_by_event(spark, sf_dir):
    return scoring.match_statistics(scoring.scoreboard(points(spark, sf_dir, "track_id"))).drop("games_events")


def overlay_rows(spark, sf_dir):
    return _overlay(spark, sf_dir).select("frame_number", "primitive", *(F.round(k, 3).alias(k) for k in ("ax", "ay", "bx", "by")), "caption")


#: The court's corners on a screen of 1280 by 720.
CORNERS = [(200.0, 150.0), (430.0, 150.0), (500.0, 640.0), (60.0, 640.0)]


def region_candidates(spark, sf_dir):
    return D.candidates_in_region(D.ball_candidates(boxes(spark, sf_dir)), CORNERS).select("frame_number", "candidate_id")


def bright_candidates(spark, sf_dir):
    spots = boxes(spark, sf_dir).select("frame_number", "candidate_id", ((c("x2") - c("x1")) * (c("y2") - c("y1"))).alias("area"), (2 * (c("x2") - c("x1") + c("y2") - c("y1"))).alias("perimeter"), c("color_score").alias("yellow"))
    return D.bright_candidates(spots).select("frame_number", "candidate_id", F.round("circularity", 6).alias("circularity"), F.round("appearance_score", 6).alias("appearance_score"))


def video_summaries(spark, sf_dir):
    videos = _frames(spark, sf_dir).groupBy("video_id").agg(F.count("*").alias("frames_read"), F.max("frame_number").alias("last_frame"))
    out = overlay.video_summaries(detection_quality(spark, sf_dir), videos)
    return out.select("video_id", "video.frames_read", "video.last_frame", "detection.frames_both", "detection.ball_detected", "detection.both_percent")


def labelling_progress(spark, sf_dir):
    return metrics.progress(labelled(spark, sf_dir).withColumn("label", F.when(c("o_orderkey") % 3 == 0, "unlabeled").otherwise(c("label"))))


def confusion(spark, sf_dir):
    return metrics.confusion(labelled(spark, sf_dir))


def labelled(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    names = F.array(*map(F.lit, ("forehand", "backhand", "serve", "volley")))
    return d.select("o_orderkey", F.get(names, (c("o_orderkey") % 4).cast("int")).alias("label"), F.get(names, F.when(c("o_custkey") % 3 == 0, c("o_custkey") % 4).otherwise(c("o_orderkey") % 4).cast("int")).alias("prediction"))


def class_report(spark, sf_dir):
    return metrics.class_report(labelled(spark, sf_dir))


def model_scores(spark, sf_dir):
    return metrics.model_scores(labelled(spark, sf_dir))


def label_histogram(spark, sf_dir):
    return metrics.histogram(labelled(spark, sf_dir), "prediction")


_PLAYERS_SQL = f"""{BOXES_SQL},
people AS (SELECT * FROM shaped WHERE foot_y >= CAST(0.15 AS DOUBLE) * frame_height AND foot_y <= frame_height AND box_height >= CAST(0.03 AS DOUBLE) * frame_height),
scored_people AS (SELECT *, round(confidence * sqrt(greatest(area, 1)) * CAST(10000 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS selection_score FROM people),
best_people AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_number ORDER BY selection_score DESC, candidate_id) AS place FROM scored_people),
sided AS (SELECT *, row_number() OVER (PARTITION BY video_id, frame_number ORDER BY foot_y, place) AS side FROM best_people WHERE place <= 2),
players AS (SELECT *, CASE WHEN side = 1 THEN 'Player A' ELSE 'Player B' END AS player_label, CASE WHEN side = 1 THEN 'far' ELSE 'near' END AS court_side FROM sided)"""

_ZONES_SQL = f"""{BOXES_SQL},
zoned AS (
  SELECT *, CASE WHEN box_height < CAST(0.06 AS DOUBLE) * frame_height THEN 'too_small' WHEN box_width < CAST(0.02 AS DOUBLE) * frame_width THEN 'too_narrow'
    WHEN foot_y / frame_height BETWEEN CAST(0.1 AS DOUBLE) AND CAST(0.9 AS DOUBLE) THEN NULL WHEN foot_y / frame_height < CAST(0.1 AS DOUBLE) THEN 'above_far_court' ELSE 'below_near_court' END AS rejection_reason,
    CASE WHEN foot_y / frame_height BETWEEN CAST(0.1 AS DOUBLE) AND CAST(0.5 AS DOUBLE) THEN 'far' ELSE 'near' END AS zone
  FROM shaped
)"""

_LINES_SQL = f"""{BOXES_SQL},
segments AS (SELECT video_id, frame_number * 4 + candidate_id AS line_id, x1, x1 + candidate_id * 90 + 3 AS x2, y1, y1 + frame_number % 5 * 60 AS y2, frame_width, frame_height FROM boxes),
measured AS (SELECT *, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 2) AS length_pixels, round((degrees(atan2(y2 - y1, x2 - x1)) % 180 + 180) % 180, 2) AS a FROM segments),
lines AS (SELECT *, CASE WHEN a <= 15 OR a >= 165 THEN 'horizontal' WHEN abs(a - 90) <= 15 THEN 'vertical' ELSE 'diagonal' END AS orientation FROM measured)"""


def _score_sql(match: str) -> str:
    return f"""{TRACKS_SQL},
points AS (
  SELECT {match} AS match_id, row_number() OVER (PARTITION BY {match} ORDER BY e.ts, e.event_id) AS n, CASE WHEN t.y / 5 < 50 THEN 'A' ELSE 'B' END AS winner
  FROM tracks t JOIN events e USING (event_id)
),
game AS (
  SELECT match_id, n, winner, FALSE AS rejected, FALSE AS tb, CASE WHEN winner = 'A' THEN 1 ELSE 0 END AS pa, CASE WHEN winner = 'B' THEN 1 ELSE 0 END AS pb,
    0 AS ga, 0 AS gb, 0 AS sa, 0 AS sb, 0 AS ta, 0 AS tb_b, CAST(NULL AS VARCHAR) AS mw FROM points WHERE n = 1
  UNION ALL
  SELECT match_id, n, winner, mw IS NOT NULL, CASE WHEN mw IS NOT NULL THEN tb WHEN set_won AND NOT match_won THEN FALSE WHEN tie_won THEN FALSE ELSE tb OR starts_tb END,
    CASE WHEN mw IS NOT NULL THEN pa WHEN game_won OR (set_won AND NOT match_won) THEN 0 ELSE npa END, CASE WHEN mw IS NOT NULL THEN pb WHEN game_won OR (set_won AND NOT match_won) THEN 0 ELSE npb END,
    CASE WHEN mw IS NOT NULL THEN ga WHEN set_won AND NOT match_won THEN 0 ELSE nga END, CASE WHEN mw IS NOT NULL THEN gb WHEN set_won AND NOT match_won THEN 0 ELSE ngb END,
    CASE WHEN mw IS NULL AND set_won AND winner = 'A' THEN sa + 1 ELSE sa END, CASE WHEN mw IS NULL AND set_won AND winner = 'B' THEN sb + 1 ELSE sb END,
    CASE WHEN mw IS NOT NULL THEN ta WHEN set_won AND NOT match_won THEN 0 ELSE nta END, CASE WHEN mw IS NOT NULL THEN tb_b WHEN set_won AND NOT match_won THEN 0 ELSE ntb END,
    CASE WHEN mw IS NOT NULL THEN mw WHEN match_won THEN winner END
  FROM (
    SELECT *, set_won AND (CASE WHEN winner = 'A' THEN sa ELSE sb END) + 1 >= 2 AS match_won FROM (
      SELECT *, game_won AND nga = 6 AND ngb = 6 AS starts_tb,
        tie_won OR (game_won AND NOT (nga = 6 AND ngb = 6) AND (CASE WHEN winner = 'A' THEN nga ELSE ngb END) >= 6 AND (CASE WHEN winner = 'A' THEN nga - ngb ELSE ngb - nga END) >= 2) AS set_won
      FROM (
        SELECT *, ga + CASE WHEN (game_won OR tie_won) AND winner = 'A' THEN 1 ELSE 0 END AS nga, gb + CASE WHEN (game_won OR tie_won) AND winner = 'B' THEN 1 ELSE 0 END AS ngb FROM (
          SELECT *, NOT tb AND (CASE WHEN winner = 'A' THEN npa ELSE npb END) >= 4 AND (CASE WHEN winner = 'A' THEN npa - npb ELSE npb - npa END) >= 2 AS game_won,
            tb AND (CASE WHEN winner = 'A' THEN nta ELSE ntb END) >= 7 AND (CASE WHEN winner = 'A' THEN nta - ntb ELSE ntb - nta END) >= 2 AS tie_won
          FROM (
            SELECT g.match_id, p.n, p.winner, g.tb, g.pa, g.pb, g.ga, g.gb, g.sa, g.sb, g.ta, g.tb_b, g.mw,
              g.pa + CASE WHEN NOT g.tb AND p.winner = 'A' THEN 1 ELSE 0 END AS npa, g.pb + CASE WHEN NOT g.tb AND p.winner = 'B' THEN 1 ELSE 0 END AS npb,
              g.ta + CASE WHEN g.tb AND p.winner = 'A' THEN 1 ELSE 0 END AS nta, g.tb_b + CASE WHEN g.tb AND p.winner = 'B' THEN 1 ELSE 0 END AS ntb
            FROM game g JOIN points p ON p.match_id = g.match_id AND p.n = g.n + 1
          )
        )
      )
    )
  )
),
board AS (
  SELECT match_id, n AS point_number, winner, rejected, tb AS in_tiebreak, pa AS points_a, pb AS points_b, ga AS games_a, gb AS games_b, sa AS sets_a, sb AS sets_b, ta AS tie_a, tb_b AS tie_b, mw AS match_winner FROM game
)"""


_TRACK_SCORE, _LONG_SCORE = _score_sql("track_id"), _score_sql("track_id % 3")

_CLIPS_SQL = f"""{TRACKS_SQL},
islands AS (SELECT *, frame_number - row_number() OVER (PARTITION BY track_id ORDER BY frame_number) AS island FROM tracks WHERE NOT predicted),
runs AS (SELECT track_id, min(frame_number) AS s, max(frame_number) AS e FROM islands GROUP BY track_id, island HAVING count(*) >= 8),
centres AS (SELECT track_id, s, e, unnest(range(s + 2, e + 1, 6)) AS center_frame FROM runs WHERE e - s >= 2),
clips AS (
  SELECT track_id, greatest(s, center_frame - 2) AS clip_start, least(e, center_frame + 2) AS clip_end, center_frame,
    'shot_' || lpad(CAST(row_number() OVER (PARTITION BY track_id ORDER BY center_frame) AS VARCHAR), 4, '0') AS clip_id FROM centres
)"""

_LABELS_SQL = """named AS (SELECT ['forehand', 'backhand', 'serve', 'volley'] AS l),
labelled AS (
  SELECT l[o_orderkey % 4 + 1] AS label, l[CASE WHEN o_custkey % 3 = 0 THEN o_custkey % 4 ELSE o_orderkey % 4 END + 1] AS prediction FROM orders, named
),
truth AS (SELECT label AS k, count(*) AS support FROM labelled GROUP BY 1),
guess AS (SELECT prediction AS k, count(*) AS predicted FROM labelled GROUP BY 1),
hits AS (SELECT label AS k, count(*) AS hit FROM labelled WHERE label = prediction GROUP BY 1),
raw AS (
  SELECT k AS class, coalesce(support, 0) AS support, coalesce(hit, 0) / CAST(nullif(predicted, 0) AS DOUBLE) AS p, coalesce(hit, 0) / CAST(nullif(support, 0) AS DOUBLE) AS r
  FROM truth FULL JOIN guess USING (k) LEFT JOIN hits USING (k)
),
report AS (SELECT class, support, coalesce(p, 0) AS p, coalesce(r, 0) AS r, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM raw)"""

QUERIES = {
    f.__name__: f
    for f in (
        candidate_ranking, temporal_candidates, fallback_candidates, select_players, court_rejections, zone_rejections, rejection_histogram, detection_quality, court_lines, line_summary,
        frame_stride, letterbox, quality_flags, frame_documents, overlay_plan, clip_windows, clip_frames, scoreboard, long_matches, score_display, final_states, match_statistics,
        class_report, model_scores, label_histogram, match_statistics_by_event, overlay_rows, region_candidates, bright_candidates, video_summaries, labelling_progress, confusion,
    )
}

_D = "sqrt((center_x - px) * (center_x - px) + (center_y - py) * (center_y - py))"

ORACLE = {
    "candidate_ranking": f"WITH {BOXES_SQL} SELECT frame_number, candidate_id, aspect_ratio, area_ratio, ranking_score, rank FROM ranked",
    "temporal_candidates": f"""WITH {BOXES_SQL}, hints AS (SELECT frame_number, x1 + 20 AS px, y1 + 10 AS py FROM boxes WHERE candidate_id = 0 AND frame_number % 3 <> 0),
      near AS (SELECT r.*, px, round({_D}, 3) AS prediction_distance, CASE WHEN px IS NULL THEN ranking_score ELSE round(ranking_score * CAST(0.55 AS DOUBLE) + greatest(CAST(0 AS DOUBLE), 1 - {_D} / 180) * CAST(0.45 AS DOUBLE), 4) END AS temporal_score
        FROM ranked r LEFT JOIN hints USING (frame_number) WHERE px IS NULL OR {_D} <= 180)
      SELECT frame_number, candidate_id, prediction_distance, temporal_score FROM (SELECT *, row_number() OVER (PARTITION BY frame_number ORDER BY temporal_score DESC, rank) AS place FROM near) WHERE place = 1""",
    "fallback_candidates": f"""WITH {BOXES_SQL} SELECT video_id, frame_number, candidate_id, confidence, 'detector' AS source FROM ranked
      UNION ALL SELECT video_id, frame_number, candidate_id, confidence, 'color_fallback' FROM boxes WHERE candidate_id = 1 AND frame_number NOT IN (SELECT frame_number FROM ranked)""",
    "select_players": f"WITH {_PLAYERS_SQL} SELECT frame_number, candidate_id, selection_score, player_label, court_side FROM players",
    "court_rejections": f"""WITH {BOXES_SQL}, located AS (SELECT *, round((CAST({AFFINE[0][0]!r} AS DOUBLE) * foot_x + CAST(0 AS DOUBLE) * foot_y + CAST({AFFINE[0][2]!r} AS DOUBLE)) / CAST(1 AS DOUBLE) * CAST(10000 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS court_x,
        round((CAST(0 AS DOUBLE) * foot_x + CAST({AFFINE[1][1]!r} AS DOUBLE) * foot_y + CAST({AFFINE[1][2]!r} AS DOUBLE)) / CAST(1 AS DOUBLE) * CAST(10000 AS DOUBLE)) / CAST(10000 AS DOUBLE) AS court_y FROM geo)
      SELECT frame_number, candidate_id, court_x, court_y, CASE WHEN NOT (court_x BETWEEN -15 AND CAST(23.23 AS DOUBLE) AND court_y BETWEEN -15 AND CAST(38.77 AS DOUBLE)) THEN 'outside_court_bounds'
        WHEN court_y < -10 THEN 'behind_near_baseline' WHEN court_y > CAST(33.77 AS DOUBLE) THEN 'behind_far_baseline' END AS rejection_reason FROM located""",
    "zone_rejections": f"WITH {_ZONES_SQL} SELECT frame_number, candidate_id, CASE WHEN rejection_reason IS NULL THEN zone END AS player_zone, rejection_reason FROM zoned",
    "rejection_histogram": f"WITH {_ZONES_SQL} SELECT coalesce(rejection_reason, 'kept') AS reason, count(*) AS persons FROM zoned GROUP BY 1",
    "detection_quality": f"""WITH {_PLAYERS_SQL}, p AS (SELECT frame_number, bool_or(player_label = 'Player A') AS has_a, bool_or(player_label = 'Player B') AS has_b FROM players GROUP BY 1),
      b AS (SELECT frame_number, CASE WHEN confidence >= 0.5 THEN 'detected' ELSE 'predicted' END AS ball FROM ranked WHERE rank = 1),
      f AS (SELECT video_id, coalesce(has_a, FALSE) AS a, coalesce(has_b, FALSE) AS b, coalesce(ball, 'lost') AS ball FROM (SELECT DISTINCT video_id, frame_number FROM boxes) LEFT JOIN p USING (frame_number) LEFT JOIN b USING (frame_number))
      SELECT video_id, count(*) AS frames, count(*) FILTER (a) AS frames_a, count(*) FILTER (b) AS frames_b, count(*) FILTER (a AND b) AS frames_both, count(*) FILTER (ball = 'detected') AS ball_detected,
        count(*) FILTER (ball = 'predicted') AS ball_predicted, count(*) FILTER (ball = 'lost') AS ball_lost, round(CAST(100 AS DOUBLE) * count(*) FILTER (a AND b) / count(*), 2) AS both_percent,
        round(CAST(100 AS DOUBLE) * count(*) FILTER (ball = 'detected') / count(*), 2) AS ball_percent FROM f GROUP BY 1""",
    "court_lines": f"""WITH {_LINES_SQL}, top AS (SELECT *, row_number() OVER (PARTITION BY video_id, orientation ORDER BY length_pixels DESC, line_id) AS place FROM lines WHERE length_pixels > CAST(0.1 AS DOUBLE) * greatest(frame_width, frame_height) AND orientation <> 'diagonal')
      SELECT video_id, line_id, orientation, length_pixels, place, count(*) OVER (PARTITION BY video_id) >= 6 AS is_court FROM top WHERE place <= CASE WHEN orientation = 'horizontal' THEN 6 ELSE 4 END""",
    "line_summary": f"""WITH {_LINES_SQL} SELECT video_id, count(*) AS line_count, count(*) FILTER (orientation = 'horizontal') AS horizontal, count(*) FILTER (orientation = 'vertical') AS vertical,
      count(*) FILTER (orientation = 'diagonal') AS diagonal, round(avg(length_pixels), 2) AS average_length, max(length_pixels) AS longest FROM lines GROUP BY 1""",
    "frame_stride": f"""WITH {BOXES_SQL}, f AS (SELECT DISTINCT video_id, frame_number FROM boxes WHERE frame_number % 3 = 0), n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) AS place FROM f),
      m AS (SELECT video_id, frame_number, CAST(round(frame_number / CAST(25 AS DOUBLE) * 1000) AS BIGINT) AS ms FROM n WHERE place <= 10)
      SELECT video_id, frame_number, printf('%02d:%02d:%02d.%03d', ms // 3600000, ms // 60000 % 60, ms // 1000 % 60, ms % 1000) AS at FROM m""",
    "letterbox": """WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 1900 + 1 AS DOUBLE) AS w, CAST(o_custkey % 1000 + 1 AS DOUBLE) AS h FROM orders), k AS (SELECT *, least(640 / w, 640 / h) AS k FROM s),
      n AS (SELECT *, greatest(1, CAST(round(w * k) AS INT)) AS nw, greatest(1, CAST(round(h * k) AS INT)) AS nh FROM k)
      SELECT o_orderkey, round(k, 6) AS scale, nw AS new_width, nh AS new_height, (640 - nw) // 2 AS pad_left, (640 - nh) // 2 AS pad_top, 640 - nw - (640 - nw) // 2 AS pad_right, 640 - nh - (640 - nh) // 2 AS pad_bottom FROM n""",
    "quality_flags": """WITH e AS (SELECT event_id, event_id * 7 % 256 AS b, event_id * 11 % 200 AS s FROM events)
      SELECT event_id, b < 45 AS is_dark, b > 210 AS is_overexposed, s < 80 AS is_blurry, concat_ws(',', CASE WHEN b < 45 THEN 'dark' END, CASE WHEN b > 210 THEN 'overexposed' END, CASE WHEN s < 80 THEN 'blurry' END) AS issues,
        b >= 45 AND b <= 210 AND s >= 80 AS acceptable FROM e""",
    "frame_documents": f"""WITH {_PLAYERS_SQL}, p AS (SELECT frame_number, count(*) AS n, string_agg(player_label, ',' ORDER BY player_label) AS labels FROM players GROUP BY 1)
      SELECT f.frame_number, coalesce(n, 0) AS players, coalesce(labels, '') AS labels, round(center_x, 3) AS ball_x, round(center_y, 3) AS ball_y
      FROM (SELECT DISTINCT frame_number FROM boxes) f LEFT JOIN p USING (frame_number) LEFT JOIN (SELECT * FROM ranked WHERE rank = 1) b USING (frame_number)""",
    "overlay_plan": f"""WITH {_PLAYERS_SQL}, f AS (SELECT DISTINCT video_id, frame_number FROM boxes), legs AS (SELECT * FROM (SELECT video_id, frame_number, lag(center_x) OVER (PARTITION BY video_id ORDER BY frame_number) AS ax FROM ranked WHERE rank = 1) WHERE ax IS NOT NULL),
      tails AS (SELECT video_id, unnest(range(frame_number, frame_number + 30)) AS frame_number FROM legs)
      SELECT frame_number, 'box' AS primitive, count(*) AS drawn FROM players GROUP BY 1 UNION ALL SELECT frame_number, 'marker', count(*) FROM ranked WHERE rank = 1 GROUP BY 1
      UNION ALL SELECT frame_number, 'tail', count(*) FROM tails JOIN f USING (video_id, frame_number) GROUP BY 1""",
    "clip_windows": f"WITH {_CLIPS_SQL} SELECT track_id, clip_start, clip_end, center_frame, clip_id FROM clips",
    "clip_frames": f"WITH {_CLIPS_SQL} SELECT c.track_id, clip_id, frame_number, event_id FROM clips c JOIN tracks t ON t.track_id = c.track_id AND frame_number >= clip_start AND frame_number < clip_end",
    "scoreboard": f"WITH RECURSIVE {_TRACK_SCORE} SELECT * FROM board",
    "long_matches": f"WITH RECURSIVE {_LONG_SCORE} SELECT * FROM board",
    "score_display": f"""WITH RECURSIVE {_TRACK_SCORE} SELECT match_id, point_number,
      CASE WHEN in_tiebreak THEN CAST(tie_a AS VARCHAR) WHEN points_a >= 3 AND points_b >= 3 AND points_a > points_b THEN 'AD' ELSE ['0', '15', '30', '40'][least(points_a, 3) + 1] END AS show_a,
      CASE WHEN in_tiebreak THEN CAST(tie_b AS VARCHAR) WHEN points_a >= 3 AND points_b >= 3 AND points_b > points_a THEN 'AD' ELSE ['0', '15', '30', '40'][least(points_b, 3) + 1] END AS show_b,
      CASE WHEN in_tiebreak THEN 'TIEBREAK' WHEN points_a >= 3 AND points_a = points_b THEN 'DEUCE' WHEN points_a >= 3 AND points_b >= 3 THEN 'ADVANTAGE' ELSE 'NORMAL' END AS status,
      coalesce(match_winner, CASE WHEN sets_a <> sets_b THEN CASE WHEN sets_a > sets_b THEN 'A' ELSE 'B' END WHEN games_a <> games_b THEN CASE WHEN games_a > games_b THEN 'A' ELSE 'B' END
        WHEN points_a <> points_b THEN CASE WHEN points_a > points_b THEN 'A' ELSE 'B' END ELSE 'TIED' END) AS leader FROM board""",
    "final_states": f"""WITH RECURSIVE {_TRACK_SCORE}, l AS (SELECT *, row_number() OVER (PARTITION BY match_id ORDER BY point_number DESC) AS back, count(*) OVER (PARTITION BY match_id) AS points_played, count(*) FILTER (rejected) OVER (PARTITION BY match_id) AS rejections FROM board)
      SELECT match_id, points_played, rejections AS rejected, points_a, points_b, games_a, games_b, sets_a, sets_b, tie_a, tie_b, in_tiebreak, match_winner FROM l WHERE back = 1""",
    "match_statistics": f"""WITH RECURSIVE {_TRACK_SCORE}, w AS (SELECT match_id, count(*) FILTER (NOT rejected AND winner = 'A') AS won_a, count(*) FILTER (NOT rejected AND winner = 'B') AS won_b FROM board GROUP BY 1)
      SELECT *, won_a + won_b AS total_points, coalesce(round(CAST(100 AS DOUBLE) * won_a / (won_a + won_b), 2), 0) AS win_rate_a, coalesce(round(CAST(100 AS DOUBLE) * won_b / (won_a + won_b), 2), 0) AS win_rate_b,
        CASE WHEN won_a > won_b THEN 'A' WHEN won_b > won_a THEN 'B' ELSE 'TIED' END AS points_leader FROM w""",
    "match_statistics_by_event": f"""WITH RECURSIVE {_TRACK_SCORE}, k AS (SELECT *, NOT rejected AND NOT (in_tiebreak AND coalesce(lag(in_tiebreak) OVER (PARTITION BY match_id ORDER BY point_number), FALSE)) AS counted FROM board),
      w AS (SELECT match_id, count(*) FILTER (counted AND winner = 'A') AS won_a, count(*) FILTER (counted AND winner = 'B') AS won_b FROM k GROUP BY 1)
      SELECT *, won_a + won_b AS total_points, coalesce(round(CAST(100 AS DOUBLE) * won_a / (won_a + won_b), 2), 0) AS win_rate_a, coalesce(round(CAST(100 AS DOUBLE) * won_b / (won_a + won_b), 2), 0) AS win_rate_b,
        CASE WHEN won_a > won_b THEN 'A' WHEN won_b > won_a THEN 'B' ELSE 'TIED' END AS points_leader FROM w""",
    "overlay_rows": f"""WITH {_PLAYERS_SQL}, f AS (SELECT DISTINCT video_id, frame_number FROM boxes),
      seen AS (SELECT video_id, frame_number, center_x, center_y, lag(center_x) OVER w AS lx, lag(center_y) OVER w AS ly FROM ranked WHERE rank = 1 WINDOW w AS (PARTITION BY video_id ORDER BY frame_number)),
      tails AS (SELECT video_id, unnest(range(frame_number, frame_number + 30)) AS frame_number, lx, ly, center_x, center_y FROM seen WHERE lx IS NOT NULL),
      every AS (SELECT frame_number, 'box' AS primitive, x1 AS ax, y1 AS ay, x2 AS bx, y2 AS by_, player_label AS caption FROM players UNION ALL SELECT frame_number, 'marker', center_x, center_y, center_x, center_y, 'ball' FROM seen
        UNION ALL SELECT frame_number, 'tail', lx, ly, center_x, center_y, '' FROM tails JOIN f USING (video_id, frame_number))
      SELECT frame_number, primitive, round(ax, 3) AS ax, round(ay, 3) AS ay, round(bx, 3) AS bx, round(by_, 3) AS "by", caption FROM every""",
    "region_candidates": f"""WITH {BOXES_SQL}, p AS (SELECT *, floor(center_x) AS x, floor(center_y) AS y, floor(floor(frame_width * CAST(0.05 AS DOUBLE)) / 2) AS m FROM ranked)
      SELECT frame_number, candidate_id FROM p WHERE x BETWEEN 60 - m AND 500 + m AND y BETWEEN 150 - m AND 640 + m AND 230 * (y - 150) >= -m * 230 AND 70 * (y - 150) - 490 * (x - 430) >= -m * 560
        AND -440 * (y - 640) >= -m * 440 AND 140 * (y - 640) + 490 * (x - 60) >= -m * 630""",
    "bright_candidates": f"""WITH {BOXES_SQL}, s AS (SELECT *, (x2 - x1) * (y2 - y1) AS a, 2 * (x2 - x1 + y2 - y1) AS p FROM boxes), k AS (SELECT *, 4 * pi() * a / (p * p) AS r FROM s WHERE a BETWEEN 10 AND 500 AND p <> 0)
      SELECT frame_number, candidate_id, round(r, 6) AS circularity, round(r * CAST(0.4 AS DOUBLE) + color_score * CAST(0.6 AS DOUBLE), 6) AS appearance_score FROM k WHERE r >= 0.5""",
    "labelling_progress": """WITH l AS (SELECT o_orderkey % 3 = 0 AS open FROM orders)
      SELECT count(*) AS total, count(*) FILTER (NOT open) AS labelled, count(*) FILTER (open) AS unlabelled, round(CAST(100 AS DOUBLE) * count(*) FILTER (NOT open) / count(*), 1) AS percent FROM l""",
    "confusion": f"WITH {_LABELS_SQL} SELECT label, prediction, count(*) AS n FROM labelled GROUP BY 1, 2",
    "class_report": f"WITH {_LABELS_SQL} SELECT class, support, round(p, 4) AS precision, round(r, 4) AS recall, round(f, 4) AS f1 FROM report",
    "model_scores": f"""WITH {_LABELS_SQL} SELECT (SELECT round(avg(CAST(label = prediction AS INT)), 4) FROM labelled) AS accuracy, round(avg(p), 4) AS macro_precision, round(avg(r), 4) AS macro_recall, round(avg(f), 4) AS macro_f1, sum(support)::BIGINT AS samples FROM report""",
    "label_histogram": f"WITH {_LABELS_SQL} SELECT prediction AS value, count(*) AS n, round(CAST(100 AS DOUBLE) * count(*) / sum(count(*)) OVER (), 2) AS percent FROM labelled GROUP BY 1",
}

_QUALITY = ORACLE["detection_quality"]
ORACLE["video_summaries"] = f"""SELECT v.video_id, frames_read, last_frame, frames_both, ball_detected, both_percent
  FROM (SELECT event_id // 4 // 100 AS video_id, count(DISTINCT event_id // 4) AS frames_read, max(event_id // 4) AS last_frame FROM events GROUP BY 1) v JOIN ({_QUALITY}) q ON q.video_id = v.video_id"""
