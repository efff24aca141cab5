"""Queries over records: as-of joins of two tables, calibrations by video, documents, events, templates, prepared features, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.operators import asof, classifier, court, homography, overlay, scoring, shots, trackers
from rallyframe.operators import detections as D
from rallyframe.plans import tracker_queries as T
from rallyframe.plans.detection_queries import _BOARD, _CLIPS_SQL, _TRACK_SCORE, BOXES_SQL, _frames, boxes, points, segments, visible
from rallyframe.plans.misc_queries import suggested_clips
from rallyframe.plans.track_queries import BOUNCES_SQL, bounces
from rallyframe.sources import sinks
from rallyframe.sources.tracks import TRACKS_SQL, event_tracks, table
from rallyframe.streaming import stateful

c = F.col


def asof_orders(spark, sf_dir):
    """The last order of its status before each line is shipped: three keys hold all rows."""
    days = lambda k: F.datediff(c(k), F.lit("1995-01-01").cast("date")).cast("double")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c("l_linestatus").alias("status"), (days("l_shipdate") + c("l_linenumber") / 10.0).alias("day"))
    orders = table(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(c("o_orderstatus").alias("status"), days("o_orderdate").alias("day"), "o_orderkey", "o_totalprice")
    return asof.asof_join(lines, orders, "status", "day", ["o_orderkey", "o_totalprice"], tolerance=20.0, slice_length=30.0)


def radar(spark, sf_dir) -> DataFrame:
    """Speeds that another device took: the track, second and speed of every line item."""
    day = F.datediff(c("l_shipdate"), F.lit("1995-01-01").cast("date"))
    return table(spark, sf_dir, "lineitem").select((c("l_suppkey") % 160).alias("track_id"), (day / 40.0).alias("timestamp_seconds"), c("l_extendedprice").alias("radar_kmh"), "l_orderkey", "l_linenumber")


def bounce_radar(spark, sf_dir):
    found = asof.asof_join(bounces(spark, sf_dir).select("track_id", "frame_number", "timestamp_seconds"), radar(spark, sf_dir), "track_id", "timestamp_seconds", ["radar_kmh"], tolerance=1.5, slice_length=5.0, ties=["l_orderkey", "l_linenumber"])
    return found.select("track_id", "frame_number", F.round("matched_at", 4).alias("matched_at"), "radar_kmh")


def calibration_attempts(spark, sf_dir):
    main = (c("length_pixels") > 128) & (c("orientation") != "diagonal")
    frames = D.lines(segments(spark, sf_dir)).groupBy("video_id", F.floor(c("line_id") / 4).alias("frame_number")).agg(F.count_if(main).alias("lines"))
    own = frames.select("video_id", (c("frame_number") % 100).alias("frame_number"), F.when((c("frame_number") * 7 + c("video_id")) % 97 > 0, c("lines")).alias("lines"))
    return D.calibration_attempts(own, least_lines=4)


def scoreboard_native(spark, sf_dir):
    return scoring.scoreboard_by_chunks(points(spark, sf_dir, "track_id")).select(*_BOARD)


def score_events(spark, sf_dir):
    out = stateful.score_events(scoring.scoreboard(points(spark, sf_dir, "track_id")))
    return out.select("match_id", "point_number", "place", "event", "winner", "state.sets_a", "state.sets_b")


def _videos(spark, sf_dir) -> DataFrame:
    return _frames(spark, sf_dir).groupBy("video_id").agg(F.max("frame_number").alias("last_frame")).withColumn("path", F.format_string("/videos/%d.mp4", "video_id"))


def tracking_documents(spark, sf_dir):
    tracked = trackers.folded(T.ball_frames(spark, sf_dir), trackers.SmoothedBall, trackers.SmoothedBall.schema)
    docs = overlay.tracking_documents(_videos(spark, sf_dir), tracked, trackers.track_summary(tracked))
    return docs.select("video_id", "video.path", "processed_frames", "visible_detection_frames", "prediction_frames", "tracking_summary.lost", "tracking_summary.last_vx", "tracking_summary.last_missed")


def player_documents(spark, sf_dir):
    docs = overlay.player_documents(_videos(spark, sf_dir), T.stable_labels(spark, sf_dir))
    said = F.array_join(F.transform(F.map_entries("track_to_player_label"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return docs.select("video_id", "video.last_frame", "processed_frames", said.alias("labels"))


def frames_metadata(spark, sf_dir):
    docs = overlay.frames_metadata(D.every_nth(_frames(spark, sf_dir), 3, 10), _videos(spark, sf_dir), F.lit(25.0))
    return docs.select("video", "total_extracted_frames", F.get("frames", 0)["filename"].alias("first"), F.element_at("frames", -1)["timestamp_seconds"].alias("last_seconds"))


def annotation_template(spark, sf_dir):
    out = sinks.annotation_template(suggested_clips(spark, sf_dir), 4.0)
    return out.select("video", "shot_id", "start_frame", "end_frame", "center_frame", "duration_sec", "suggested_player", "label", "confidence")


def first_clips(spark, sf_dir):
    return shots.clip_windows(shots.visible_runs(visible(spark, sf_dir), 8), fps=4.0, most=2).select("track_id", "clip_id", "center_frame")


#: A view of its own for each video: what maps pixels to metres, by the video's number.
def _view(v):
    return [[F.lit(0.02), v % 5 * 0.0004, F.lit(-2.0)], [v % 3 * 0.0003, F.lit(0.04), F.lit(-4.0)], [F.lit(0.0), v % 4 * 0.0001, F.lit(1.0)]]


def mapped_by_video(spark, sf_dir):
    """Points through the calibration of their video; every seventh video has none."""
    seen = event_tracks(spark, sf_dir).select(c("track_id").alias("video_id"), "event_id", "x", "y")
    views = seen.select("video_id").distinct().where("video_id % 7 > 0").withColumn("homography", F.array(*(F.array(*row) for row in _view(c("video_id")))))
    return court.mapped_by_video(seen, views).select("event_id", "court_x", "court_y", "inside", "zone")


def solved_calibrations(spark, sf_dir):
    """Calibrations from key points: where each video's solved matrix puts points of its picture. A sixth point of some is far off."""
    views = event_tracks(spark, sf_dir).select(c("track_id").alias("v")).distinct()
    corners = spark.createDataFrame([("a", 100.0, 100.0), ("b", 900.0, 120.0), ("c", 850.0, 600.0), ("d", 90.0, 580.0), ("e", 480.0, 300.0), ("f", 300.0, 450.0)], "name string, x double, y double")

    def to_court(x, y):
        h = _view(c("v"))
        w = h[2][0] * x + h[2][1] * y + h[2][2]
        return [(h[i][0] * x + h[i][1] * y + h[i][2]) / w for i in (0, 1)]

    named = views.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("name", F.substring(F.lit("abcdef"), c("k") + 1, F.lit(1)))
    seen = named.join(corners, "name")
    cx, cy = to_court(c("x"), c("y"))
    off = F.when((c("name") == "f") & (c("v") % 4 == 1), 40.0).otherwise(0.0)
    seen = seen.select(c("v").cast("string").alias("calibration_id"), F.concat(c("v").cast("string"), F.lit("/"), "name").alias("name"), "x", "y", (cx + off).alias("court_x"), cy.alias("court_y"))
    solved = homography.calibrate(seen.select("calibration_id", "name", "x", "y"), seen.select("name", "court_x", "court_y"))
    x, y = (F.round(v, 3) for v in court.G.project(c("homography"), F.lit(500.0), F.lit(333.0), None))
    return solved.select("calibration_id", "points", x.alias("court_x"), y.alias("court_y"), "accepted")


FEATURES = ("duration_seconds", "start_x", "start_y", "delta_x")


def prepared_features(spark, sf_dir):
    """Line items as shots: prepared, medians for what is missing, standardized."""
    k = c("l_orderkey") * 8 + c("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        k.alias("key"), c("l_returnflag").alias("shot_type"), F.when(k % 5 > 0, c("l_quantity")).alias("duration_seconds"), c("l_extendedprice").alias("start_x"), F.when(k % 3 == 1, c("l_discount")).alias("start_y"), F.lit(4.5).alias("delta_x"),
    )
    classifier.prepare(rows.drop("key"))
    return classifier.standardized(rows, list(FEATURES)).select("key", "shot_type", *(F.round(k, 6).alias(k) for k in FEATURES))


QUERIES = {
    f.__name__: f
    for f in (asof_orders, bounce_radar, calibration_attempts, scoreboard_native, score_events, tracking_documents, player_documents, frames_metadata, annotation_template, first_clips, mapped_by_video, solved_calibrations, prepared_features)
}

_VIEW_SQL = "(0.02::DOUBLE * {x} + v % 5 * 0.0004::DOUBLE * {y} - 2) / (v % 4 * 0.0001::DOUBLE * {y} + 1) AS px, (v % 3 * 0.0003::DOUBLE * {x} + 0.04::DOUBLE * {y} - 4) / (v % 4 * 0.0001::DOUBLE * {y} + 1) AS py"
_FIXED4 = "CASE WHEN {0} < 0 THEN -1 ELSE 1 END * floor(abs({0}) * 10000 + CAST(0.5 AS DOUBLE)) / CAST(10000 AS DOUBLE)"
_DAYS = "date_diff('day', DATE '1995-01-01', CAST({} AS DATE))"

ORACLE = {
    "asof_orders": f"""WITH o AS (SELECT o_orderstatus AS status, {_DAYS.format("o_orderdate")}::DOUBLE AS day, max({{'k': o_orderkey, 'p': o_totalprice}}) AS r FROM orders WHERE o_orderkey % 50 = 0 GROUP BY ALL),
      l AS (SELECT l_orderkey, l_linenumber, l_linestatus AS status, {_DAYS.format("l_shipdate")} + l_linenumber / 10.0::DOUBLE AS day FROM lineitem)
      SELECT l.l_orderkey, l.l_linenumber, l.status, l.day, CASE WHEN l.day - o.day <= 20 THEN o.day END AS matched_at, CASE WHEN l.day - o.day <= 20 THEN o.r.k END AS o_orderkey, CASE WHEN l.day - o.day <= 20 THEN o.r.p END AS o_totalprice
      FROM l ASOF LEFT JOIN o ON l.status = o.status AND l.day >= o.day""",
    "bounce_radar": f"""WITH {BOUNCES_SQL}, radar AS (SELECT l_suppkey % 160 AS track_id, {_DAYS.format("l_shipdate")} / 40.0::DOUBLE AS t, max({{'k': l_orderkey, 'n': l_linenumber, 'v': l_extendedprice}}) AS r FROM lineitem GROUP BY ALL)
      SELECT b.track_id, b.frame_number, CASE WHEN b.timestamp_seconds - r.t <= 1.5::DOUBLE THEN round(r.t, 4) END AS matched_at, CASE WHEN b.timestamp_seconds - r.t <= 1.5::DOUBLE THEN r.r.v END AS radar_kmh
      FROM bounces b ASOF LEFT JOIN radar r ON b.track_id = r.track_id AND b.timestamp_seconds >= r.t""",
    "calibration_attempts": f"""WITH RECURSIVE {BOXES_SQL}, s AS (SELECT video_id, frame_number AS f, x1, y1, x1 + candidate_id * 90 + 3 AS x2, y1 + frame_number % 5 * 60 AS y2 FROM boxes),
      l AS (SELECT *, round(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)), 2) AS len, round(degrees(atan2(y2 - y1, x2 - x1)), 2) AS ang FROM s),
      n AS (SELECT video_id, f % 100 AS frame_number, CASE WHEN any_value((f * 7 + video_id) % 97) > 0 THEN count(*) FILTER (len > 128 AND (ang <= 15 OR ang >= 165 OR abs(ang - 90) <= 15)) END AS lines FROM l GROUP BY video_id, f),
      tries AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) AS i FROM n WHERE frame_number BETWEEN 11 AND 99),
      fold AS (
        SELECT DISTINCT video_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS calibrated_at, CAST(NULL AS BIGINT) AS ended_at FROM n
        UNION ALL
        SELECT t.video_id, t.i, CASE WHEN lines >= 4 THEN frame_number END, CASE WHEN lines IS NULL OR lines >= 4 OR frame_number > 50 THEN frame_number END FROM fold f JOIN tries t ON t.video_id = f.video_id AND t.i = f.i + 1 WHERE f.ended_at IS NULL
      )
      SELECT video_id, max(i) AS attempts, max(calibrated_at) AS calibrated_at, max(ended_at) AS ended_at FROM fold GROUP BY 1""",
    "scoreboard_native": f"WITH RECURSIVE {_TRACK_SCORE} SELECT * FROM board",
    "score_events": f"""WITH RECURSIVE {_TRACK_SCORE},
      changes AS (SELECT *, coalesce(lag(in_tiebreak) OVER w, FALSE) AS was_tie, sets_a + sets_b > coalesce(lag(sets_a + sets_b) OVER w, 0) AS set_won, games_a + games_b <> coalesce(lag(games_a + games_b) OVER w, 0) AS games_moved,
        match_winner IS NOT NULL AND NOT rejected AS match_won FROM board WINDOW w AS (PARTITION BY match_id ORDER BY point_number)),
      lists AS (SELECT *, CASE WHEN rejected THEN ['rejected'] WHEN was_tie AND NOT set_won THEN [] WHEN was_tie THEN ['point', 'set'] || CASE WHEN match_won THEN ['match'] ELSE [] END
        ELSE CASE WHEN games_moved OR set_won THEN ['game'] ELSE [] END || CASE WHEN set_won THEN ['set'] ELSE [] END || CASE WHEN match_won THEN ['match'] ELSE [] END || ['point'] END AS e FROM changes)
      SELECT match_id, point_number, (i - 1)::INT AS place, e[i] AS event, winner, sets_a, sets_b FROM (SELECT *, unnest(range(1, len(e) + 1)) AS i FROM lists)""",
    "tracking_documents": f"""WITH RECURSIVE {T.SMOOTHED_SQL} SELECT video_id, '/videos/' || video_id || '.mp4' AS path, count(*) AS processed_frames, count(*) FILTER (source = 'detected') AS visible_detection_frames, count(*) FILTER (source = 'predicted') AS prediction_frames,
      count(*) FILTER (source = 'lost') AS lost, max_by(vx, frame_number) AS last_vx, max_by(missed, frame_number) AS last_missed FROM tracked GROUP BY 1""",
    "player_documents": f"""WITH RECURSIVE {T.LABELS_SQL}, l AS (SELECT video_id, track, max_by(player_label, frame_number) AS label FROM named WHERE n > 0 GROUP BY ALL), f AS (SELECT video_id, count(DISTINCT frame_number) AS k FROM named WHERE n > 0 GROUP BY 1),
      v AS (SELECT video_id, max(frame_number) AS last_frame FROM boxes GROUP BY 1)
      SELECT v.video_id, last_frame, coalesce(any_value(k), 0) AS processed_frames, coalesce(string_agg(track || '=' || label, ';' ORDER BY track), '') AS labels FROM v LEFT JOIN l USING (video_id) LEFT JOIN f USING (video_id) GROUP BY v.video_id, last_frame""",
    "frames_metadata": f"""WITH {BOXES_SQL}, f AS (SELECT DISTINCT video_id, frame_number FROM boxes), t AS (SELECT * FROM f WHERE frame_number % 3 = 0 QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY frame_number) <= 10)
      SELECT '/videos/' || v.video_id || '.mp4' AS video, count(t.frame_number) AS total_extracted_frames, printf('frame_%06d.jpg', min(t.frame_number)) AS first, round(max(t.frame_number) / 25.0::DOUBLE, 3) AS last_seconds
      FROM (SELECT DISTINCT video_id FROM f) v LEFT JOIN t USING (video_id) GROUP BY v.video_id""",
    "annotation_template": f"""WITH {_CLIPS_SQL}, p AS (SELECT track_id, frame_number, CASE WHEN event_id % 5 > 0 THEN event_id * 7 % 24 END AS a, CASE WHEN (event_id + 2) % 5 > 0 THEN event_id * 9 % 24 END AS b FROM tracks)
      SELECT CAST(c.track_id AS VARCHAR) AS video, clip_id AS shot_id, clip_start AS start_frame, clip_end AS end_frame, center_frame, round((clip_end - clip_start) / 4.0::DOUBLE, 3) AS duration_sec,
        CASE WHEN a < b THEN 'player_a' WHEN a IS NOT NULL AND b IS NOT NULL THEN 'player_b' ELSE 'unknown' END AS suggested_player, 'unlabeled' AS label, '' AS confidence
      FROM clips c LEFT JOIN p ON p.track_id = c.track_id AND p.frame_number = center_frame""",
    "first_clips": f"WITH {_CLIPS_SQL} SELECT track_id, clip_id, center_frame FROM clips WHERE clip_id <= 'shot_0002'",
    "mapped_by_video": f"""WITH {TRACKS_SQL}, m AS (SELECT *, {_VIEW_SQL.format(x="x", y="y")} FROM (SELECT track_id AS v, event_id, x, y FROM tracks)),
      r AS (SELECT event_id, CASE WHEN v % 7 > 0 THEN {_FIXED4.format("px")} END AS court_x, CASE WHEN v % 7 > 0 THEN {_FIXED4.format("py")} END AS court_y FROM m),
      i AS (SELECT *, court_x BETWEEN 0 AND 8.23::DOUBLE AND court_y BETWEEN 0 AND 23.77::DOUBLE AS inside FROM r)
      SELECT event_id, court_x, court_y, inside, CASE WHEN NOT inside THEN 'out' ELSE CASE WHEN court_y < 23.77::DOUBLE / 3 THEN 'far_backcourt' WHEN court_y < 2 * 23.77::DOUBLE / 3 THEN 'midcourt' ELSE 'near_backcourt' END || CASE WHEN court_x < 8.23::DOUBLE / 2 THEN '_left' ELSE '_right' END END AS zone FROM i""",
    "solved_calibrations": f"""WITH {TRACKS_SQL}, m AS (SELECT v, {_VIEW_SQL.format(x="500", y="333")} FROM (SELECT DISTINCT track_id AS v FROM tracks))
      SELECT CAST(v AS VARCHAR) AS calibration_id, 6 AS points, round(px, 3) AS court_x, round(py, 3) AS court_y, v % 4 <> 1 AS accepted FROM m""",
    "prepared_features": """WITH r AS (SELECT l_orderkey * 8 + l_linenumber AS key, l_returnflag AS shot_type, l_quantity, l_extendedprice, l_discount FROM lineitem),
      m AS (SELECT key, shot_type, CASE WHEN key % 5 > 0 THEN l_quantity END AS a, l_extendedprice AS b, CASE WHEN key % 3 = 1 THEN l_discount END AS d FROM r),
      f AS (SELECT key, shot_type, coalesce(a, quantile_disc(a, 0.5) OVER ()) AS a, b, coalesce(d, quantile_disc(d, 0.5) OVER ()) AS d FROM m),
      s AS (SELECT avg(a) AS ma, stddev_samp(a) AS sa, avg(b) AS mb, stddev_samp(b) AS sb, avg(d) AS md, stddev_samp(d) AS sd FROM f)
      SELECT key, shot_type, round((a - ma) / sa, 6) AS duration_seconds, round((b - mb) / sb, 6) AS start_x, round((d - md) / sd, 6) AS start_y, 0.0::DOUBLE AS delta_x FROM f, s""",
}
