"""Known results on small inputs."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rallyframe import config
from rallyframe.functions import geometry as G
from rallyframe.operators import classifier, court, detections, homography, metrics, pixels, scoring, shots, speed, trackers, trajectory, videos
from rallyframe.plans import catalogue
from rallyframe.plans.detection_queries import points as match_points
from rallyframe.plans.track_queries import AFFINE
from rallyframe.sources import sinks, tracks
from rallyframe.streaming import live, stateful

POINT = "track_id long, frame_number long, timestamp_seconds double, x double, y double, predicted boolean"


def track(spark, rows, predicted=()):
    return spark.createDataFrame([(1, f, float(t), float(x), float(y), f in predicted) for f, t, x, y in rows], POINT)


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_vectors(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    assert value(spark, G.distance(*lit(0, 0, 3, 4))) == 5
    assert value(spark, G.wrapped_difference(*lit(170, -170))) == 20
    assert value(spark, G.direction_change(*lit(1, 0, 0, 1))) == 90
    assert value(spark, G.direction_change(*lit(0, 0, 0, 1))) == 0
    assert value(spark, G.direction_change(*lit(1e-3, 1e-3, 7, 7))) == 0
    assert value(spark, G.velocity(F.lit(5.0), F.lit(0.0), 0.001)) == 0
    assert value(spark, G.kmh(*lit(10, 1), 0.001, 0.01, 300)) == 36
    assert value(spark, G.kmh(*lit(100, 0.1), 0.001, 0.01, 300)) == 0
    assert value(spark, G.kmh(*lit(20, 0.1), 0.001, 0.01, 40)) == 0
    assert value(spark, G.project(((1, 0, 0), (0, 1, 0), (1, 0, 0)), *lit(0, 5))[0]) is None


def test_bounce(spark):
    v = track(spark, [(1, 0, 100, 100), (2, 0.1, 110, 130), (3, 0.2, 120, 100)])
    row = trajectory.motion_windows(v).first()
    assert row.vertical_reversal and row.bounce_score > 0 and row.is_candidate
    assert trajectory.motion_windows(v.limit(2)).count() == 0 == trajectory.bounce_candidates(v.limit(0)).count()
    some = spark.createDataFrame([(1, 10, 0.6), (1, 12, 0.9), (1, 30, 0.8)], "track_id long, frame_number long, bounce_score double")
    assert [r.frame_number for r in trajectory.deduplicated(some).orderBy("frame_number").collect()] == [12, 30]
    with pytest.raises(ValueError):
        config.BounceConfig(score_threshold=2)


def test_calls(spark):
    at = [(4, 10, 0.9), (9, 10, 0.9), (-0.02, 10, 0.9), (4, 10, 0.2)]
    identity = ((1, 0, 0), (0, 1, 0), (0, 0, 1))
    df = spark.createDataFrame([(float(x), float(y), s) for x, y, s in at], "x double, y double, bounce_score double")
    calls = court.line_calls(df, identity).collect()
    assert [r.call for r in calls] == ["IN", "OUT", "IN", "IN"]
    assert calls[2].near_line and calls[2].zone == "out" and calls[2].nearest == "left" and not calls[3].accepted
    s = court.call_summary(court.line_calls(df.limit(3), identity)).first()
    assert (s.bounces, s.accepted, s.calls_in, s.calls_out, s.near_line) == (3, 3, 2, 1, 1)
    corner = court.mapped(spark.createDataFrame([(300.0, 400.0)], "x double, y double"), AFFINE).first()
    assert corner.inside and (corner.court_x, corner.court_y) == (4.115, 11.885)
    names = dict((n, (x, y)) for n, x, y in G.keypoints(config.CourtConfig()))
    assert len(names) == 18 and math.isclose(names["far_service_center"][1], 11.885 - 6.4)


def test_speed(spark):
    identity = ((1, 0, 0), (0, 1, 0), (0, 0, 1))
    rows = speed.ball_speed(track(spark, [(0, 0, 0, 0), (1, 1, 10, 0), (2, 2, 99, 0), (3, 3, 30, 0)], predicted={2}), identity).orderBy("frame_number").collect()
    assert [r.speed_kmh for r in rows] == [0, 36, 0, 36] and rows[3].total_distance == 30 and rows[2].smoothed_kmh == 36


def test_rallies_and_shots(spark):
    two = track(spark, [(i, i * 0.1, 100 + 10 * i, 100 + 10 * i) for i in range(4)] + [(40 + i, 3 + i * 0.1, 100 + 10 * i, 100 + 10 * i) for i in range(4)])
    points = shots.rallies(two)
    assert points.agg(F.max("rally_id")).first()[0] == 2
    turn = track(spark, [(i, i * 0.1, x, y) for i, (x, y) in enumerate([(0, 0), (10, 0), (20, 0), (20, 20), (20, 30)])])
    rows = shots.shot_points(shots.rallies(turn))
    assert [r.frame_number for r in rows.orderBy("shot_in_rally", "place").collect()] == [0, 1, 2, 2, 3, 4]
    half = shots.shot_features(shots.shot_points(shots.rallies(track(spark, [(i, i * 0.1, 10 * i, 0) for i in range(4)], predicted={1, 2})))).first()
    assert half.predicted_point_ratio == 0.5 and half.average_speed_pixels_per_second == 100
    assert [(r.start_time, r.trajectory_points, r.shot_count) for r in shots.rally_summary(points).orderBy("rally_id").collect()] == [(0.0, 4, 1), (3.0, 4, 1)]
    assert shots.shot_points(shots.rallies(two.limit(0))).count() == 0


def board(spark, winners, **settings):
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(winners, 1)], "match_id long, point_number long, winner string")
    return scoring.displayed(scoring.scoreboard(df, config.ScoringConfig(**settings))).orderBy("point_number").collect()


def test_scoring(spark):
    deuce = board(spark, "AAABBBABAA")
    assert [r.status for r in deuce[5:9]] == ["DEUCE", "ADVANTAGE", "DEUCE", "ADVANTAGE"] and deuce[6].show_a == "AD" and deuce[9].games_a == 1
    tie = board(spark, "AAAABBBB" * 6 + "AAAAAAB" + "A")
    assert tie[47].in_tiebreak and tie[48].show_a == "1" and tie[-1].sets_a == 1 and tie[-1].games_a == 0
    assert tie[-1].events == "point,set" and tie[49].events == ""
    over = board(spark, "A" * 50)
    assert over[47].match_winner == "A" and over[47].events == "game,set,match,point" and over[48].rejected and over[48].sets_a == 2
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate("ABA", 1)], "match_id long, point_number long, winner string")
    s = scoring.match_statistics(scoring.scoreboard(df)).first()
    assert (s.total_points, s.won_a, s.won_b, s.points_leader, s.win_rate_a) == (3, 2, 1, "A", 66.67)


def test_trackers():
    ball = trackers.SmoothedBall()
    ball.at, ball.time, ball.v = (100.0, 100.0), 0.0, (20.0, 10.0)
    assert ball.predicted(1.0) == (120.0, 110.0)
    near, far = ({"x": x, "y": y, "score": s} for x, y, s in ((105, 100, 0.7), (400, 400, 0.99)))
    assert ball.chosen((100, 100), [far, near]) is near and ball.chosen(None, [far, near]) is far
    lost = trackers.SmoothedBall()
    lost.step(0.0, [near])
    assert [lost.step(0.1 * i, [])[4] for i in range(1, 10)] == ["predicted"] * 8 + ["lost"]


def test_kalman_is_the_planar_filter():
    f, p, s = trackers.KalmanBall(), np.eye(4) * 1000, np.zeros(4)
    rng, first = np.random.default_rng(1), True
    for t in range(20):
        z = np.array([100 + 9 * t, 50 + 4 * t]) + rng.normal(0, 2, 2)
        if first:
            s[:2], first = z, False
        else:
            m = np.eye(4) + np.diag([0.1, 0.1], 2)
            s, p = m @ s, m @ p @ m.T + np.diag([10, 10, 100, 100])
            k = p[:, :2] @ np.linalg.inv(p[:2, :2] + np.eye(2) * 25)
            s, p = s + k @ (z - s[:2]), p - k @ p[:2]
        out = f.step(t * 0.1, [{"x": z[0], "y": z[1], "confidence": 0.9}])
        assert np.allclose(out[:4], s, atol=1e-3)


def test_folds_do_not_depend_on_row_order(spark):
    frames = catalogue.QUERIES["smoothed_ball"](spark, "/root/testdata/sf0.001").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = catalogue.QUERIES["smoothed_ball"](spark, "/root/testdata/sf0.001").collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(map(str, frames)) == sorted(map(str, again))


def test_homography(spark):
    h = np.array([[0.02, 0.001, -2], [0.0005, 0.04, -4], [0.00001, 0.0008, 1]])
    image = np.random.default_rng(3).uniform(50, 900, (12, 2))
    p = np.c_[image, np.ones(12)] @ h.T
    real = p[:, :2] / p[:, 2:]
    assert np.allclose(homography.solve(image[:4], real[:4]), h, atol=1e-6) and np.allclose(homography.solve(image, real), h, atol=1e-6)
    real[3] += 40
    good, ok = homography.solve_robust(image, real, 0.5)
    assert np.allclose(good, h, atol=1e-5) and not ok[3] and ok.sum() == 11
    keys = [(c, f"p{i}", *map(float, image[i])) for c in "ab" for i in range(12 if c == "a" else 3)]
    out = {r.calibration_id: r for r in homography.calibrate(spark.createDataFrame(keys, "calibration_id string, name string, x double, y double"), spark.createDataFrame([(f"p{i}", *map(float, real[i])) for i in range(12)], "name string, court_x double, court_y double"), 5.0, tolerance=0.5).collect()}
    assert out["a"].accepted and out["b"].homography is None and not out["b"].accepted


def test_classifier(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, k, float(rng.normal(m, 1)), float(rng.normal(-m, 1)) if i % 9 else None) for m, k in ((0, "forehand"), (6, "drop"), (12, "serve")) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, shot_type string, average_speed_pixels_per_second double, duration_seconds double")
    model, scores = classifier.train(df, "id", chosen=("logistic_regression", "random_forest"))
    assert all(r.macro_f1 > 0.9 for r in scores.collect())
    classifier.save(model, scores, str(tmp_path / "saved"))
    again, about = classifier.load(spark, str(tmp_path / "saved"))
    assert about["model_name"] in ("logistic_regression", "random_forest") and about["feature_columns"] == ["duration_seconds", "average_speed_pixels_per_second"]
    with pytest.raises(ValueError, match="no model"):
        classifier.load(spark, str(tmp_path / "nowhere"))
    spark.createDataFrame([("x",)], "model_name string").write.mode("overwrite").json(str(tmp_path / "saved" / "about"))
    with pytest.raises(ValueError, match="feature_columns"):
        classifier.load(spark, str(tmp_path / "saved"))
    got = classifier.predict(again, spark.createDataFrame([(12.0,)], "average_speed_pixels_per_second double")).first()
    assert got.predicted == "serve" and math.isclose(sum(got.probabilities.values()), 1, abs_tol=1e-3)
    with pytest.raises(ValueError):
        classifier.prepare(df.limit(5))
    split = classifier.stratified_split(df, "shot_type", "id").groupBy("shot_type").agg(F.count_if("is_test").alias("n")).collect()
    assert {r.n for r in split} == {12}


def test_dataset_columns(spark):
    header = ["shot_type", "video", *classifier.FEATURES]
    df = spark.createDataFrame([("drop" if i % 2 else "serve", "v", *[float(i)] * 17) for i in range(20)], header)
    ready, known = classifier.prepare(df)
    assert len(known) == 17 and ready.columns == ["label", *classifier.FEATURES]
    assert {(r.column, r.role) for r in classifier.column_roles(df).where("role <> 'feature'").collect()} == {("shot_type", "label"), ("video", "unknown")}
    assert set(shots.shot_features(shots.shot_points(shots.rallies(track(spark, [])))).columns) >= set(classifier.FEATURES)


def test_static_candidates_lose(spark):
    still, moving = ({"x": x, "y": 5.0, "confidence": 0.9, "score": s, "is_static": f} for x, s, f in ((5.0, 0.9, True), (9.0, 0.5, False)))
    assert trackers.SegmentedBall().step(0.0, [still, moving])[0] == 9.0
    assert trackers.SegmentedBall().step(0.0, [still])[3] == "LOST"


def test_player_folds():
    people = lambda *rows: [{"id": i, "x": x, "y": y, "confidence": k, "score": a} for i, x, y, k, a in rows]
    labels = trackers.StableLabels()
    assert labels.step(0, people((7, 0, 50, 1, 1), (3, 0, 9, 1, 1)))[0] == [("3", "Player A"), ("7", "Player B")]
    assert labels.step(1, people((7, 0, 5, 1, 1), (8, 0, 9, 1, 1), (3, 0, 99, 1, 1)))[0] == [("7", "Player B"), ("8", "Player A"), ("3", "Track 3")]
    zone = trackers.ZonePlayer(most=1)
    assert zone.step(0, people((1, 10, 10, 0.5, 1)))[3] == "only_candidate"
    assert zone.step(1, people((2, 900, 900, 0.9, 4), (1, 12, 12, 0.5, 1)))[0] == 1
    zone.step(2, [])
    zone.step(3, [])
    assert zone.step(4, people((2, 900, 900, 0.9, 4), (1, 12, 12, 0.5, 1)))[0] == 2
    pair = trackers.CourtPlayers()
    assert pair.step(0, people((4, 0, 20, 1, 1), (5, 0, 3, 1, 1))) == (4, 5)
    assert pair.step(1, people((5, 0, 22, 1, 1))) == (None, 5)
    assert pair.step(2, people((9, 0, 12, 1, 1), (4, 0, 2, 0.1, 1), (5, 0, 3, 0.1, 1))) == (5, 4)


def test_folds_carry_their_state_over_batches(spark):
    winners = "".join("AB"[(i * 7 // 3) % 2] for i in range(3000))
    df = spark.createDataFrame([(1, i, w) for i, w in enumerate(winners, 1)] + [(2, 1, "A")], "match_id long, point_number long, winner string")
    real = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = scoring.scoreboard(df).where("match_id = 1").orderBy("point_number").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", real)
    score = scoring.Score(config.ScoringConfig())
    for r in got:
        events = score.award("AB".index(r.winner))
        assert r.rejected == (events is None) and (r.points_a, r.games_b, r.sets_a) == (score.points[0], score.games[1], score.sets[0])
    assert len(got) == 3000


def test_classifier_sizes():
    made = classifier.models()
    forest, boosted = made["random_forest"], made["gradient_boosting"].getClassifier()
    assert (made["logistic_regression"].getMaxIter(), forest.getNumTrees(), forest.getMaxDepth(), boosted.getMaxIter()) == (2000, 250, 30, 150)
    assert classifier.models(trees=3)["random_forest"].getNumTrees() == 3


def test_pixels(spark):
    yellow = np.zeros((20, 30, 3), np.uint8)
    yellow[:, :15] = (0, 255, 230)
    flat = np.full((20, 30, 3), 30, np.uint8)
    df = spark.createDataFrame([(0, i, bytearray(x.tobytes()), 20, 30, 0.0, 0.0, 30.0, 20.0) for i, x in enumerate((yellow, flat))], "video_id long, frame_number long, data binary, height int, width int, x1 double, y1 double, x2 double, y2 double")
    rows = detections.quality_flags(pixels.measured(df)).withColumn("yellow", pixels.color_score()).orderBy("frame_number").collect()
    assert rows[0].yellow == 0.5 and rows[1].yellow == 0 and rows[1].issues == ["dark", "blurry"] and rows[1].brightness == 30 and rows[0].sharpness > 80
    found = pixels.detected(df, lambda: lambda image: [(float(image.mean()),)], "mean double")
    assert found.count() == 2
    with pytest.raises(ValueError):
        pixels.image_of(b"", 0, 0)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"trajectory": [{"frame_number": 1, "timestamp_seconds": 0.1, "x": 1.0, "y": 2.0}]}))
    assert tracks.load_trajectory(spark, str(tmp_path / "t.json")).first().predicted is False
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(Exception, match="no trajectory"):
        tracks.load_trajectory(spark, str(tmp_path / "bad.json")).collect()
    clips = spark.createDataFrame([(1, 3, 9, 5, "shot_0001")], "track_id long, clip_start long, clip_end long, center_frame long, clip_id string")
    sinks.write_features(sinks.annotation_template(clips, 25.0), str(tmp_path / "notes"))
    notes = tracks.load_annotations(spark, str(tmp_path / "notes"))
    assert notes.first().label == "unlabeled" and sinks.existing_clips(notes, spark.createDataFrame([("x",)], "shot_id string")).count() == 0
    (tmp_path / "v.MP4").write_bytes(b"x")
    (tmp_path / "v.txt").write_bytes(b"x")
    assert {r.extension: r.acceptable for r in tracks.video_files(spark, str(tmp_path / "v.*")).collect()} == {"mp4": True, "txt": False}
    bad = spark.createDataFrame([("a", False)], "calibration_id string, accepted boolean")
    with pytest.raises(Exception, match="not accepted"):
        sinks.write_calibrations(bad, str(tmp_path / "cal"))
    docs = spark.createDataFrame([(1, 2, ["a"])], "video_id long, frame_number long, players array<string>")
    sinks.write_frame_documents(docs, str(tmp_path / "docs"))
    assert spark.read.json(str(tmp_path / "docs")).first().frame_number == 2
    (tmp_path / "none.csv").write_text("a,b\n")
    with pytest.raises(ValueError):
        tracks.load_dataset(spark, str(tmp_path / "none.csv"), "a string, b string")


def drained(stream, name, mode="append"):
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).start()
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)


def test_streams_match_batch(spark, tmp_path):
    two = track(spark, [(i, i * 0.1, 0, 0) for i in range(5)] + [(40 + i, 3 + i * 0.1, 0, 0) for i in range(4)] + [(900, 100, 0, 0)])
    path = str(tmp_path / "points")
    two.coalesce(1).write.parquet(path)
    source = spark.readStream.schema(two.schema).parquet(path)
    got = drained(live.stream_rallies(source), "rallies").orderBy("start_time").collect()
    assert [(r.start_time, r.trajectory_points) for r in got] == [(0, 5), (3, 4)]
    rates = drained(live.stream_detection_rate(spark.readStream.schema(two.schema).parquet(path)), "rates")
    assert rates.agg(F.max("points")).first()[0] == 9
    games = match_points(spark, "/root/testdata/sf0.001", "track_id % 3")
    live_scores = drained(stateful.stream_scores(spark.readStream.schema(games.schema).parquet(_written(games, tmp_path))), "scores").drop("events")
    assert sorted(map(tuple, live_scores.collect())) == sorted(map(tuple, scoring.scoreboard(games).drop("events").collect()))


def test_streamed_state(spark, tmp_path):
    from rallyframe.plans.tracker_queries import ball_frames

    frames = ball_frames(spark, "/root/testdata/sf0.001")
    half = frames.agg(F.expr("percentile_approx(frame_number, 0.5)")).first()[0]
    path = str(tmp_path / "frames")
    for i, part in enumerate((frames.where(f"frame_number <= {half}"), frames.where(f"frame_number > {half}"), frames.where("frame_number < 5"))):
        part.coalesce(1).write.mode("append").parquet(f"{path}/{i}")
    source = spark.readStream.schema(frames.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(path)
    for tracker in (trackers.KalmanBall,):
        got = drained(stateful.stream_tracked(source, tracker, tracker.schema), tracker.__name__).where("NOT late").drop("late").collect()
        want = trackers.folded(frames, tracker, tracker.schema).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    schema = "match_id long, point_number long, winner string"
    games = str(tmp_path / "late")
    spark.createDataFrame([(1, 1, "A"), (1, 3, "A")], schema).coalesce(1).write.parquet(f"{games}/0")
    spark.createDataFrame([(1, 2, "B"), (1, 4, "B")], schema).coalesce(1).write.parquet(f"{games}/1")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(games)
    stateful.stream_scores(stream, idle="30 seconds").writeStream.format("memory").queryName("late_points").trigger(availableNow=True).start().awaitTermination(120)
    rows = {r.point_number: r for r in spark.table("late_points").collect()}
    assert rows[2].rejected and rows[2].events == "late" and (rows[4].points_a, rows[4].points_b) == (2, 1)
    assert stateful.milliseconds("1.5 minutes") == 90_000


def _written(df, tmp_path):
    df.coalesce(1).write.parquet(str(tmp_path / "games"))
    return str(tmp_path / "games")


def test_metrics(spark):
    df = spark.createDataFrame(pd.DataFrame({"label": list("aabbc"), "prediction": list("abbbb")}))
    m = {r["class"]: r for r in metrics.class_report(df).collect()}
    assert m["a"].precision == 1 and m["a"].recall == 0.5 and m["c"].f1 == 0 and m["b"].precision == 0.5
    assert metrics.model_scores(df).first().accuracy == 0.6


def test_pixels_of_whole_frames(spark):
    gray_, white, colour = (np.full((9, 16, 3), v, np.uint8) for v in (50, 250, (10, 20, 200)))
    white[:, 8:] = 20
    rows = [(1, f, bytearray(x.tobytes()), 9, 16) for f, x in ((0, gray_), (10, white), (30, white), (90, colour))]
    df = spark.createDataFrame(rows, "video_id long, frame_number long, data binary, height int, width int")
    diff = {r.frame_number: r.difference for r in pixels.frame_differences(df).collect()}
    assert diff == {30: (200 + 30) / 2, 90: (8 * (250 - 73) + 8 * (73 - 20)) / 16}
    assert pixels.camera_motion(pixels.frame_differences(df)).first().camera == "MOVING"
    assert [r.p for r in df.select(pixels.white_percent().alias("p"), "frame_number").orderBy("frame_number").collect()] == [0, 50, 50, 0]
    out = pixels.model_input(df.where("frame_number = 90"), 32, 32).first().tensor
    tensor = np.frombuffer(out, np.float32).reshape(3, 32, 32)
    assert np.allclose(tensor[:, 16, 16], np.array([200, 20, 10]) / 255) and np.allclose(tensor[:, 0, 0], 114 / 255) and tensor[0, 6, 0] < 0.5 < tensor[0, 7, 0]
    ramp = np.repeat(np.arange(0, 160, 10, dtype=np.uint8)[None, :, None], 9, axis=0).repeat(3, axis=2)
    assert pixels.scaled(ramp, 9, 32)[0, :4, 0].tolist() == [0, 3, 8, 13]


def test_calibration_files(spark, tmp_path):
    points = [{"name": "a", "image_coords": [1.0, 2.0], "court_coords": [0.0, 5.0]}]
    (tmp_path / "list.json").write_text(json.dumps({"keypoints": points, "homography_matrix": [[1.0, 0, 0], [0, 1, 0], [0, 0, 1]], "court_dimensions": {"type": "singles"}}))
    (tmp_path / "map.json").write_text(json.dumps({"calibration_id": "m", "keypoints": {"a": [1, 2], "b": [3, 4]}, "homography": [[1.0, 0, 0], [0, 1, 0], [0, 0, 1]]}))
    found = {(r.calibration_id, r.name, r.x, r.y, r.court_x, r.court_y) for r in tracks.load_keypoints(spark, str(tmp_path)).collect()}
    assert found == {("list", "a", 1.0, 2.0, 0.0, 5.0), ("m", "a", 1.0, 2.0, None, None), ("m", "b", 3.0, 4.0, None, None)}
    files = {r.calibration_id: r for r in tracks.load_calibration(spark, str(tmp_path)).collect()}
    assert files["list"].court_type == "singles" and files["list"].homography == files["m"].homography


def test_region(spark):
    corners = [(10.0, 10.0), (30.0, 10.0), (40.0, 50.0), (0.0, 50.0)]
    at = spark.createDataFrame([(x + 0.5, y + 0.5) for x in range(-8, 50) for y in range(0, 62)], "x double, y double")
    inside = lambda x, y: 10 <= y <= 50 and 10 - (y - 10) / 4 <= x <= 30 + (y - 10) / 4
    near = {(x, y) for x in range(-8, 50) for y in range(0, 62) if any(inside(x + i / 4, y + j / 4) for i in range(-12, 13) for j in range(-12, 13))}
    got = {(math.floor(r.x), math.floor(r.y)) for r in at.where(detections.in_region(F.col("x"), F.col("y"), corners, F.lit(3.0))).collect()}
    assert got == near


def test_refused_videos(spark):
    probe = lambda **k: spark.createDataFrame([tuple({"path": "/a/b.mp4", "bytes": 5, "fps": 25.0, "frame_count": 10, "width": 4, "height": 3, "fourcc": 1} .get(x) if x not in k else k[x] for x in ("path", "bytes", "fps", "frame_count", "width", "height", "fourcc"))], "path string, bytes long, fps double, frame_count long, width int, height int, fourcc long")
    assert videos.described(probe()).first().aspect_ratio == "4:3"
    for bad, said in (({"fps": 0.0}, "frame rate"), ({"frame_count": 0}, "no frames"), ({"height": 0}, "no size")):
        with pytest.raises(Exception, match=said):
            videos.described(probe(**bad)).collect()
    with pytest.raises(Exception, match="no first frame"):
        videos.first_frames(spark.createDataFrame([(1,)], "video_id long"), spark.createDataFrame([], "video_id long, frame_number long")).collect()
