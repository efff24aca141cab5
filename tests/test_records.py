"""As-of joins, calibration attempts, scoring without Python, documents: by hand."""

import random

import pytest

from rallyframe.config import ScoringConfig
from rallyframe.operators import asof, classifier, detections, overlay, scoring
from rallyframe.sources import sinks


def test_asof_join_by_brute_force(spark):
    rng = random.Random(11)
    keys = ["hot"] * 8 + ["a", "b", None]
    left = [(rng.choice(keys), rng.choice([None, *(rng.uniform(-30, 90) for _ in range(9))]), n) for n in range(800)]
    right = [(rng.choice(keys), float(rng.randrange(-40, 100)) if rng.random() > 0.05 else None, n, None if n % 9 == 0 else n * 2) for n in range(300)]
    left += [("hot", r[1], 1000 + n) for n, r in enumerate(right)]  # equal times
    ldf = spark.createDataFrame(left, "k string, t double, v long")
    rdf = spark.createDataFrame(right, "k string, t double, n long, v long")
    for tolerance in (None, 3.0):
        got = asof.asof_join(ldf.withColumnRenamed("v", "n2"), rdf.withColumnRenamed("v", "w"), "k", "t", ["w"], tolerance, slice_length=7.0, ties=["n"]).collect()
        assert len(got) == len(left)
        found = {r.n2: (r.matched_at, r.w) for r in got}
        for k, t, n in left:
            seen = [(rt, rn, rv) for rk, rt, rn, rv in right if None not in (k, t, rk, rt) and rk == k and rt <= t]
            best = max(seen, key=lambda s: s[:2], default=None)
            want = (None, None) if best is None or (tolerance is not None and t - best[0] > tolerance) else (best[0], best[2])
            assert found[n] == want, (k, t, n)
    assert asof.asof_join(ldf.limit(0), rdf.withColumnRenamed("v", "w"), "k", "t", ["w"]).count() == 0
    assert {r.w for r in asof.asof_join(ldf, rdf.limit(0).withColumnRenamed("v", "w"), "k", "t", ["w"]).collect()} == {None}


def test_a_hot_key_is_spread_over_its_slices(spark):
    left = spark.range(20_000).selectExpr("'hot' AS k", "CAST(id AS DOUBLE) AS t", "id")
    right = spark.range(0, 20_000, 100).selectExpr("'hot' AS k", "CAST(id AS DOUBLE) AS t", "id AS w")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = asof.asof_join(left, right, "k", "t", ["w"], slice_length=50.0)
        sizes = out.rdd.glom().map(len).collect()
        assert all(r.w == r.id // 100 * 100 for r in out.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(sizes) < 20_000 * 0.3


def test_calibration_attempts(spark):
    rows = [(1, f, 9) for f in (3, 10)] + [(1, 12, 2), (1, 15, 6), (1, 16, 8)]  # found at its second try
    rows += [(2, f, 5) for f in range(11, 60)]  # gives up at 51
    rows += [(3, 20, 1), (3, 60, 7)]  # the first beyond 50 still counts
    rows += [(4, 12, None), (4, 13, 9)]  # a failure ends it
    rows += [(5, 5, 9), (5, 120, 9)]  # nothing to try
    rows += [(6, 30, 1)]  # no end yet
    got = {r.video_id: (r.attempts, r.calibrated_at, r.ended_at) for r in detections.calibration_attempts(spark.createDataFrame(rows, "video_id long, frame_number long, lines long")).collect()}
    assert got == {1: (2, 15, 15), 2: (41, None, 51), 3: (2, 60, 60), 4: (1, None, 12), 5: (0, None, None), 6: (1, None, None)}


@pytest.mark.parametrize("config", [ScoringConfig(), ScoringConfig(games_to_win_set=2, tiebreak_trigger_games=2, tiebreak_points_to_win=3, sets_to_win_match=3), ScoringConfig(enable_tiebreak=False, sets_to_win_match=1)])
def test_scores_without_python_are_the_same(spark, config):
    rng = random.Random(4)
    rows = [(m, n, rng.choice("AB")) for m, size in enumerate((0, 1, 127, 128, 129, 700)) for n in range(size)]
    points = spark.createDataFrame(rows, "match_id long, point_number long, winner string")
    plain = scoring.scoreboard_by_chunks(points, config)
    assert sorted(map(str, map(tuple, plain.collect()))) == sorted(map(str, map(tuple, scoring.scoreboard(points, config).select(plain.columns).collect())))
    assert "Python" not in plain._jdf.queryExecution().executedPlan().toString() and "MapInArrow" not in plain._jdf.queryExecution().executedPlan().toString()


def test_template_brings_its_suggestion(spark):
    clips = spark.createDataFrame([("shot_0001", 1, 0, 8, 4, "player_b"), ("shot_0002", 1, 8, 16, 12, None)], "clip_id string, track_id long, clip_start long, clip_end long, center_frame long, suggested_player string")
    assert [r.suggested_player for r in sinks.annotation_template(clips, 4.0).orderBy("shot_id").collect()] == ["player_b", ""]
    assert [r.suggested_player for r in sinks.annotation_template(clips.drop("suggested_player"), 4.0).collect()] == ["", ""]


def test_documents_of_videos_without_frames(spark, tmp_path):
    videos = spark.createDataFrame([(1, "/v/1.mp4"), (2, "/v/2.mp4")], "video_id long, path string")
    labels = spark.createDataFrame([(1, 0, "7", "Player A"), (1, 5, "7", "Player B"), (1, 5, "9", "Player A")], "video_id long, frame_number long, track string, player_label string")
    docs = {r.video_id: r for r in overlay.player_documents(videos, labels).collect()}
    assert docs[1].track_to_player_label == {"7": "Player B", "9": "Player A"} and docs[1].processed_frames == 2
    assert docs[2].track_to_player_label == {} and docs[2].processed_frames == 0
    from pyspark.sql import functions as F

    frames = spark.createDataFrame([(1, 30), (1, 0)], "video_id long, frame_number long")
    meta = overlay.frames_metadata(frames, videos, F.lit(25.0))
    sinks.write_documents(meta, str(tmp_path / "meta"))
    back = {r.video_id: r for r in spark.read.json(str(tmp_path / "meta")).collect()}
    assert [f.frame_number for f in back[1].frames] == [0, 30] and back[1].frames[1].timestamp_seconds == 1.2 and back[2].total_extracted_frames == 0


def test_standardized(spark):
    df = spark.createDataFrame([(1.0, 5.0), (None, 5.0), (3.0, 5.0), (8.0, 5.0)], "duration_seconds double, point_count double")
    got = [tuple(r) for r in classifier.standardized(df, ["duration_seconds", "point_count"]).collect()]
    values = [1.0, 3.0, 3.0, 8.0]
    mean = sum(values) / 4
    dev = (sum((v - mean) ** 2 for v in values) / 3) ** 0.5
    assert [round(a, 9) for a, _ in got] == [round((v - mean) / dev, 9) for v in values] and {b for _, b in got} == {0.0}
