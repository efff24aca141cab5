"""State of streams over restarts, its end, late rows, repeated batches."""

import pytest
from pyspark.sql import functions as F

from rallyframe.operators import scoring, trackers
from rallyframe.plans.detection_queries import points
from rallyframe.plans.tracker_queries import ball_frames, people_frames
from rallyframe.streaming import delivery, stateful


@pytest.fixture(autouse=True)
def few_stores(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


POINTS = "match_id long, point_number long, winner string"


def fed(spark, path, schema, *parts):
    """A stream that takes one file a batch, and the function that adds one."""

    def add(part):
        n = add.count = add.count + 1
        (part if hasattr(part, "columns") else spark.createDataFrame(part, schema)).coalesce(1).write.parquet(f"{path}/{n:04d}")

    add.count = 0
    for part in parts:
        add(part)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(path)), add


def run(stream, out, checkpoint):
    stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out)).awaitTermination(300)
    return stream.sparkSession.read.parquet(str(out))


def same(got, want):
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(tuple, want.collect())))


@pytest.mark.parametrize("tracker, make", [(trackers.SmoothedBall, ball_frames), (trackers.SegmentedBall, ball_frames), (trackers.StableLabels, people_frames), (trackers.ZonePlayer, people_frames), (trackers.CourtPlayers, people_frames)])
def test_trackers_go_on_after_a_restart(spark, tmp_path, tracker, make):
    frames = make(spark, "/root/testdata/sf0.001").where("frame_number < 90").cache()
    stream, add = fed(spark, tmp_path / "in", frames.schema, frames.where("frame_number < 20"), frames.where("frame_number BETWEEN 20 AND 44"))
    tracked = lambda: stateful.stream_tracked(stream, tracker, tracker.schema)
    run(tracked(), tmp_path / "out", tmp_path / "check")
    add(frames.where("frame_number >= 45"))
    add(frames.where("frame_number < 3"))
    found = run(tracked(), tmp_path / "out", tmp_path / "check")
    assert found.where("late").count() == frames.where("frame_number < 3").count()
    same(found.where("NOT late").drop("late"), trackers.folded(frames, tracker, tracker.schema))


def test_scores_go_on_after_a_restart(spark, tmp_path):
    games = points(spark, "/root/testdata/sf0.001", "track_id % 3").cache()
    stream, add = fed(spark, tmp_path / "in", games.schema, games.where("point_number < 60"))
    run(stateful.stream_scores(stream), tmp_path / "out", tmp_path / "check")
    add(games.where("point_number BETWEEN 60 AND 99"))
    add(games.where("point_number >= 100"))
    same(run(stateful.stream_scores(stream), tmp_path / "out", tmp_path / "check"), scoring.scoreboard(games))


def test_event_time_ends_a_match(spark, tmp_path):
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000 + s))
    part = lambda *rows: spark.createDataFrame([(m, n, w) for m, n, w, _ in rows], POINTS).withColumn("event_time", at(0) + F.make_dt_interval(secs=F.element_at(F.create_map(*[F.lit(x) for m, n, _, s in rows for x in (m * 1000 + n, s)]), F.col("match_id") * 1000 + F.col("point_number"))))
    stream, _ = fed(
        spark, tmp_path / "in", part((1, 1, "A", 0)).schema,
        part((1, 1, "A", 0), (1, 2, "A", 5)),
        part((2, 1, "B", 200)),  # the watermark passes match 1's timer
        part((2, 2, "B", 210)),
        part((1, 3, "A", 205), (2, 3, "B", 211)),  # match 1 begins anew; its number is no longer late
        part((2, 4, "B", 212)),
    )
    board = run(stateful.stream_scores(stream.withWatermark("event_time", "10 seconds"), idle="60 seconds"), tmp_path / "out", tmp_path / "check")
    rows = {(r.match_id, r.point_number): (r.points_a, r.points_b, r.games_b) for r in board.collect()}
    assert rows[1, 2] == (2, 0, 0) and rows[1, 3] == (1, 0, 0)
    assert rows[2, 4] == (0, 0, 1)


def test_lengths_of_time():
    assert stateful.milliseconds("1 day") == 86_400_000 and stateful.milliseconds("1.5 minutes") == 90_000
    for bad in ("1 fortnight", "day", ""):
        with pytest.raises(ValueError):
            stateful.milliseconds(bad)


def test_listeners_hear_their_events_once(spark, tmp_path):
    games = points(spark, "/root/testdata/sf0.001", "track_id % 3").cache()
    stream, add = fed(spark, tmp_path / "in", games.schema, games.where("point_number < 40"), games.where("point_number BETWEEN 40 AND 79"))
    counters = delivery.Counters()
    spark.streams.addListener(counters)
    fails = [1]

    def broken(rows, batch):
        if batch == 1 and fails:
            fails.pop()
            raise RuntimeError("the other side is away")

    def start():
        board = delivery.counted(stateful.stream_scores(stream), "scores", points=F.count("*"), rejected=F.count_if(F.col("rejected")))
        keep = lambda name: delivery.written_once(str(tmp_path / name))
        return delivery.delivered(stateful.score_events(board), {"game": [keep("games")], "*": [keep("all"), broken]}, str(tmp_path / "check"))

    with pytest.raises(Exception, match="away"):
        start().awaitTermination(300)
    start().awaitTermination(300)  # batch 1 comes again, whole
    add(games.where("point_number >= 80"))
    start().awaitTermination(300)
    want = stateful.score_events(scoring.scoreboard(games))
    same(spark.read.parquet(str(tmp_path / "all")).drop("batch"), want)
    same(spark.read.parquet(str(tmp_path / "games")).drop("batch"), want.where("event = 'game'"))
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert counters.totals()["scores"]["points"] == games.count() and len(counters.ended) == 3
    spark.streams.removeListener(counters)
    with pytest.raises(ValueError):
        delivery.delivered(stateful.score_events(stateful.stream_scores(stream)), {" ": []}, str(tmp_path / "other"))


def test_a_batch_that_comes_again_adds_nothing(spark, tmp_path):
    write = delivery.written_once(str(tmp_path / "out"))
    rows = spark.range(5)
    for batch in (0, 1, 1, 0):
        write(rows, batch)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 10


def test_state_has_readable_columns(spark, tmp_path):
    stream, _ = fed(spark, tmp_path / "in", POINTS, [(7, 1, "A"), (7, 2, "A"), (7, 3, "B")])
    run(stateful.stream_scores(stream), tmp_path / "out", tmp_path / "check")
    state = spark.read.format("statestore").option("stateVarName", "score").load(str(tmp_path / "check")).first()
    assert (state.key.match_id, state.value.points_a, state.value.points_b, state.value.last_point) == (7, 2, 1, 3)
