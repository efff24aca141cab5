"""Pictures: blobs, lines, changes and tracks by hand."""

import math

import numpy as np
import pytest

from rallyframe.config import AssociationConfig, LineConfig
from rallyframe.operators import hough, pixels, rasters, trackers
from rallyframe.operators import detections as D
from rallyframe.plans import tracker_queries
from rallyframe.sources.shared import Shared

YELLOW, BLACK, WHITE = (60, 220, 200), (0, 0, 0), (230, 230, 230)


def picture(*lines, colour=YELLOW):
    """A frame from lines of text: # is lit."""
    return np.array([[colour if ch == "#" else BLACK for ch in line] for line in lines], np.uint8)


def frames_of(spark, *pictures, video=0):
    rows = [(video, k, bytearray(p.tobytes()), *p.shape[:2]) for k, p in enumerate(pictures)]
    return spark.createDataFrame(rows, "video_id long, frame_number long, data binary, height long, width long")


def outlines(spark, *pictures):
    found = rasters.blobs(rasters.lit_runs(frames_of(spark, *pictures), rasters.yellow()), Shared(spark)).collect()
    return sorted((r.frame_number, r.x1, r.y1, r.x2, r.y2, r.area, round(r.perimeter, 4), r.euler) for r in found)


def test_outlines(spark):
    root = math.sqrt(2)
    disc = picture("..###..", ".#####.", "#######", "#######", "#######", ".#####.", "..###..")
    ring = picture("#####", "#...#", "#.#.#", "#...#", "#####")  # what lies in a hole is no blob of its own
    pair = picture("##...", "##...", "..#..", "...#.")  # one by corners
    dots = picture("#.#", "...", "#.#")
    comb = picture("#.#.#", "#####", ".....")
    assert outlines(spark, disc, ring, pair, dots, comb) == [
        (0, 0, 0, 6, 6, 28.0, round(8 + 8 * root, 4), 1),
        (1, 0, 0, 4, 4, 16.0, 16.0, 1),
        (2, 0, 0, 3, 3, 1.0, round(4 + 4 * root, 4), 1),
        (3, 0, 0, 0, 0, 0.0, 0.0, 1), (3, 0, 2, 0, 2, 0.0, 0.0, 1), (3, 2, 0, 2, 0, 0.0, 0.0, 1), (3, 2, 2, 2, 2, 0.0, 0.0, 1),
        (4, 0, 0, 4, 1, 2.0, round(4 + 4 * root + 2, 4), 1),
    ]


def test_opening_takes_specks_and_keeps_borders(spark):
    frame = picture("###....#", "###.....", "###..###", ".....###", "#....###")
    runs = rasters.opened(rasters.lit_runs(frames_of(spark, frame), rasters.yellow())).collect()
    # outside counts as lit for erosion: the speck in the lower corner has unlit neighbours inside
    assert sorted((r.y, r.a, r.b) for r in runs) == [(0, 0, 2), (1, 0, 2), (2, 0, 2), (2, 5, 7), (3, 5, 7), (4, 5, 7)]


def test_fallback_only_where_nothing_was_found(spark):
    square = picture(*["......."] * 2, *["..####."] * 4, ".......")
    frames = frames_of(spark, square, square)
    blobs = rasters.color_candidates(frames, Shared(spark))
    found = spark.createDataFrame([(0, 0, 1.0, 2.0, 0.9)], "video_id long, frame_number long, center_x double, center_y double, confidence double")
    both = sorted(map(tuple, D.with_fallback(found, blobs).select("frame_number", "source", "center_x", "center_y", "area", "circularity", "ranking_score").collect()))
    assert both == [(0, "detector", 1.0, 2.0, None, None, None), (1, "color_fallback", 4.0, 4.0, 9.0, round(4 * math.pi * 9 / 144, 4), round(4 * math.pi * 9 / 144, 4))]


def test_long_snake_is_one_blob(spark):
    """A component whose runs are linked in a chain as long as the picture."""
    n = 61
    lines = ["#" * n if y % 2 == 0 else ("." * (n - 1) + "#" if y % 4 == 1 else "#" + "." * (n - 1)) for y in range(n)]
    assert len(outlines(spark, picture(*lines))) == 1


def test_static_spots(spark):
    rng = np.random.default_rng(3)
    one = rng.integers(0, 255, (40, 60, 3), dtype=np.uint8)
    two = one.copy()
    two[:, 30:] = rng.integers(0, 255, (40, 30, 3), dtype=np.uint8)
    spots = [(0, f, k, x, y) for f in (0, 1, 2) for k, (x, y) in enumerate([(12.0, 20.0), (48.0, 20.0), (0.0, 0.0), (-30.0, 5.0), (30.0, 39.5)])]
    df = spark.createDataFrame(spots, "video_id long, frame_number long, id long, x double, y double")
    got = {(r.frame_number, r.id): (r.mean_difference, r.is_static) for r in pixels.with_static(df, frames_of(spark, one, two)).collect()}
    assert [got[0, k] for k in range(5)] == [(None, False)] * 5 == [got[2, k] for k in range(5)]  # no frame before; no frame
    assert got[1, 0] == (0.0, True) and got[1, 3] == (None, False) and got[1, 2] == (0.0, True)
    change = np.abs(pixels.whole_gray(one) - pixels.whole_gray(two))
    for k, (x, y) in ((1, (48, 20)), (4, (30, 39.5))):
        box = change[max(0, int(y - 10)) : min(40, int(y + 10)), max(0, int(x - 10)) : min(60, int(x + 10))]
        assert math.isclose(got[1, k][0], box.mean()) and not got[1, k][1]


def test_lines_by_votes(spark):
    points = [(0, 0, x, 20) for x in range(5, 100)] + [(0, 0, 50, y) for y in range(0, 90) if y != 20] + [(0, 0, x, 150 - x) for x in range(60, 140)] + [(0, 0, 7, 77)]
    points += [(0, 0, x, 110) for x in [*range(0, 40), *range(70, 110)]]  # a gap parts it
    df = spark.createDataFrame(points, "video_id long, frame_number long, x long, y long")
    got = [tuple(r)[2:8] for r in hough.segments(df, LineConfig(votes=35, minimum_length=30, maximum_gap=15)).orderBy("line_id").collect()]
    ends = {frozenset(((a, b), (c, d))) for _, a, b, c, d, _ in got}
    for line in (((5, 20), (99, 20)), ((50, 0), (50, 89)), ((0, 110), (39, 110)), ((70, 110), (109, 110))):
        assert frozenset(line) in ends
    assert any(abs(a + b - 150) <= 1 and abs(c + d - 150) <= 1 and n >= 78 for _, a, b, c, d, n in got)
    assert len(got) == 5 and [g[0] for g in got] == [1, 2, 3, 4, 5]
    angles = D.lines(hough.segments(df, LineConfig(votes=35, minimum_length=30, maximum_gap=15))).select("orientation").collect()
    assert sorted(r[0] for r in angles) == ["diagonal", "horizontal", "horizontal", "horizontal", "vertical"]


def walk(*paths, lost=()):
    """Boxes of 40 by 80 whose left edge is a path's place in each frame; lost: (frame, path) that aren't seen."""
    return [(0, f, k, 0.9 - 0.1 * k, float(x), 10.0, float(x + 40), 90.0) for k, path in enumerate(paths) for f, x in enumerate(path) if (f, k) not in lost]


BOX = "video_id long, frame_number long, id long, confidence double, x1 double, y1 double, x2 double, y2 double"


def test_crossing_players_keep_their_tracks(spark):
    right, left = [10 * f for f in range(30)], [290 - 10 * f for f in range(30)]
    rows = walk(right, left, lost={(14, 0), (15, 0), (14, 1)})
    got = trackers.person_tracks(spark.createDataFrame(rows, BOX)).collect()
    assert {(r.id, r.track_id) for r in got} == {(0, 1), (1, 2)} and len(got) == len(rows)


def test_low_confidence_continues_a_track_but_starts_none(spark):
    rows = [(0, f, k, c, x, 0.0, x + 40, 80.0) for f, seen in enumerate([[(0, 0.9, 5.0)], [(0, 0.15, 8.0), (1, 0.2, 300.0)], [(0, 0.05, 9.0)], [(0, 0.15, 9.0)], [(0, 0.9, 9.0)]]) for k, c, x in seen]
    got = sorted((r.frame_number, r.id, r.track_id) for r in trackers.person_tracks(spark.createDataFrame(rows, BOX)).collect())
    # a track lost for a frame is found again by a confident box alone
    assert got == [(0, 0, 1), (1, 0, 1), (4, 0, 1)]


def test_forgotten_tracks_get_new_ids(spark):
    rows = [(0, f, 0, 0.9, 0.0, 0.0, 40.0, 80.0) for f in (0, 1, 31, 62, 93)]
    got = [r.track_id for r in trackers.person_tracks(spark.createDataFrame(rows, BOX)).orderBy("frame_number").collect()]
    assert got == [1, 1, 1, 2, 3]
    with pytest.raises(ValueError):
        AssociationConfig(high_confidence=0.1, low_confidence=0.2)


def test_tracks_of_the_table_are_worth_following(spark):
    found = tracker_queries.person_tracks(spark, "/root/testdata/sf0.01").groupBy("video_id", "track_id").count()
    assert found.where("count > 10").count() > 20


def test_a_frame_is_never_of_the_wrong_size(spark):
    wrong = spark.createDataFrame([(0, 0, bytearray(b"123"), 2, 2)], "video_id long, frame_number long, data binary, height long, width long")
    with pytest.raises(Exception, match="bytes"):
        rasters.lit_runs(wrong, rasters.yellow()).collect()
