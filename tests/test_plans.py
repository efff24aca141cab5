"""How often rows are exchanged."""

import re

import pytest

from rallyframe.plans import catalogue

MOST = {
    "bounce_candidates": 1, "line_calls": 1, "ball_speed": 1, "player_motion": 1, "rallies": 1, "shot_points": 1, "rally_summary": 1, "scoreboard": 1, "overlay_rows": 1, "frame_documents": 1, "person_tracks": 1,
    "shot_features": 2, "detection_quality": 2, "kalman_ball": 2, "smoothed_ball": 2, "segmented_ball": 2,
}


@pytest.mark.parametrize("name", sorted(MOST))
def test_exchanges(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"\bExchange hashpartitioning", plan)) <= MOST[name] and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert name in ("kalman_ball", "smoothed_ball", "segmented_ball") or len(re.findall("FileScan", plan)) == 1
