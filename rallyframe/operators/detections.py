"""Detections of balls and persons by frame: geometry, filters, ranking, selection, quality; court lines and frames."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.config import CandidateConfig, CourtConfig, PersonConfig, TrackerConfig
from rallyframe.functions import geometry as G

c = F.col
FRAME = ("video_id", "frame_number")


def with_geometry(boxes: DataFrame) -> DataFrame:
    """Adds box_width, box_height, area, aspect_ratio (4 places), center_x/y, foot_x/y and area_ratio (8 places) to boxes x1, y1,
    x2, y2 in a frame of frame_width by frame_height."""
    width, height = F.greatest(F.lit(0.0), c("x2") - c("x1")), F.greatest(F.lit(0.0), c("y2") - c("y1"))
    out = boxes.withColumns({"box_width": width, "box_height": height, "center_x": (c("x1") + c("x2")) / 2, "center_y": (c("y1") + c("y2")) / 2, "foot_x": (c("x1") + c("x2")) / 2, "foot_y": c("y2")})
    area = c("box_width") * c("box_height")
    return out.withColumns(
        {
            "area": area,
            "aspect_ratio": G.fixed(F.coalesce(F.try_divide(c("box_width"), c("box_height")), F.lit(0.0)), 4),
            "area_ratio": G.fixed(area / (c("frame_width") * c("frame_height")), 8),
        }
    )


def ball_candidates(boxes: DataFrame, config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """Candidates of a ball's size and shape, with ranking_score and their rank in the frame (ties: candidate_id)."""
    ok = (c("area") >= config.minimum_box_area) & (c("area_ratio") <= config.maximum_area_ratio) & c("aspect_ratio").between(config.minimum_aspect_ratio, config.maximum_aspect_ratio)
    scored = with_geometry(boxes).where(ok).withColumn("ranking_score", F.round(c("confidence") * config.confidence_weight + c("color_score") * config.color_weight, 4))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.desc("ranking_score"), "candidate_id")))


def in_region(x: Column, y: Column, corners: list[tuple[float, float]], margin: float) -> Column:
    """Whether a pixel lies in a convex polygon (corners in clockwise order on the screen), widened by a square of margin pixels
    to each side: within every edge's half-plane and the widened box."""
    x, y = F.floor(x), F.floor(y)
    xs, ys = zip(*corners)
    ok = x.between(F.lit(min(xs)) - margin, F.lit(max(xs)) + margin) & y.between(F.lit(min(ys)) - margin, F.lit(max(ys)) + margin)
    for (ax, ay), (bx, by) in zip(corners, [*corners[1:], corners[0]]):
        dx, dy = float(bx - ax), float(by - ay)
        ok = ok & (dx * (y - ay) - dy * (x - ax) >= -margin * (abs(dx) + abs(dy)))
    return ok


def candidates_in_region(candidates: DataFrame, corners: list[tuple[float, float]] | None, margin_share: float = 0.05) -> DataFrame:
    """The candidates whose centre is in the court's region, widened by half of that share of the frame's width; all of them
    without corners."""
    if corners is None:
        return candidates
    margin = F.floor(F.floor(c("frame_width") * margin_share) / 2)
    return candidates.where(in_region(c("center_x"), c("center_y"), corners, margin))


def appearance(circularity: Column, yellow: Column) -> Column:
    """How much a bright spot looks like a ball."""
    return circularity * 0.4 + yellow * 0.6


def circularity(area: Column, perimeter: Column) -> Column:
    """1 of a circle; null without a perimeter."""
    return F.when(perimeter != 0, 4 * math.pi * area / (perimeter * perimeter))


def bright_candidates(spots: DataFrame, least_area: float = 10.0, most_area: float = 500.0, least_circularity: float = 0.5) -> DataFrame:
    """Bright spots (area, perimeter, yellow) of a ball's size and shape, with circularity and appearance_score."""
    found = spots.where(c("area").between(least_area, most_area)).withColumn("circularity", circularity(c("area"), c("perimeter")))
    return found.where(c("circularity") >= least_circularity).withColumn("appearance_score", appearance(c("circularity"), c("yellow")))


def temporal_candidates(ranked: DataFrame, predictions: DataFrame, config: TrackerConfig = TrackerConfig()) -> DataFrame:
    """The candidate of each frame that fits its predicted position best; without a prediction the highest-ranked one. A
    frame is an equi-join key, and the distance a condition on it."""
    joined = ranked.join(predictions.select(*FRAME, "predicted_x", "predicted_y"), list(FRAME), "left")
    d = G.distance(c("center_x"), c("center_y"), c("predicted_x"), c("predicted_y"))
    joined = joined.withColumn("prediction_distance", F.round(d, 3))
    free = c("predicted_x").isNull()
    near = joined.where(free | (d <= config.maximum_match_distance))
    score = F.round(c("ranking_score") * 0.55 + F.greatest(F.lit(0.0), 1.0 - d / config.maximum_match_distance) * 0.45, 4)
    near = near.withColumn("temporal_score", F.when(free, c("ranking_score")).otherwise(score))
    best = Window.partitionBy(*FRAME).orderBy(F.desc("temporal_score"), "rank")
    return near.withColumn("place", F.row_number().over(best)).where("place = 1").drop("place")


def with_fallback(found: DataFrame, fallback: DataFrame) -> DataFrame:
    """All found candidates, and those of the fallback in frames that have none."""
    missing = fallback.join(found.select(*FRAME), list(FRAME), "left_anti")
    return found.withColumn("source", F.lit("detector")).unionByName(missing.withColumn("source", F.lit("color_fallback")), allowMissingColumns=True)


def court_people(persons: DataFrame, config: PersonConfig = PersonConfig()) -> DataFrame:
    """Persons whose feet are in the court's region and who are tall enough."""
    h = c("frame_height")
    return with_geometry(persons).where((c("foot_y") >= config.roi_top_ratio * h) & (c("foot_y") <= config.roi_bottom_ratio * h) & (c("box_height") >= config.minimum_height_ratio * h))


def select_players(people: DataFrame, config: PersonConfig = PersonConfig()) -> DataFrame:
    """The best-scored persons of each frame, labelled A (far) and B (near) by their feet."""
    scored = people.withColumn("selection_score", G.fixed(c("confidence") * F.sqrt(F.greatest(c("area"), F.lit(1.0))), 4))
    best = Window.partitionBy(*FRAME).orderBy(F.desc("selection_score"), "candidate_id")
    top = scored.withColumn("place", F.row_number().over(best)).where(c("place") <= config.max_players)
    side = F.row_number().over(Window.partitionBy(*FRAME).orderBy("foot_y", "place"))
    label = F.when(side == 1, "Player A").when(side == 2, "Player B").otherwise(F.format_string("Player %d", side))
    return top.withColumns({"player_label": label, "court_side": F.when(side == 1, "far").otherwise("near")})


def marked(boxes: DataFrame, persons: PersonConfig = PersonConfig(), balls: CandidateConfig = CandidateConfig()) -> DataFrame:
    """Boxes with geometry, player_label of those that select_players(court_people()) takes, and ball_rank of those that ball_candidates()
    takes; null of all others. Both rank in windows inside a frame: boxes that are partitioned by frame or by video are read once and
    not exchanged."""
    h = c("frame_height")
    person = (c("foot_y") >= persons.roi_top_ratio * h) & (c("foot_y") <= persons.roi_bottom_ratio * h) & (c("box_height") >= persons.minimum_height_ratio * h)
    ball = (c("area") >= balls.minimum_box_area) & (c("area_ratio") <= balls.maximum_area_ratio) & c("aspect_ratio").between(balls.minimum_aspect_ratio, balls.maximum_aspect_ratio)
    out = with_geometry(boxes).withColumns({"is_person": person, "is_ball": ball})
    out = out.withColumns({"selection_score": G.fixed(c("confidence") * F.sqrt(F.greatest(c("area"), F.lit(1.0))), 4), "ranking_score": F.round(c("confidence") * balls.confidence_weight + c("color_score") * balls.color_weight, 4)})
    place = lambda kind, score: F.row_number().over(Window.partitionBy(*FRAME, kind).orderBy(F.desc(score), "candidate_id"))
    out = out.withColumns({"place": F.when(c("is_person"), place("is_person", "selection_score")), "ball_rank": F.when(c("is_ball"), place("is_ball", "ranking_score"))})
    out = out.withColumn("is_player", F.coalesce(c("place") <= persons.max_players, F.lit(False)))
    side = F.row_number().over(Window.partitionBy(*FRAME, "is_player").orderBy("foot_y", "place"))
    label = F.when(side == 1, "Player A").when(side == 2, "Player B").otherwise(F.format_string("Player %d", side))
    return out.withColumn("player_label", F.when(c("is_player"), label)).drop("is_person", "is_ball", "is_player", "place")


def presence(boxes: DataFrame) -> DataFrame:
    """What detection_quality() takes, of every frame of marked() boxes: has_a, has_b and ball."""
    best = F.max(F.when(c("ball_rank") == 1, F.when(c("confidence") >= 0.5, "detected").otherwise("predicted")))
    label = lambda name: F.coalesce(F.bool_or(c("player_label") == name), F.lit(False))
    return boxes.groupBy(*FRAME).agg(label("Player A").alias("has_a"), label("Player B").alias("has_b"), F.coalesce(best, F.lit("lost")).alias("ball"))


def court_rejections(persons: DataFrame, h: G.Matrix, config: PersonConfig = PersonConfig(), court: CourtConfig = CourtConfig()) -> DataFrame:
    """Adds the court position of the feet and rejection_reason (null: kept); the first reason that holds."""
    x, y = G.project(h, c("foot_x"), c("foot_y"))
    out = with_geometry(persons).withColumns({"court_x": x, "court_y": y})
    m = config.court_margin_meters
    outside = ~(c("court_x").between(-m, court.width + m) & c("court_y").between(-m, court.length + m))
    reason = (
        F.when(c("court_x").isNull() | c("court_y").isNull(), "homography_failed")
        .when(outside, "outside_court_bounds")
        .when(c("court_y") < -config.behind_baseline_meters, "behind_near_baseline")
        .when(c("court_y") > court.length + config.behind_baseline_meters, "behind_far_baseline")
    )
    return out.withColumn("rejection_reason", reason)


def zone_rejections(persons: DataFrame, config: PersonConfig = PersonConfig()) -> DataFrame:
    """Adds player_zone (far or near) or the reason why a person is in neither."""
    h, w = c("frame_height"), c("frame_width")
    out = with_geometry(persons).withColumn("foot_ratio", c("foot_y") / h)
    far, near = config.far_zone, config.near_zone
    zone = F.when(c("foot_ratio").between(*far), "far").when(c("foot_ratio").between(*near), "near")
    small = c("box_height") < config.zone_minimum_height_ratio * h
    narrow = c("box_width") < config.zone_minimum_width_ratio * w
    reason = F.when(small, "too_small").when(narrow, "too_narrow").when(zone.isNotNull(), F.lit(None)).when(c("foot_ratio") < far[0], "above_far_court").when(c("foot_ratio") > near[1], "below_near_court").otherwise("middle_zone_excluded")
    return out.withColumns({"rejection_reason": reason, "player_zone": F.when(reason.isNull(), zone)})


def reason_histogram(judged: DataFrame) -> DataFrame:
    return judged.groupBy(F.coalesce("rejection_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("persons"))


def detection_quality(frames: DataFrame, *by: str) -> DataFrame:
    """frames: has_a, has_b, ball (detected, predicted or lost). Counts and percentages."""
    n = F.count("*")
    pct = lambda v: F.round(F.try_divide(100.0 * v, n), 2)
    both, seen = F.count_if(c("has_a") & c("has_b")), F.count_if(c("ball") == "detected")
    return frames.groupBy(*by).agg(
        n.alias("frames"), F.count_if("has_a").alias("frames_a"), F.count_if("has_b").alias("frames_b"), both.alias("frames_both"), seen.alias("ball_detected"),
        F.count_if(c("ball") == "predicted").alias("ball_predicted"), F.count_if(c("ball") == "lost").alias("ball_lost"), pct(both).alias("both_percent"), pct(seen).alias("ball_percent"),
    )


def lines(segments: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """Adds length_pixels, angle_degrees (0 to 180) and orientation to segments x1, y1, x2, y2."""
    dx, dy = c("x2") - c("x1"), c("y2") - c("y1")
    out = segments.withColumns({"length_pixels": F.round(F.sqrt(dx * dx + dy * dy), 2), "angle_degrees": F.round(F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(180.0)), 2)})
    a = c("angle_degrees")
    kind = F.when((a <= tolerance) | (a >= 180 - tolerance), "horizontal").when(F.abs(a - 90) <= tolerance, "vertical").otherwise("diagonal")
    return out.withColumn("orientation", kind)


def court_lines(found: DataFrame, horizontal: int = 6, vertical: int = 4) -> DataFrame:
    """The longest long enough lines of each video, by orientation; is_court says if there are enough of them."""
    long = found.where(c("length_pixels") > 0.10 * F.greatest("frame_width", "frame_height"))
    best = Window.partitionBy("video_id", "orientation").orderBy(F.desc("length_pixels"), "line_id")
    top = long.where("orientation <> 'diagonal'").withColumn("place", F.row_number().over(best))
    kept = top.where(c("place") <= F.when(c("orientation") == "horizontal", horizontal).otherwise(vertical))
    return kept.withColumn("is_court", F.count("*").over(Window.partitionBy("video_id")) >= 6)


def calibration_attempts(frames: DataFrame, least_lines: int = 6, first: int = 11, last: int = 99, patience: int = 50) -> DataFrame:
    """When a video's court was found: the first frame of `first` to `last` with enough main lines (video_id, frame_number, lines). The
    search gives up at a frame beyond `patience` without them, or at one whose lines couldn't be looked for (null). attempts: frames
    tried; calibrated_at: null if it gave up or had no frame to try. Aggregates of one window: nothing is held or sorted."""
    tried = frames.where(c("frame_number").between(first, last)).withColumn("found", F.coalesce(c("lines") >= least_lines, F.lit(False)))
    ends = c("found") | c("lines").isNull() | (c("frame_number") > patience)
    video = Window.partitionBy("video_id")
    tried = tried.withColumn("end", F.min(F.when(ends, c("frame_number"))).over(video))
    done = tried.groupBy("video_id").agg(F.count_if(c("end").isNull() | (c("frame_number") <= c("end"))).alias("attempts"), F.max(F.when(c("found") & (c("frame_number") == c("end")), c("frame_number"))).alias("calibrated_at"), F.max("end").alias("ended_at"))
    return frames.select("video_id").distinct().join(done, "video_id", "left").fillna(0, ["attempts"])


def line_summary(found: DataFrame, *by: str) -> DataFrame:
    n = lambda kind: F.count_if(c("orientation") == kind).alias(kind)
    return found.groupBy(*by).agg(F.count("*").alias("line_count"), n("horizontal"), n("vertical"), n("diagonal"), F.round(F.avg("length_pixels"), 2).alias("average_length"), F.max("length_pixels").alias("longest"))


def timestamp_text(seconds: Column) -> Column:
    """HH:MM:SS.mmm"""
    ms = F.round(seconds * 1000.0).cast("long")
    return F.format_string("%02d:%02d:%02d.%03d", F.expr("0L") + F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def every_nth(frames: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """Every n-th frame of each video, at most `most` of them: with a stride the cap counts frames taken."""
    if n < 1:
        raise ValueError("n must be at least 1")
    taken = frames.where(c("frame_number") % n == 0)
    if most is None:
        return taken
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_number"))
    return taken.withColumn("place", place).where(c("place") <= most).drop("place")


def at_timestamps(frames: DataFrame, wanted: DataFrame, videos: DataFrame) -> DataFrame:
    """The frame nearest to each wanted timestamp (video_id, wanted_seconds); one outside the video is refused."""
    timed = wanted.join(videos.select("video_id", "fps", "duration_seconds"), "video_id")
    bad = (c("wanted_seconds") < 0) | (c("wanted_seconds") > c("duration_seconds"))
    frame = F.when(bad, F.raise_error(F.lit("a timestamp outside the video")).cast("long")).otherwise(F.round(c("wanted_seconds") * c("fps")).cast("long"))
    return timed.withColumn("frame_number", frame).join(frames, ["video_id", "frame_number"])


def letterbox(sizes: DataFrame, width: int = 640, height: int = 640) -> DataFrame:
    """Scaled size and padding that fit frames of frame_width by frame_height into the target."""
    scale = F.least(width / c("frame_width"), height / c("frame_height"))
    out = sizes.withColumn("scale", scale)
    out = out.withColumns({"new_width": F.greatest(F.lit(1), F.round(c("frame_width") * c("scale")).cast("int")), "new_height": F.greatest(F.lit(1), F.round(c("frame_height") * c("scale")).cast("int"))})
    left, top = F.floor((width - c("new_width")) / 2).cast("int"), F.floor((height - c("new_height")) / 2).cast("int")
    return out.withColumns({"scale": F.round("scale", 6), "pad_left": left, "pad_top": top, "pad_right": width - c("new_width") - left, "pad_bottom": height - c("new_height") - top})


def quality_flags(frames: DataFrame, dark: float = 45.0, bright: float = 210.0, blur: float = 80.0) -> DataFrame:
    """Adds is_dark, is_overexposed, is_blurry, issues and acceptable to frames with brightness and sharpness."""
    out = frames.withColumns({"is_dark": c("brightness") < dark, "is_overexposed": c("brightness") > bright, "is_blurry": c("sharpness") < blur})
    issues = F.array_compact(F.array(F.when(c("is_dark"), "dark"), F.when(c("is_overexposed"), "overexposed"), F.when(c("is_blurry"), "blurry")))
    return out.withColumn("issues", issues).withColumn("acceptable", F.size("issues") == 0)


def frame_documents(boxes: DataFrame) -> DataFrame:
    """A nested document for each frame of marked() boxes: players in order of label, and the ball or null; ready for write.json."""
    player = F.when(c("player_label").isNotNull(), F.struct(c("player_label").alias("label"), F.array("x1", "y1", "x2", "y2").alias("bbox"), "confidence"))
    ball = F.max(F.when(c("ball_rank") == 1, F.struct(c("center_x").alias("x"), c("center_y").alias("y"), "confidence")))
    return boxes.groupBy(*FRAME).agg(F.sort_array(F.collect_list(player)).alias("players"), ball.alias("ball"))


def overlay_plan(boxes: DataFrame, tail: int = 30) -> DataFrame:
    """What a renderer draws on each frame of marked() boxes: primitive, coordinates, text. The tail of a ball is the steps it took in the
    last frames, which each frame has as an array; rows are made of it at the end alone. With boxes partitioned by video, nothing is
    exchanged here."""

    def drawn(primitive, ax, ay, bx, by, caption):
        return F.struct(F.lit(primitive).alias("primitive"), ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"), caption.alias("caption"))

    box = F.when(c("player_label").isNotNull(), drawn("box", c("x1"), c("y1"), c("x2"), c("y2"), c("player_label")))
    ball = F.max(F.when(c("ball_rank") == 1, F.struct(c("center_x").alias("x"), c("center_y").alias("y"))))
    frames = boxes.groupBy(*FRAME).agg(F.collect_list(box).alias("boxes"), ball.alias("ball"))
    video = Window.partitionBy("video_id").orderBy("frame_number")
    last = F.last("ball", ignorenulls=True).over(video.rowsBetween(Window.unboundedPreceding, -1))
    leg = F.when(c("ball").isNotNull() & c("last").isNotNull(), drawn("tail", c("last.x"), c("last.y"), c("ball.x"), c("ball.y"), F.lit("")))
    frames = frames.withColumn("last", last).withColumn("leg", leg).withColumn("tail", F.collect_list("leg").over(video.rangeBetween(1 - tail, 0)))
    marker = F.array_compact(F.array(F.when(c("ball").isNotNull(), drawn("marker", c("ball.x"), c("ball.y"), c("ball.x"), c("ball.y"), F.lit("ball")))))
    return frames.select(*FRAME, F.inline(F.concat("boxes", marker, "tail")))
