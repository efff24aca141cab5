"""Queries over pictures: frames made of the rows of a table, what is measured and found in them, each with its SQL by pixels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rallyframe.config import LineConfig
from rallyframe.operators import detections as D
from rallyframe.operators import hough, pixels, rasters, trackers
from rallyframe.plans.tracker_queries import SEGMENTS_FOLD_SQL
from rallyframe.sources.shared import Shared
from rallyframe.sources.tracks import table

c = F.col


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame of BGR bytes for every 64 vectors, one line each; four frames to a video. The left part of every other frame stands still."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    before = e.select((c("vec_id") + 64).alias("vec_id"), c("embedding").alias("last"))
    e = e.join(before, "vec_id", "left").withColumn("still", (F.floor(c("vec_id") / 64) % 2 == 1) & c("last").isNotNull())

    def pixel(x):
        held = c("still") & (x < 24)
        v, line = F.when(held, F.get("last", x)).otherwise(F.get("embedding", x)).cast("double"), c("vec_id") - F.when(held, 64).otherwise(0)
        red = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(255.0), 170 + 400 * v)))
        blue = F.when(v > 0.2, 215).otherwise(60 + (line * 7 + x * 13) % 40)
        return F.concat(*(F.lpad(F.hex(k), 2, "0") for k in (blue.cast("long"), F.lit(220), red.cast("long"))))

    line = e.select(F.floor(c("vec_id") / 64).alias("frame_number"), "vec_id", F.array_join(F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), pixel), "").alias("line"))
    whole = line.groupBy("frame_number").agg(F.sort_array(F.collect_list(F.struct("vec_id", "line"))).alias("lines"))
    data = F.unhex(F.array_join(F.transform("lines", lambda s: s["line"]), ""))
    return whole.select(F.floor(c("frame_number") / 4).alias("video_id"), "frame_number", data.alias("data"), F.size("lines").cast("long").alias("height"), F.lit(64).cast("long").alias("width"))


PIXELS_SQL = """cells AS (SELECT vec_id, unnest(range(len(embedding))) AS x, unnest(embedding)::DOUBLE AS v FROM embeddings),
held AS (
  SELECT c.vec_id, c.x, coalesce(o.v, c.v) AS v, coalesce(o.vec_id, c.vec_id) AS line
  FROM cells c LEFT JOIN cells o ON o.vec_id = c.vec_id - 64 AND o.x = c.x AND c.x < 24 AND c.vec_id // 64 % 2 = 1
),
px AS (
  SELECT vec_id // 64 // 4 AS video_id, vec_id // 64 AS frame_number, vec_id - min(vec_id) OVER (PARTITION BY vec_id // 64) AS y, x, b, 220 AS g, r
  FROM (SELECT vec_id, x, floor(greatest(0.0::DOUBLE, least(255.0::DOUBLE, 170 + 400 * v)))::BIGINT AS r, CASE WHEN v > 0.2::DOUBLE THEN 215 ELSE 60 + (line * 7 + x * 13) % 40 END AS b FROM held)
),
grey AS (SELECT video_id, frame_number, y, x, (114 * b + 587 * g + 299 * r + 500) // 1000 AS w FROM px),
hi AS (SELECT *, greatest(b, g, r) AS v, greatest(b, g, r) - least(b, g, r) AS d FROM px),
hsv AS (
  SELECT *, CASE WHEN v = 0 THEN 0 ELSE round_even(255 * d / v::DOUBLE, 0) END AS sat,
    round_even(CASE WHEN d = 0 THEN 0 WHEN v = r THEN ((60 * (g - b) / d::DOUBLE + 360) - 360 * floor((60 * (g - b) / d::DOUBLE + 360) / 360)) ELSE 120 + 60 * (b - r) / d::DOUBLE END / 2, 0) AS hue
  FROM hi
),
size AS (SELECT video_id, frame_number, max(y) + 1 AS height, max(x) + 1 AS width FROM px GROUP BY ALL),
lit AS (SELECT frame_number, y, x FROM hsv WHERE hue BETWEEN 18 AND 48 AND sat >= 55 AND v >= 90)"""


def blob_outlines(spark, sf_dir):
    shared = Shared(spark)
    found = rasters.blobs(rasters.opened(rasters.lit_runs(frames(spark, sf_dir), rasters.yellow())), shared)
    return shared.result(found.select("frame_number", "x1", "y1", "x2", "y2", "area", F.round("perimeter", 6).alias("perimeter"), "euler"))


def color_fallback(spark, sf_dir):
    """Frames whose detector found something keep that; the others get the blobs of their pictures."""
    shared = Shared(spark)
    all_frames = frames(spark, sf_dir)
    found = all_frames.where("frame_number % 3 = 0").select("video_id", "frame_number", F.lit(32.0).alias("center_x"), F.lit(20.0).alias("center_y"), F.lit(0.9).alias("confidence"), F.lit(0.9).alias("ranking_score"), F.lit(1).alias("rank"))
    blobs = rasters.color_candidates(all_frames.join(found.select("video_id", "frame_number"), ["video_id", "frame_number"], "left_anti"), shared)
    both = D.with_fallback(found, blobs.select(*found.columns))
    return shared.result(both.select("frame_number", "source", "rank", "center_x", "center_y", "confidence", "ranking_score"))


def frame_measures(spark, sf_dir):
    measured = pixels.measured(frames(spark, sf_dir)).withColumn("white_percent", F.round(pixels.white_percent(), 4))
    return measured.select("frame_number", "brightness", "sharpness", "white_percent")


def color_scores(spark, sf_dir):
    """The yellow share of boxes all over the frames; some reach beyond them."""
    box = F.explode(F.sequence(F.lit(0), F.lit(19))).alias("k")
    boxes = frames(spark, sf_dir).select("*", box).withColumns({"x1": (c("k") * 11 % 60).cast("double"), "y1": (c("k") * 17 % 60 - 2).cast("double")})
    boxes = boxes.withColumns({"x2": c("x1") + c("k") % 6 * 3, "y2": c("y1") + 3 + c("k") % 5})
    return boxes.select("frame_number", "k", pixels.color_score().alias("color_score"))


def frame_motion(spark, sf_dir):
    """Camera motion from the pictures themselves."""
    return pixels.camera_motion(pixels.frame_differences(frames(spark, sf_dir), None))


def spots(spark, sf_dir) -> DataFrame:
    spot = F.explode(F.sequence(F.lit(0), F.lit(24))).alias("id")
    return frames(spark, sf_dir).select("video_id", "frame_number", spot).withColumns({"id": c("id").cast("long"), "x": c("id") * 13 % 71 - 3.5, "y": c("id") * 29 % 67 + 0.25})


def static_spots(spark, sf_dir):
    found = pixels.with_static(spots(spark, sf_dir), frames(spark, sf_dir))
    return found.select("frame_number", "id", F.round("mean_difference", 6).alias("mean_difference"), "is_static")


def segmented_ball_in_pictures(spark, sf_dir):
    """The segmented tracker over the spots of the pictures; what stands still is seen there."""
    timed = frames(spark, sf_dir).select("video_id", "frame_number").withColumn("timestamp_seconds", c("frame_number") / 25.0)
    rated = spots(spark, sf_dir).withColumns({"confidence": c("id") * 7 % 10 / 10.0, "score": c("id") * 3 % 10 / 10.0})
    candidates = rated.join(pixels.with_static(rated, frames(spark, sf_dir)).select("video_id", "frame_number", "id", "is_static"), ["video_id", "frame_number", "id"])
    return trackers.folded(trackers.frames_with_candidates(timed, candidates), trackers.SegmentedBall, trackers.SegmentedBall.schema)


#: Lines of pictures of 64 by 64.
SMALL = LineConfig(votes=6, minimum_length=20, maximum_gap=14)


def voted_lines(spark, sf_dir):
    """Court lines of the pictures: white cells, votes, segments, and what lines() says of them."""
    white = rasters.points(rasters.lit_runs(frames(spark, sf_dir), rasters.white(SMALL)))
    return D.lines(hough.segments(white, SMALL)).select("frame_number", "line_id", "x1", "y1", "x2", "y2", "points", "length_pixels", "angle_degrees", "orientation")


QUERIES = {f.__name__: f for f in (blob_outlines, color_fallback, frame_measures, color_scores, frame_motion, static_spots, segmented_ball_in_pictures, voted_lines)}

STATIC_SQL = f"""{PIXELS_SQL},
change AS (SELECT g.video_id, g.frame_number, g.y, g.x, abs(g.w - o.w) AS d FROM grey g JOIN grey o ON o.video_id = g.video_id AND o.frame_number = g.frame_number - 1 AND o.y = g.y AND o.x = g.x JOIN size s ON s.frame_number = g.frame_number JOIN size z ON z.frame_number = o.frame_number AND z.height = s.height),
spots AS (SELECT video_id, frame_number, height, width, id, id * 13 % 71 - 3.5::DOUBLE AS x, id * 29 % 67 + 0.25::DOUBLE AS y FROM size, range(25) t(id)),
judged AS (
  SELECT s.video_id, s.frame_number, s.id, any_value(s.x) AS x, any_value(s.y) AS y, avg(d) AS mean
  FROM spots s LEFT JOIN change c ON c.frame_number = s.frame_number AND c.x >= greatest(0, trunc(s.x - 10)) AND c.x < least(width, trunc(s.x + 10)) AND c.y >= greatest(0, trunc(s.y - 10)) AND c.y < least(height, trunc(s.y + 10))
  GROUP BY s.video_id, s.frame_number, s.id
)"""


def _hough_sql() -> str:
    cos, sin = ([hough.COS, hough.SIN][k] for k in (0, 1))
    rho = "floor((x * cos_[a + 1] + y * sin_[a + 1] + 32768) / 65536::DOUBLE)::BIGINT"
    return f"""{PIXELS_SQL},
trig AS (SELECT {cos}::BIGINT[] AS cos_, {sin}::BIGINT[] AS sin_),
white AS (SELECT h.frame_number, x, y FROM hsv h JOIN size USING (frame_number) WHERE sat <= 95 AND v >= 170 AND y >= round_even(height * 0.2::DOUBLE, 0) AND y < height),
cast_ AS (SELECT frame_number, x, y, a, {rho} AS rho FROM white, trig, range(180) t(a)),
bins AS (SELECT frame_number, a, rho, count(*) AS n FROM cast_ GROUP BY ALL HAVING count(*) >= {SMALL.votes}),
wide AS (SELECT frame_number, a, rho, n, a AS own, rho AS own_rho FROM bins UNION ALL SELECT frame_number, a - 180, -rho, n, a, rho FROM bins WHERE a = 179 UNION ALL SELECT frame_number, a + 180, -rho, n, a, rho FROM bins WHERE a = 0),
tops AS (
  SELECT * FROM bins b WHERE NOT EXISTS (SELECT 1 FROM wide w WHERE w.frame_number = b.frame_number AND abs(w.a - b.a) <= 1 AND abs(w.rho - b.rho) <= 1 AND (w.n > b.n OR (w.n = b.n AND (w.own < b.a OR (w.own = b.a AND w.own_rho < b.rho)))))
),
mine AS (SELECT c.*, cos_[c.a + 1] AS ca, sin_[c.a + 1] AS sa FROM cast_ c JOIN tops t USING (frame_number, a, rho), trig QUALIFY row_number() OVER (PARTITION BY c.frame_number, c.x, c.y ORDER BY t.n DESC, c.a, c.rho) = 1),
along AS (SELECT frame_number, a, rho, x, y, y * ca - x * sa AS t FROM mine),
parted AS (SELECT *, CASE WHEN t - lag(t) OVER w > {SMALL.maximum_gap} * 65536 THEN 1 ELSE 0 END AS cut FROM along WINDOW w AS (PARTITION BY frame_number, a, rho ORDER BY t, x, y)),
pieces AS (SELECT *, sum(cut) OVER (PARTITION BY frame_number, a, rho ORDER BY t, x, y) AS part FROM parted),
ends AS (SELECT frame_number, a, rho, part, min({{'t': t, 'x': x, 'y': y}}) AS p, max({{'t': t, 'x': x, 'y': y}}) AS q, count(*) AS points FROM pieces GROUP BY ALL),
long AS (SELECT *, (q.x - p.x) * (q.x - p.x) + (q.y - p.y) * (q.y - p.y) AS square FROM ends),
named AS (
  SELECT frame_number, row_number() OVER (PARTITION BY frame_number ORDER BY square DESC, a, rho, part) AS line_id, p.x AS x1, p.y AS y1, q.x AS x2, q.y AS y2, points, round(sqrt(square::DOUBLE), 2) AS length_pixels,
    round((degrees(atan2((q.y - p.y)::DOUBLE, (q.x - p.x)::DOUBLE)) + 360) - 180 * floor((degrees(atan2((q.y - p.y)::DOUBLE, (q.x - p.x)::DOUBLE)) + 360) / 180), 2) AS angle_degrees
  FROM long WHERE square >= {SMALL.minimum_length**2}
)
SELECT *, CASE WHEN angle_degrees <= 15 OR angle_degrees >= 165 THEN 'horizontal' WHEN abs(angle_degrees - 90) <= 15 THEN 'vertical' ELSE 'diagonal' END AS orientation FROM named"""

#: Blobs by pixels: erosion and dilation by counting neighbours, holes by a flood from outside, components by reachability.
BLOBS_SQL = f"""{PIXELS_SQL},
near AS (SELECT i AS dx, j AS dy FROM range(-1, 2) t(i), range(-1, 2) u(j)),
eroded AS (
  SELECT l.frame_number, l.y, l.x FROM lit l JOIN size s USING (frame_number), near n
  LEFT JOIN lit o ON o.frame_number = l.frame_number AND o.y = l.y + n.dy AND o.x = l.x + n.dx
  GROUP BY l.frame_number, l.y, l.x HAVING bool_and(o.x IS NOT NULL OR l.y + n.dy NOT BETWEEN 0 AND s.height - 1 OR l.x + n.dx NOT BETWEEN 0 AND s.width - 1)
),
grown AS (
  SELECT DISTINCT e.frame_number, e.y + dy AS y, e.x + dx AS x FROM eroded e JOIN size s USING (frame_number), near
  WHERE e.y + dy BETWEEN 0 AND s.height - 1 AND e.x + dx BETWEEN 0 AND s.width - 1
),
field AS (SELECT frame_number, y.y, x.x FROM size, unnest(range(-1, height + 1)) y(y), unnest(range(-1, width + 1)) x(x)),
outside AS (
  SELECT frame_number, y, x FROM field WHERE y = -1 AND x = -1
  UNION
  SELECT f.frame_number, f.y, f.x FROM outside o JOIN near ON abs(dx) + abs(dy) = 1 JOIN field f ON f.frame_number = o.frame_number AND f.y = o.y + dy AND f.x = o.x + dx
  WHERE NOT EXISTS (SELECT 1 FROM grown g WHERE g.frame_number = f.frame_number AND g.y = f.y AND g.x = f.x)
),
solid AS (
  SELECT frame_number, y, x FROM field f JOIN size s USING (frame_number) WHERE y BETWEEN 0 AND height - 1 AND x BETWEEN 0 AND width - 1
    AND NOT EXISTS (SELECT 1 FROM outside o WHERE o.frame_number = f.frame_number AND o.y = f.y AND o.x = f.x) AND frame_number IN (SELECT frame_number FROM grown)
),
reach AS (
  SELECT frame_number, y, x, y * 100000 + x AS root FROM solid
  UNION
  SELECT s.frame_number, s.y, s.x, r.root FROM reach r, near n JOIN solid s ON s.frame_number = r.frame_number AND s.y = r.y + n.dy AND s.x = r.x + n.dx WHERE s.y * 100000 + s.x > r.root
),
part AS (SELECT frame_number, y, x, min(root) AS part FROM reach GROUP BY ALL),
quad AS (
  SELECT p.frame_number, p.part, p.y - dy AS qy, p.x - dx AS qx, count(*) AS n, count(DISTINCT p.y) AS rows, count(DISTINCT p.x) AS cols
  FROM part p, range(2) t(dx), range(2) u(dy) GROUP BY ALL
),
outline AS (
  SELECT frame_number, part, sum(CASE n WHEN 4 THEN 1.0::DOUBLE WHEN 3 THEN 0.5 ELSE 0 END) AS area, sum(CASE WHEN n = 2 AND (rows = 1 OR cols = 1) THEN 1 ELSE 0 END) AS straight, sum(CASE n WHEN 3 THEN 1 WHEN 2 THEN CASE WHEN rows = 2 AND cols = 2 THEN 2 ELSE 0 END ELSE 0 END) AS slanted,
    (sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN n = 2 AND rows = 2 AND cols = 2 THEN -2 ELSE 0 END) / 4)::BIGINT AS euler
  FROM quad GROUP BY ALL
),
found AS (
  SELECT o.frame_number, o.part, min(x) AS x1, min(y) AS y1, max(x) AS x2, max(y) AS y2, any_value(area) AS area, any_value(straight) + sqrt(2.0::DOUBLE) * any_value(slanted) AS perimeter, any_value(euler) AS euler
  FROM outline o JOIN part p USING (frame_number, part) GROUP BY ALL
)"""

ORACLE = {
    "frame_measures": f"""WITH {PIXELS_SQL}, mirrored AS (SELECT g.*, s.height, s.width FROM grey g JOIN size s USING (frame_number)),
      laplace AS (SELECT m.frame_number, u.w + d.w + l.w + r.w - 4 * m.w AS v FROM mirrored m
        JOIN grey u ON u.frame_number = m.frame_number AND u.x = m.x AND u.y = abs(m.y - 1) JOIN grey d ON d.frame_number = m.frame_number AND d.x = m.x AND d.y = CASE WHEN m.y = m.height - 1 THEN m.y - 1 ELSE m.y + 1 END
        JOIN grey l ON l.frame_number = m.frame_number AND l.y = m.y AND l.x = abs(m.x - 1) JOIN grey r ON r.frame_number = m.frame_number AND r.y = m.y AND r.x = CASE WHEN m.x = m.width - 1 THEN m.x - 1 ELSE m.x + 1 END),
      sharp AS (SELECT frame_number, round(avg(v * v) - avg(v) * avg(v), 2) AS sharpness FROM laplace GROUP BY 1),
      bright AS (SELECT frame_number, round(sum(114 * b + 587 * g + 299 * r) / (1000.0::DOUBLE * count(*)), 2) AS brightness FROM px GROUP BY 1),
      white AS (SELECT frame_number, round(100.0::DOUBLE * count(*) FILTER (WHERE sat <= 50 AND v >= 180) / count(*), 4) AS white_percent FROM hsv GROUP BY 1)
      SELECT frame_number, brightness, sharpness, white_percent FROM bright JOIN sharp USING (frame_number) JOIN white USING (frame_number)""",
    "color_scores": f"""WITH {PIXELS_SQL}, b AS (SELECT frame_number, k, k * 11 % 60 AS x1, k * 17 % 60 - 2 AS y1, k * 11 % 60 + k % 6 * 3 AS x2, k * 17 % 60 + 1 + k % 5 AS y2 FROM size, range(20) t(k))
      SELECT b.frame_number, k::INT AS k, coalesce(round_even(avg(CASE WHEN hue BETWEEN 20 AND 45 AND sat >= 60 AND v >= 80 THEN 1.0::DOUBLE WHEN x IS NOT NULL THEN 0 END), 4), 0) AS color_score
      FROM b LEFT JOIN hsv h ON h.frame_number = b.frame_number AND x >= x1 AND x < x2 AND y >= y1 AND y < y2 GROUP BY 1, 2""",
    "frame_motion": f"""WITH {PIXELS_SQL}, d AS (SELECT g.video_id, g.frame_number, avg(abs(g.w - o.w)) AS d FROM grey g JOIN grey o ON o.video_id = g.video_id AND o.frame_number = g.frame_number - 1 AND o.y = g.y AND o.x = g.x
        JOIN size s ON s.frame_number = g.frame_number JOIN size z ON z.frame_number = o.frame_number AND z.height = s.height GROUP BY 1, 2)
      SELECT video_id, round(avg(d), 4) AS mean_difference, CASE WHEN avg(d) < 5 THEN 'STATIC' WHEN avg(d) < 15 THEN 'MOSTLY_STATIC' ELSE 'MOVING' END AS camera FROM d GROUP BY 1""",
    "static_spots": f"WITH {STATIC_SQL} SELECT frame_number, id, round(mean, 6) AS mean_difference, coalesce(mean < 5, FALSE) AS is_static FROM judged",
    "segmented_ball_in_pictures": f"""WITH RECURSIVE {STATIC_SQL},
      frames AS (SELECT video_id, frame_number, frame_number / CAST(25 AS DOUBLE) AS t, row_number() OVER (PARTITION BY video_id ORDER BY frame_number) AS n,
        list(struct_pack(x := x, y := y, confidence := (id * 7 % 10) / CAST(10 AS DOUBLE), score := (id * 3 % 10) / CAST(10 AS DOUBLE), still := coalesce(mean < 5, FALSE)) ORDER BY id * 3 % 10 DESC, id) AS c FROM judged GROUP BY video_id, frame_number),
      {SEGMENTS_FOLD_SQL} SELECT * FROM segmented""",
    "voted_lines": f"WITH {_hough_sql()}",
    "blob_outlines": f"WITH RECURSIVE {BLOBS_SQL} SELECT frame_number, x1, y1, x2, y2, area, round(perimeter, 6) AS perimeter, euler FROM found",
    "color_fallback": f"""WITH RECURSIVE {BLOBS_SQL},
      circle AS (SELECT *, 4 * pi() * area / (perimeter * perimeter) AS circularity FROM found WHERE area BETWEEN 3 AND 700 AND perimeter > 0),
      ranked AS (SELECT *, round(least(circularity, 1), 4) AS ranking_score FROM circle WHERE circularity >= 0.15::DOUBLE AND frame_number % 3 <> 0)
      SELECT frame_number, 'detector' AS source, 1 AS rank, 32.0::DOUBLE AS center_x, 20.0::DOUBLE AS center_y, 0.9::DOUBLE AS confidence, 0.9::DOUBLE AS ranking_score FROM size WHERE frame_number % 3 = 0
      UNION ALL SELECT frame_number, 'color_fallback', row_number() OVER (PARTITION BY frame_number ORDER BY ranking_score DESC, y1, x1), (x1 + x2 + 1) / 2.0::DOUBLE, (y1 + y2 + 1) / 2.0::DOUBLE, 0.0, ranking_score FROM ranked""",
}
