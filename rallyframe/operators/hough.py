"""Straight lines in points of frames (video_id, frame_number, x, y), by voting.

Every point votes for the lines through it, one for each whole degree; votes are counted by (frame, angle, distance), partly before
the exchange. Lines are the bins that no neighbour beats; a point belongs to the strongest line it votes for; a line's points in
order, parted at gaps, give its segments. Sines are whole numbers, so a vote never depends on rounding."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.config import LineConfig

c = F.col
FRAME = ["video_id", "frame_number"]
ANGLES = 180
#: What a sine of 1 is.
UNIT = 1 << 16
COS = [round(math.cos(math.pi * k / ANGLES) * UNIT) for k in range(ANGLES)]
SIN = [round(math.sin(math.pi * k / ANGLES) * UNIT) for k in range(ANGLES)]


def _of(table: list[int], angle: Column) -> Column:
    return F.get(F.array(*(F.lit(v).cast("long") for v in table)), angle)


def distance(angle: Column) -> Column:
    """From the origin to the line through x, y, in whole pixels."""
    return F.floor((c("x") * _of(COS, angle) + c("y") * _of(SIN, angle) + UNIT // 2) / UNIT)


def votes(points: DataFrame) -> DataFrame:
    """video_id, frame_number, angle, rho, votes."""
    cast = points.select(*FRAME, "x", "y", F.explode(F.sequence(F.lit(0), F.lit(ANGLES - 1))).alias("angle"))
    return cast.withColumn("rho", distance(c("angle"))).groupBy(*FRAME, "angle", "rho").agg(F.count("*").alias("votes"))


def peaks(counted: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """The bins with enough votes that are the best of their 3 by 3 neighbourhood (ties: smaller angle, then distance). The angle after the
    last is the first, with the distance's other sign."""
    strong = counted.where(c("votes") >= config.votes)
    shift = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1))))
    sent = strong.withColumn("s", shift).withColumns({"to": c("angle") + c("s.i"), "own": (c("s.i") == 0) & (c("s.j") == 0)})
    around = (c("to") < 0) | (c("to") >= ANGLES)
    sent = sent.withColumns({"to_angle": F.pmod(c("to"), F.lit(ANGLES)), "to_rho": F.when(around, -c("rho")).otherwise(c("rho")) + c("s.j")})
    best = F.max(F.struct("votes", (-c("angle")).alias("a"), (-c("rho")).alias("r")))
    met = sent.groupBy(*FRAME, c("to_angle").alias("angle"), c("to_rho").alias("rho")).agg(best.alias("best"), F.max(F.when(c("own"), c("votes"))).alias("votes"))
    return met.where(c("votes").isNotNull() & (c("best.a") == -c("angle")) & (c("best.r") == -c("rho"))).drop("best")


def segments(points: DataFrame, config: LineConfig = LineConfig()) -> DataFrame:
    """video_id, frame_number, line_id (longest first), x1, y1, x2, y2, points of the segments that are long enough."""
    lines = peaks(votes(points), config)
    on = points.join(lines, FRAME).where(distance(c("angle")) == c("rho"))
    strongest = Window.partitionBy(*FRAME, "x", "y").orderBy(F.desc("votes"), "angle", "rho")
    own = on.withColumn("place", F.row_number().over(strongest)).where("place = 1")
    along = own.withColumn("t", c("y") * _of(COS, c("angle")) - c("x") * _of(SIN, c("angle")))
    line = Window.partitionBy(*FRAME, "angle", "rho").orderBy("t", "x", "y")
    cut = F.coalesce(c("t") - F.lag("t").over(line) > config.maximum_gap * UNIT, F.lit(False)).cast("int")
    parts = along.withColumn("cut", cut).withColumn("part", F.sum("cut").over(line))
    end = lambda f: f(F.struct("t", "x", "y"))
    found = parts.groupBy(*FRAME, "angle", "rho", "part").agg(end(F.min).alias("a"), end(F.max).alias("b"), F.count("*").alias("points"))
    dx, dy = c("b.x") - c("a.x"), c("b.y") - c("a.y")
    long = found.withColumn("square", dx * dx + dy * dy).where(c("square") >= config.minimum_length**2)
    number = F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.desc("square"), "angle", "rho", "part"))
    return long.select(*FRAME, number.alias("line_id"), c("a.x").alias("x1"), c("a.y").alias("y1"), c("b.x").alias("x2"), c("b.y").alias("y2"), "points")
