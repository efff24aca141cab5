"""Rasters as runs of lit cells: what is done to pictures by rows of a table, without a loop over pixels.

A run is a row (video_id, frame_number, height, width, y, a, b): the cells a to b of line y are lit, and their neighbours aren't. All
steps but linking are windows over the runs of a line and take one exchange by frame; a frame's runs are never collected.

Blobs are 8-connected components with their holes filled. Their outline is measured by sums over pairs of touching runs: in
windows of two by two cells a full one adds an area of 1, one of three cells half of that and a diagonal step of the
outline, one of two cells a straight step (or, in two corners, two diagonal ones)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.config import CandidateConfig, LineConfig
from rallyframe.operators import graphs, pixels
from rallyframe.sources.shared import Shared

c = F.col
FRAME = ["video_id", "frame_number"]
SIZED = [*FRAME, "height", "width"]
#: Cells of a line, at most: what makes a node's number of a run.
LINE = 1 << 24


def lit_runs(frames: DataFrame, lit: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The runs of every frame (video_id, frame_number, data, height, width), where lit gives the cells of a picture."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for v, f, data, h, w in zip(pdf["video_id"], pdf["frame_number"], pdf["data"], pdf["height"], pdf["width"]):
                step = np.diff(np.pad(lit(pixels.image_of(data, h, w)).astype(np.int8), ((0, 0), (1, 1))), axis=1)
                (y, a), (_, b) = np.nonzero(step == 1), np.nonzero(step == -1)
                yield pd.DataFrame({"video_id": v, "frame_number": f, "height": h, "width": w, "y": y, "a": a, "b": b - 1})

    return frames.select(*FRAME, "data", "height", "width").mapInPandas(run, "video_id long, frame_number long, height long, width long, y long, a long, b long")


def yellow(hue: tuple[int, int] = (18, 48), saturation: int = 55, value: int = 90) -> Callable[[np.ndarray], np.ndarray]:
    def lit(image: np.ndarray) -> np.ndarray:
        h, s, v = np.moveaxis(np.round(pixels.hsv(image)), -1, 0)
        return (h >= hue[0]) & (h <= hue[1]) & (s >= saturation) & (v >= value)

    return lit


def white(config: LineConfig = LineConfig()) -> Callable[[np.ndarray], np.ndarray]:
    """Bright cells of little colour in the part of the picture where a court can be."""

    def lit(image: np.ndarray) -> np.ndarray:
        _, s, v = np.moveaxis(np.round(pixels.hsv(image)), -1, 0)
        line = np.arange(len(image))[:, None]
        inside = (line >= round(len(image) * config.roi_top_ratio)) & (line < min(round(len(image) * config.roi_bottom_ratio), len(image)))
        return (s <= config.maximum_white_saturation) & (v >= config.white_threshold) & inside

    return lit


def points(runs: DataFrame) -> DataFrame:
    """The cells of all runs, as x and y."""
    return runs.select(*FRAME, F.explode(F.sequence("a", "b")).alias("x"), "y")


def deep(runs: DataFrame, least: Column | int) -> DataFrame:
    """The cells that at least so many of the runs cover, as runs; runs may overlap here."""
    edge = F.explode(F.array(F.struct(c("a").alias("x"), F.lit(1).alias("d")), F.struct((c("b") + 1).alias("x"), F.lit(-1).alias("d"))))
    steps = runs.where("a <= b").select(*SIZED, "y", edge.alias("e")).groupBy(*SIZED, "y", c("e.x").alias("x")).agg(F.sum("e.d").alias("d"))
    line = Window.partitionBy(*FRAME, "y").orderBy("x")
    steps = steps.withColumn("lit", F.sum("d").over(line) >= least)
    turns = steps.withColumn("was", F.lag("lit", 1, False).over(line)).where("lit <> was")
    return turns.withColumn("b", F.lead("x").over(line) - 1).where("lit").select(*SIZED, "y", c("x").alias("a"), "b")


def around(runs: DataFrame) -> DataFrame:
    """Each run on its own line and on those above and below it."""
    return runs.withColumn("y", F.explode(F.sequence(F.greatest(c("y") - 1, F.lit(0)), F.least(c("y") + 1, c("height") - 1))))


def eroded(runs: DataFrame) -> DataFrame:
    """The cells whose 3 by 3 neighbourhood is lit; what lies outside the frame counts as lit."""
    inner = runs.withColumns({"a": F.when(c("a") == 0, 0).otherwise(c("a") + 1), "b": F.when(c("b") == c("width") - 1, c("b")).otherwise(c("b") - 1)})
    lines = 3 - F.when(c("y") == 0, 1).otherwise(0) - F.when(c("y") == c("height") - 1, 1).otherwise(0)
    return deep(around(inner), lines)


def dilated(runs: DataFrame) -> DataFrame:
    """The cells with a lit one in their 3 by 3 neighbourhood."""
    return deep(around(runs.withColumns({"a": F.greatest(c("a") - 1, F.lit(0)), "b": F.least(c("b") + 1, c("width") - 1)})), 1)


def opened(runs: DataFrame) -> DataFrame:
    return dilated(eroded(runs))


def linked(runs: DataFrame, diagonal: bool) -> DataFrame:
    """Pairs of runs of neighbouring lines that touch (u above w), by sides or also by corners, with their ends."""
    near = 1 if diagonal else 0
    above = runs.select(*FRAME, (c("y") + 1).alias("y"), c("node").alias("u"), c("a").alias("a1"), c("b").alias("b1"))
    below = runs.select(*FRAME, "y", c("node").alias("w"), "a", "b")
    touch = (c("a1") <= c("b") + near) & (c("a") <= c("b1") + near)
    return above.join(below, [*FRAME, "y"]).where(touch)


def numbered(runs: DataFrame) -> DataFrame:
    return runs.withColumn("node", c("y") * LINE + c("a"))


def gaps(runs: DataFrame) -> DataFrame:
    """The unlit cells of frames that have runs, as runs, on a field one cell wider on each side."""
    edges = runs.select(*SIZED).distinct().select("*", F.explode(F.sequence(F.lit(-1).cast("long"), c("height"))).alias("y"))
    ends = edges.select("*", F.explode(F.array(F.lit(-2).cast("long"), c("width") + 1)).alias("a")).withColumn("b", c("a"))
    line = Window.partitionBy(*FRAME, "y").orderBy("a")
    found = runs.select(*SIZED, "y", "a", "b").unionByName(ends).withColumn("next", F.lead("a").over(line))
    return found.where("next > b + 1").select(*SIZED, "y", (c("b") + 1).alias("a"), (c("next") - 1).alias("b"))


def filled(runs: DataFrame, shared: Shared) -> DataFrame:
    """The runs with all holes filled: unlit cells that sides of unlit cells don't join with the outside."""
    unlit = shared.written(gaps(runs).withColumn("node", (c("y") + 1) * LINE + c("a") + 1))
    parts = graphs.components(unlit, linked(unlit, diagonal=False).select(*FRAME, "u", "w"), FRAME, shared)
    holes = parts.where("component > 0")  # the outside has the first cell of all
    return deep(runs.select(*SIZED, "y", "a", "b").unionByName(holes.select(*SIZED, "y", "a", "b")), 1)


def outlines(runs: DataFrame, shared: Shared) -> DataFrame:
    """One row for each component: component, its box x1, y1, x2, y2 (inclusive), cells, area and perimeter of its outline, and euler (1 less
    its holes)."""
    runs = shared.written(numbered(runs))
    pairs = shared.written(linked(runs, diagonal=True))
    parts = graphs.components(runs, pairs.select(*FRAME, "u", "w"), FRAME, shared)
    over = F.least("b", "b1") - F.greatest("a", "a1") + 1
    shares = over >= 1
    sides = lambda one, two: F.when(shares & (c(one) != c(two)), 1).otherwise(0)
    sums = pairs.groupBy(*FRAME, c("u").alias("node")).agg(
        F.sum(F.when(shares, over).otherwise(0)).alias("v"), F.sum(F.when(shares, over - 1).otherwise(0)).alias("q4"), F.sum(sides("a", "a1") + sides("b", "b1")).alias("q3"), F.count_if(~shares).alias("qd"),
    )
    joined = parts.join(sums, [*FRAME, "node"], "left").fillna(0, ["v", "q4", "q3", "qd"])
    total = joined.groupBy(*SIZED, "component").agg(
        F.min("a").alias("x1"), F.min("y").alias("y1"), F.max("b").alias("x2"), F.max("y").alias("y2"), F.sum(c("b") - c("a") + 1).alias("cells"), F.sum(c("b") - c("a")).alias("h"), *(F.sum(k).alias(k) for k in ("v", "q4", "q3", "qd")),
    )
    straight = 2 * c("h") + 2 * c("v") - 4 * c("q4") - 2 * c("q3")
    single = 4 * c("cells") - 4 * c("q4") - 3 * c("q3") - 2 * (straight + c("qd"))
    root = math.sqrt(2)
    return total.select(
        *SIZED, "component", "x1", "y1", "x2", "y2", "cells", (c("q4") + c("q3") / 2).alias("area"), (straight + root * c("q3") + 2 * root * c("qd")).alias("perimeter"), ((single - c("q3") - 2 * c("qd")) / 4).cast("long").alias("euler"),
    )


def blobs(runs: DataFrame, shared: Shared) -> DataFrame:
    """The outer outlines of all components. Holes are looked for only in frames where a component has some."""
    runs = shared.written(runs)
    plain = shared.written(outlines(runs, shared))
    holed = plain.where("euler < 1").select(*FRAME).distinct()
    again = outlines(filled(runs.join(holed, FRAME, "left_semi"), shared), shared)
    return plain.join(holed, FRAME, "left_anti").unionByName(again)


def color_candidates(frames: DataFrame, shared: Shared, config: CandidateConfig = CandidateConfig()) -> DataFrame:
    """Candidates for frames without a detection: round blobs of a ball's colour, best first (ties: from the top, then the left)."""
    hue = (config.fallback_hue_low, config.fallback_hue_high)
    found = blobs(opened(lit_runs(frames, yellow(hue, config.fallback_minimum_saturation, config.fallback_minimum_value)).repartition(*FRAME)), shared)
    round_ = 4 * math.pi * c("area") / (c("perimeter") * c("perimeter"))
    sized = found.where(c("area").between(config.fallback_minimum_area, config.fallback_maximum_area) & (c("perimeter") > 0)).withColumn("circularity", round_)
    kept = sized.where(c("circularity") >= config.fallback_minimum_circularity)
    out = kept.select(
        *FRAME, c("x1").cast("double").alias("x1"), c("y1").cast("double").alias("y1"), (c("x2") + 1).cast("double").alias("x2"), (c("y2") + 1).cast("double").alias("y2"), F.round("area", 2).alias("area"), F.round("circularity", 4).alias("circularity"),
        ((c("x1") + c("x2") + 1) / 2).alias("center_x"), ((c("y1") + c("y2") + 1) / 2).alias("center_y"), F.lit(0.0).alias("confidence"), F.round(F.least(c("circularity"), F.lit(1.0)), 4).alias("ranking_score"),
    )
    return out.withColumn("rank", F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.desc("ranking_score"), "y1", "x1")))
