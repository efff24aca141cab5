"""Pixel measures of raw frames (binary rows of BGR bytes with height and width) in vectorised tasks; a detector is a
pluggable function from frames to detection rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def image_of(data: bytes, height: int, width: int) -> np.ndarray:
    if data is None or len(data) != height * width * 3 or not len(data):
        raise ValueError("a frame needs height * width * 3 bytes")
    return np.frombuffer(data, np.uint8).reshape(height, width, 3)


def gray(image: np.ndarray) -> np.ndarray:
    return image @ np.array([0.114, 0.587, 0.299])


def whole_gray(image: np.ndarray) -> np.ndarray:
    """Grey to the nearest whole value, in whole numbers."""
    return (image.astype(np.int64) @ np.array([114, 587, 299]) + 500) // 1000


def sharpness_of(image: np.ndarray) -> float:
    """Variance of the Laplacian, with mirrored borders."""
    g = np.pad(whole_gray(image), 1, mode="reflect")
    return float((g[:-2, 1:-1] + g[2:, 1:-1] + g[1:-1, :-2] + g[1:-1, 2:] - 4 * g[1:-1, 1:-1]).var())


def hsv(image: np.ndarray) -> np.ndarray:
    """Hue (0 to 180), saturation and value (0 to 255)."""
    b, g, r = (image[..., i].astype(float) for i in range(3))
    v = image.max(axis=-1).astype(float)
    d = v - image.min(axis=-1)
    safe = np.where(d == 0, 1, d)
    h = np.select([d == 0, v == r, v == g], [0.0, 60 * (g - b) / safe, 120 + 60 * (b - r) / safe], 240 + 60 * (r - g) / safe)
    return np.stack([(h % 360) / 2, np.where(v == 0, 0, 255 * d / np.where(v == 0, 1, v)), v], axis=-1)


def yellow_share(image: np.ndarray, hue: tuple[int, int] = (20, 45), saturation: int = 60, value: int = 80) -> float:
    if not image.size:
        return 0.0
    h, s, v = np.moveaxis(np.round(hsv(image)), -1, 0)
    return float(((h >= hue[0]) & (h <= hue[1]) & (s >= saturation) & (v >= value)).mean())


@F.pandas_udf(T.StructType([T.StructField("brightness", T.DoubleType()), T.StructField("sharpness", T.DoubleType())]))
def _measures(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    images = [image_of(*x) for x in zip(data, height, width)]
    return pd.DataFrame({"brightness": [round(float(gray(i).mean()), 2) for i in images], "sharpness": [round(sharpness_of(i), 2) for i in images]})


def measured(frames: DataFrame) -> DataFrame:
    """Adds brightness and sharpness (2 places) to data, height, width."""
    return frames.withColumn("m", _measures("data", "height", "width")).select("*", "m.*").drop("m")


@F.pandas_udf(T.DoubleType())
def _yellow(data: pd.Series, height: pd.Series, width: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    out = []
    for d, h, w, a, b, c, e in zip(data, height, width, x1, y1, x2, y2):
        image = image_of(d, h, w)
        out.append(round(yellow_share(image[max(0, int(b)) : max(0, int(e)), max(0, int(a)) : max(0, int(c))]), 4))
    return pd.Series(out)


def color_score() -> Column:
    """The share of tennis yellow in the box x1, y1, x2, y2 of a frame; 0 of an empty box."""
    return _yellow("data", "height", "width", "x1", "y1", "x2", "y2")


def detected(frames: DataFrame, make_detector: Callable[[], Callable[[np.ndarray], list[tuple]]], schema: str) -> DataFrame:
    """Detections of every frame. make_detector is called once in each task; what it returns gives a frame's detections as
    tuples of schema's columns after video_id and frame_number."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        detector = make_detector()
        for pdf in it:
            rows = [(v, f, *d) for v, f, b, h, w in zip(pdf["video_id"], pdf["frame_number"], pdf["data"], pdf["height"], pdf["width"]) for d in detector(image_of(b, h, w))]
            yield pd.DataFrame(rows, columns=["video_id", "frame_number", *names])

    return frames.select("video_id", "frame_number", "data", "height", "width").mapInPandas(run, f"video_id long, frame_number long, {schema}")


@F.pandas_udf(T.DoubleType())
def _difference(data: pd.Series, before: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    return pd.Series([None if b is None or len(b) != len(d) else float(np.abs(whole_gray(image_of(d, h, w)) - whole_gray(image_of(b, h, w))).mean()) for d, b, h, w in zip(data, before, height, width)], dtype="float64")


#: The frames of a video that are compared.
SAMPLED = (0, 30, 90, 150, 210, 270, 330)


def frame_differences(frames: DataFrame, sampled: tuple[int, ...] | None = SAMPLED) -> DataFrame:
    """video_id, frame_number, difference: the mean absolute difference of grey values of each sampled frame (None: of all) and the one
    sampled before it, if they are of one size. What camera_motion() takes."""
    some = frames if sampled is None else frames.where(F.col("frame_number").isin(*sampled))
    before = F.lag("data").over(Window.partitionBy("video_id").orderBy("frame_number"))
    some = some.withColumn("before", before).where("before IS NOT NULL")
    return some.select("video_id", "frame_number", _difference("data", "before", "height", "width").alias("difference")).where("difference IS NOT NULL")


#: What moves less in a box of this half width, on average, stands still.
BOX, STILL = 10, 5.0


class Changes:
    """Mean change of grey since the video's frame before, in any box in constant time: sums over all cells above and to the left."""

    def __init__(self):
        self.video, self.before, self.sums = None, None, None

    def frame(self, video: int, image: np.ndarray) -> None:
        now = whole_gray(image)
        last = self.before if video == self.video and self.before is not None and self.before.shape == now.shape else None
        self.sums = None if last is None else np.pad(np.abs(now - last).cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
        self.video, self.before = video, now

    def around(self, x: float, y: float, reach: int = BOX) -> float | None:
        """None without a frame before, or of an empty box."""
        if self.sums is None or x is None or y is None:
            return None
        h, w = self.before.shape
        x1, y1, x2, y2 = max(0, int(x - reach)), max(0, int(y - reach)), min(w, int(x + reach)), min(h, int(y + reach))
        if x2 <= x1 or y2 <= y1:
            return None
        s = self.sums
        return float(s[y2, x2] - s[y1, x2] - s[y2, x1] + s[y1, x1]) / ((x2 - x1) * (y2 - y1))


def with_static(candidates: DataFrame, frames: DataFrame) -> DataFrame:
    """video_id, frame_number, id, mean_difference and is_static of candidates (video_id, frame_number, id, x, y): whether nothing moved
    there since the frame before. Frames and candidates of a video go by in one order, so one frame is held; one exchange."""
    key = ["video_id", "frame_number"]
    none = lambda kind, *names: [F.lit(None).cast(kind).alias(n) for n in names]
    as_ = lambda kind, *names: [F.col(n).cast(kind).alias(n) for n in names]
    pictures = frames.select(*key, F.lit(0).alias("kind"), *none("long", "id"), *none("double", "x", "y"), "data", *as_("long", "height", "width"))
    spots = candidates.select(*key, F.lit(1).alias("kind"), *as_("long", "id"), *as_("double", "x", "y"), *none("binary", "data"), *none("long", "height", "width"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        changes, at = Changes(), None
        for batch in it:
            rows = []
            for v, f, kind, i, x, y, data, h, w in zip(*(batch[c].to_pylist() for c in (*key, "kind", "id", "x", "y", "data", "height", "width"))):
                if kind == 0:
                    changes.frame(v, image_of(data, h, w))
                    at = (v, f)
                else:
                    mean = changes.around(x, y) if at == (v, f) else None
                    rows.append((v, f, i, mean, mean is not None and mean < STILL))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], [*key, "id", "mean_difference", "is_static"])

    both = pictures.unionByName(spots).repartition("video_id").sortWithinPartitions(*key, "kind")
    return both.mapInArrow(run, "video_id long, frame_number long, id long, mean_difference double, is_static boolean")


@F.pandas_udf(T.DoubleType())
def _white(data: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    out = []
    for d, h, w in zip(data, height, width):
        _, s, v = np.moveaxis(np.round(hsv(image_of(d, h, w))), -1, 0)
        out.append(100.0 * float(((s <= 50) & (v >= 180)).mean()))
    return pd.Series(out)


def white_percent() -> Column:
    """The percentage of white pixels (bright, of little saturation) in a frame, as court lines are."""
    return _white("data", "height", "width")


def scaled(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, by the centres of pixels, whole values."""

    def places(new: int, old: int):
        at = np.clip((np.arange(new) + 0.5) * old / new - 0.5, 0, old - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, old - 1), at - low

    y0, y1, fy = places(height, image.shape[0])
    x0, x1, fx = places(width, image.shape[1])
    rows = image[y0] * (1 - fy)[:, None, None] + image[y1] * fy[:, None, None]
    return np.floor(rows[:, x0] * (1 - fx)[:, None] + rows[:, x1] * fx[:, None] + 0.5).astype(np.uint8)


#: Grey of the padding.
PAD = 114


def letterboxed(image: np.ndarray, height: int = 640, width: int = 640) -> np.ndarray:
    scale = min(width / image.shape[1], height / image.shape[0])
    h, w = max(1, round(image.shape[0] * scale)), max(1, round(image.shape[1] * scale))
    out = np.full((height, width, 3), PAD, np.uint8)
    top, left = (height - h) // 2, (width - w) // 2
    out[top : top + h, left : left + w] = scaled(image, h, w)
    return out


def model_input(frames: DataFrame, height: int = 640, width: int = 640) -> DataFrame:
    """video_id, frame_number, tensor: frames as a model takes them, letter-boxed, in RGB, channels first, 0 to 1 (32-bit floats as
    bytes, 3 * height * width of them)."""

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for v, f, d, h, w in zip(pdf["video_id"], pdf["frame_number"], pdf["data"], pdf["height"], pdf["width"]):  # one at a time: a tensor is large
                rgb = letterboxed(image_of(d, h, w), height, width)[..., ::-1]
                yield pd.DataFrame({"video_id": [v], "frame_number": [f], "tensor": [np.ascontiguousarray((rgb.astype(np.float32) / 255).transpose(2, 0, 1)).tobytes()]})

    return frames.select("video_id", "frame_number", "data", "height", "width").mapInPandas(run, "video_id long, frame_number long, tensor binary")


def camera_motion(differences: DataFrame) -> DataFrame:
    """STATIC, MOSTLY_STATIC or MOVING by the mean absolute difference of a video's sampled frames (video_id, difference)."""
    mean = F.avg("difference")
    return differences.groupBy("video_id").agg(F.round(mean, 4).alias("mean_difference"), F.when(mean < 5, "STATIC").when(mean < 15, "MOSTLY_STATIC").otherwise("MOVING").alias("camera"))
