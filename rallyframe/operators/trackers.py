"""Ordered folds over the frames of a video: what a frame gives depends on all frames before it.

Each fold is a small class with `step(time, candidates)`; `folded` runs one over every video of a DataFrame whose frames
carry their candidates as an array. Frames go by in order, so only the state of one video is held."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.config import AssociationConfig, CourtConfig, TrackerConfig
from rallyframe.functions import geometry as G
from rallyframe.operators import folds


def fixed(v: float | None, places: int = 3) -> float | None:
    """Half away from zero after scaling, as geometry.fixed does in plans."""
    return None if v is None else math.copysign(math.floor(abs(v) * 10**places + 0.5), v) / 10**places


#: What a fold sees of a candidate. is_static: nothing moved there since the last frame.
CANDIDATE = "array<struct<x:double,y:double,confidence:double,score:double,id:bigint,is_static:boolean>>"


def frames_with_candidates(frames: DataFrame, candidates: DataFrame) -> DataFrame:
    """video_id, frame_number, timestamp_seconds, any further columns of frames, and the candidates of each frame, best score first
    (ties: id). candidates: video_id, frame_number, id, x, y, confidence, score, and is_static where it is known."""
    if "is_static" not in candidates.columns:
        candidates = candidates.withColumn("is_static", F.lit(False))
    rest = [k for k in frames.columns if k not in ("video_id", "frame_number")]
    one = F.struct((-F.col("score")).alias("minus"), "id", "x", "y", "confidence", "score", "is_static").alias("c")
    # frames and candidates meet by video, where the fold wants them: one exchange instead of a join by frame and another one
    both = frames.withColumn("is_frame", F.lit(True)).unionByName(candidates.select("video_id", "frame_number", one), allowMissingColumns=True).repartition("video_id")
    met = both.groupBy("video_id", "frame_number").agg(F.max("is_frame").alias("is_frame"), *(F.any_value(k, True).alias(k) for k in rest), F.sort_array(F.collect_list("c")).alias("list"))
    plain = F.transform("list", lambda v: F.struct(*(v[k].alias(k) for k in ("x", "y", "confidence", "score", "id", "is_static"))))
    return met.where("is_frame").select(*frames.columns, plain.cast(CANDIDATE).alias("candidates"))


class Kept:
    """What a tracker must hold between batches of a stream: columns of a row (STATE), and a map from track ids (MAP)."""

    STATE = ""
    MAP: tuple[str, str] | None = None

    def saved(self) -> tuple[tuple, dict]:
        raise NotImplementedError

    def restore(self, values: tuple, known: dict) -> None:
        raise NotImplementedError


class Frames:
    """A tracker as the state of a fold."""

    def __init__(self, tracker):
        self.tracker = tracker

    def step(self, frame: int, time: float, found: list):
        return [(frame, *self.tracker.step(time, found))]

    def end(self):
        return ()


def folded(frames: DataFrame, make: Callable[[], object], schema: str, keys: str = "video_id long") -> DataFrame:
    """One row for each frame: the keys, frame_number and what step() returns, in the order of schema's columns."""
    names = [k.split(" ")[0] for k in keys.split(", ")]
    return folds.folded(frames, names, ["frame_number"], ["frame_number", "timestamp_seconds", "candidates"], lambda: Frames(make()), f"{keys}, frame_number long, {schema}")


class SmoothedBall(Kept):
    """A ball by exponential smoothing of position and velocity; missed frames are bridged by prediction."""

    schema = "x double, y double, vx double, vy double, source string, missed int"

    def __init__(self, config: TrackerConfig = TrackerConfig()):
        self.config, self.at, self.time, self.v, self.missed = config, None, None, (0.0, 0.0), 0

    STATE = "x double, y double, time double, vx double, vy double, missed int"

    def saved(self):
        return (*(self.at or (None, None)), self.time, *self.v, self.missed), {}

    def restore(self, values, known):
        x, y, self.time, *v, self.missed = values
        self.at, self.v = None if x is None else (x, y), tuple(v)

    def predicted(self, time: float):
        if self.at is None or self.time is None or time - self.time <= 0:
            return self.at
        return tuple(p + v * (time - self.time) for p, v in zip(self.at, self.v))

    def chosen(self, target, found):
        if target is None:
            return found[0] if found else None
        best = None
        for one in found:
            d = math.hypot(one["x"] - target[0], one["y"] - target[1])
            if d <= self.config.maximum_match_distance:
                score = round(0.55 * one["score"] + 0.45 * max(0.0, 1 - d / self.config.maximum_match_distance), 4)
                if best is None or score > best[0]:
                    best = score, one
        return best and best[1]

    def step(self, time: float, found: list):
        one = self.chosen(self.predicted(time), found)
        if one is not None:
            self.register((one["x"], one["y"]), time)
            source = "detected"
        else:
            self.missed += 1
            if self.missed > self.config.maximum_missed_frames:
                self.at, self.time, self.v = None, None, (0.0, 0.0)
            else:
                self.at = self.predicted(time)
                self.time = time if self.at is not None else self.time
            source = "predicted" if self.at is not None else "lost"
        x, y = self.at if self.at is not None else (None, None)
        return fixed(x), fixed(y), fixed(self.v[0]), fixed(self.v[1]), source, self.missed

    def register(self, at, time):
        a, b = self.config.position_alpha, self.config.velocity_alpha
        if self.at is None:
            self.at, self.v = at, (0.0, 0.0)
        else:
            new = tuple(a * n + (1 - a) * o for n, o in zip(at, self.at))
            dt = time - self.time if self.time is not None else None
            if dt is None:
                self.v = (0.0, 0.0)
            elif dt >= self.config.minimum_time_delta:
                self.v = tuple(b * (n - o) / dt + (1 - b) * v for n, o, v in zip(new, self.at, self.v))
            self.at = new
        self.time, self.missed = time, 0


class Axis:
    """Constant-velocity Kalman filter of one coordinate; x and y don't mix, so two of these make the planar filter."""

    def __init__(self, at: float):
        self.p, self.v, self.cov = at, 0.0, (1000.0, 0.0, 1000.0)

    @staticmethod
    def columns(name: str) -> str:
        return ", ".join(f"{name}_{k} double" for k in ("p", "v", "a", "b", "c"))

    def saved(self) -> tuple:
        return self.p, self.v, *self.cov

    @classmethod
    def pair(cls, values: tuple) -> tuple[Axis, Axis] | None:
        """The two axes that saved() gave these ten values."""
        if values[0] is None:
            return None
        out = cls(values[0]), cls(values[5])
        for axis, (p, v, *cov) in zip(out, (values[:5], values[5:]), strict=True):
            axis.p, axis.v, axis.cov = p, v, tuple(cov)
        return out

    def predict(self, dt: float) -> None:
        a, b, c = self.cov
        self.p += self.v * dt
        self.cov = (a + 2 * dt * b + dt * dt * c + 10.0, b + dt * c, c + 100.0)

    def update(self, z: float) -> None:
        a, b, c = self.cov
        s, y = a + 25.0, z - self.p
        self.p += a / s * y
        self.v += b / s * y
        self.cov = (a - a * a / s, b - a * b / s, c - b * b / s)


class KalmanBall(Kept):
    """A ball by Kalman filter: the candidate of most confidence near the prediction; up to 9 frames are bridged."""

    schema = "x double, y double, vx double, vy double, source string, missed int"
    reach, most = 150.0, 10

    def __init__(self):
        self.axes, self.time, self.missed = None, None, 0

    STATE = f"{Axis.columns('x')}, {Axis.columns('y')}, time double, missed int"

    def saved(self):
        return (*(v for a in self.axes for v in a.saved()), self.time, self.missed) if self.axes else ((None,) * 10 + (self.time, self.missed)), {}

    def restore(self, values, known):
        self.axes, (self.time, self.missed) = Axis.pair(values[:10]), values[10:]

    def step(self, time: float, found: list):
        if self.axes:
            for a in self.axes:
                a.predict(time - self.time)
            target = (self.axes[0].p, self.axes[1].p)
            far = [math.hypot(f["x"] - target[0], f["y"] - target[1]) for f in found]
            near = [(f["confidence"] * (1 - 0.3 * min(1.0, d / self.reach)), f) for f, d in zip(found, far) if d < self.reach]
        else:
            near = [(f["confidence"], f) for f in found]
        self.time = time
        if near:
            one = max(near, key=lambda n: n[0])[1]
            if self.axes:
                for a, z in zip(self.axes, (one["x"], one["y"])):
                    a.update(z)
            else:
                self.axes = (Axis(one["x"]), Axis(one["y"]))
            self.missed, source = 0, "detected"
        else:
            self.missed += 1
            if not self.axes or self.missed >= self.most:
                self.axes, source = None, "lost"
                return None, None, 0.0, 0.0, source, self.missed
            source = "predicted"
        return *(fixed(a.p) for a in self.axes), *(fixed(a.v) for a in self.axes), source, self.missed


class SegmentedBall(Kept):
    """A ball whose confirmed points come in segments: a detection that can't be reached, or a long loss, starts a new one.
    A candidate's score weighs confidence, appearance (here `score`), nearness and motion (what stands still, as lines and
    boards do, loses); 0.3 is needed."""

    schema = "x double, y double, confidence double, status string, segment_id int"

    def __init__(self):
        self.kalman, self.time, self.last, self.misses, self.segment = None, None, None, 0, 0

    STATE = f"{Axis.columns('x')}, {Axis.columns('y')}, time double, last_x double, last_y double, last_time double, last_speed double, misses int, segment int"

    def saved(self):
        axes = tuple(v for a in self.kalman for v in a.saved()) if self.kalman else (None,) * 10
        return (*axes, self.time, *(self.last or (None,) * 4), self.misses, self.segment), {}

    def restore(self, values, known):
        self.kalman, self.time, last = Axis.pair(values[:10]), values[10], values[11:15]
        self.last, (self.misses, self.segment) = None if last[0] is None else tuple(last), values[15:]

    @staticmethod
    def rating(one, target) -> float:
        total = 0.25 * one["confidence"] + 0.25 * one["score"]
        if target is None:
            total += 0.15
        else:
            d = math.hypot(one["x"] - target[0], one["y"] - target[1])
            total += 0.35 * (1 - d / 80) if d < 80 else -0.3
        return total + (-0.4 if one.get("is_static") else 0.15)

    def reachable(self, one, time) -> bool:
        if self.last is None or time - self.last[2] > 0.5:
            return False
        x, y, t, v = self.last
        d = math.hypot(one["x"] - x, one["y"] - y)
        return not (d > 3 * v * (time - t) and d > 200)

    def step(self, time: float, found: list):
        target = None
        if self.kalman:
            for a in self.kalman:
                a.predict(time - self.time)
            target = tuple(a.p for a in self.kalman)
        self.time = time
        one = max(found, key=lambda f: self.rating(f, target), default=None)
        if one is not None and self.rating(one, target) >= 0.3:
            if self.misses and not self.reachable(one, time):
                self.segment += 1
                self.kalman = None
            if self.kalman:
                for a, z in zip(self.kalman, (one["x"], one["y"])):
                    a.update(z)
            else:
                self.kalman = (Axis(one["x"]), Axis(one["y"]))
            self.last = one["x"], one["y"], time, math.hypot(*(a.v for a in self.kalman))
            self.misses = 0
            return one["x"], one["y"], one["confidence"], "DETECTED", self.segment
        self.misses += 1
        if target is not None and self.misses <= 3:
            return fixed(target[0]), fixed(target[1]), 0.0, f"PREDICTED_{self.misses}", self.segment
        if self.misses > 10:
            self.kalman = None
            self.segment += 1
        return None, None, None, "LOST", self.segment


def overlap(a, b) -> int:
    """Intersection by union of two boxes (x1, y1, x2, y2), in millionths."""
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0
    both = w * h
    return math.floor(both / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both) * 1e6 + 0.5)


class PersonTracks:
    """Track ids for boxes of persons. Confident boxes are matched first, the rest then with tracks seen in the frame before; in each stage
    the pair of most overlap goes first (ties: older track, more confident box). A track moves on at its last pace while it
    isn't seen, and is forgotten after `buffer_frames`; a confident box without a track starts one."""

    schema = "id long, track_id long"

    def __init__(self, config: AssociationConfig = AssociationConfig()):
        self.config, self.tracks, self.born = config, {}, 0

    @staticmethod
    def matches(tracks: dict, boxes: list, least: float) -> list[tuple[int, int]]:
        pairs = ((-overlap(t, b[2:6]), i, k) for i, t in tracks.items() for k, b in boxes)
        taken, found = (set(), set()), []
        for share, i, k in sorted(p for p in pairs if -p[0] >= least * 1e6):
            if i not in taken[0] and k not in taken[1]:
                taken[0].add(i)
                taken[1].add(k)
                found.append((i, k))
        return found

    def step(self, frame: int, found: list):
        """found: (id, confidence, x1, y1, x2, y2), most confident first."""
        at = self.config
        self.tracks = {i: t for i, t in self.tracks.items() if frame - t[6] <= at.buffer_frames}
        moved = {i: (t[0] + t[4] * (frame - t[6]), t[1] + t[5] * (frame - t[6]), t[2] + t[4] * (frame - t[6]), t[3] + t[5] * (frame - t[6])) for i, t in self.tracks.items()}
        found = [tuple(b.values()) if isinstance(b, dict) else tuple(b) for b in found]
        boxes = list(enumerate(found))
        high = [b for b in boxes if b[1][1] >= at.high_confidence]
        low = [b for b in boxes if at.low_confidence <= b[1][1] < at.high_confidence]
        first = self.matches(moved, high, at.minimum_overlap)
        seen = {i for i, _ in first}
        left = {i: b for i, b in moved.items() if i not in seen and frame - self.tracks[i][6] == 1}
        given = {k: i for i, k in first + self.matches(left, low, at.minimum_low_overlap)}
        for k, b in high:
            if k not in given:
                self.born += 1
                given[k] = self.born
        for k, i in sorted(given.items()):
            x1, y1, x2, y2 = found[k][2:6]
            old = self.tracks.get(i)
            vx, vy = (0.0, 0.0) if old is None else (((x1 + x2) / 2 - (old[0] + old[2]) / 2) / (frame - old[6]), ((y1 + y2) / 2 - (old[1] + old[3]) / 2) / (frame - old[6]))
            self.tracks[i] = (x1, y1, x2, y2, vx, vy, frame)
            yield frame, found[k][0], i

    def end(self):
        return ()


def person_tracks(boxes: DataFrame, config: AssociationConfig = AssociationConfig()) -> DataFrame:
    """video_id, frame_number, id, track_id of the boxes (video_id, frame_number, id, confidence, x1, y1, x2, y2) that have a track. One
    exchange by video: the boxes of a frame are grouped where they are."""
    one = F.struct((-F.col("confidence")).alias("minus"), "id", "confidence", "x1", "y1", "x2", "y2")
    lists = boxes.repartition("video_id").groupBy("video_id", "frame_number").agg(F.sort_array(F.collect_list(one)).alias("list"))
    plain = lists.select("video_id", "frame_number", F.transform("list", lambda b: F.struct(*(b[k].alias(k) for k in ("id", "confidence", "x1", "y1", "x2", "y2")))).alias("boxes"))
    return folds.folded(plain, ["video_id"], ["frame_number"], ["frame_number", "boxes"], lambda: PersonTracks(config), "video_id long, frame_number long, id long, track_id long")


class StableLabels(Kept):
    """Player labels that follow track ids (a candidate's id), far player first; a label is given once in a frame."""

    schema = "labels map<string,string>"
    names = ("Player A", "Player B")

    def __init__(self):
        self.known: dict[int, str] = {}

    MAP = ("track long", "label string")

    def saved(self):
        return (), self.known

    def restore(self, values, known):
        self.known = dict(known)

    def step(self, time: float, found: list):
        used: set[str] = set()
        out = {}
        for place, one in enumerate(sorted(found, key=lambda f: f["y"])):
            track, free = int(one["id"]), [n for n in self.names if n not in used]
            label = self.known.get(track)
            if label is None:
                label = self.names[0] if place == 0 and self.names[0] in free else (free[-1] if free else f"Track {track}")
            elif label in used and label in self.names:
                label = free[0] if free else f"Track {track}"
            self.known[track] = label
            used.add(label)
            out[str(track)] = label
        return (list(out.items()),)


class ZonePlayer(Kept):
    """The player of one zone: the only candidate, or the best by confidence, size (score: the box's area) and nearness to
    the last place, which is kept for 30 missed frames."""

    schema = "id long, x double, y double, reason string"

    def __init__(self, reach: float = 200.0, most: int = 30):
        self.at, self.missed, self.reach, self.most = None, 0, reach, most

    STATE = "x double, y double, missed int"

    def saved(self):
        return (*(self.at or (None, None)), self.missed), {}

    def restore(self, values, known):
        x, y, self.missed = values
        self.at = None if x is None else (x, y)

    def rating(self, one) -> float:
        total = 0.3 * one["confidence"] + 0.001 * math.sqrt(one["score"])
        if self.at is not None and (d := math.hypot(one["x"] - self.at[0], one["y"] - self.at[1])) < self.reach:
            total += 0.7 * (1 - d / self.reach)
        return total

    def step(self, time: float, found: list):
        if not found:
            self.missed += 1
            if self.missed > self.most:
                self.at = None
            return None, None, None, None
        one = max(found, key=self.rating)
        self.at, self.missed = (one["x"], one["y"]), 0
        return int(one["id"]), one["x"], one["y"], "only_candidate" if len(found) == 1 else "best_scored"


class CourtPlayers(Kept):
    """Players A and B among persons in court metres (y grows away from the camera; score: the box's area), with track ids
    that are remembered."""

    schema = "player_a long, player_b long"

    def __init__(self, court: CourtConfig = CourtConfig()):
        self.court, self.ids = court, (set(), set())

    MAP = ("track long", "players int")  # 1: player A, 2: player B, 3: has been both

    def saved(self):
        return (), {i: (i in self.ids[0]) + 2 * (i in self.ids[1]) for i in self.ids[0] | self.ids[1]}

    def restore(self, values, known):
        self.ids = {i for i, who in known.items() if who & 1}, {i for i, who in known.items() if who & 2}

    def step(self, time: float, found: list):
        if not found:
            return None, None
        if len(found) == 1:
            track = int(found[0]["id"])
            who = 0 if track in self.ids[0] else 1 if track in self.ids[1] else 0 if found[0]["y"] >= self.court.net_to_baseline else 1
            self.ids[who].add(track)
            return (track, None) if who == 0 else (None, track)
        rating = lambda f: 0.4 * f["confidence"] + 0.001 * math.sqrt(f["score"]) + 0.5 * (int(f["id"]) in self.ids[0] | self.ids[1])
        two = sorted(found, key=rating, reverse=True)[:2] if len(found) > 2 else found
        far, near = (int(f["id"]) for f in sorted(two, key=lambda f: f["y"], reverse=True))
        self.ids[0].add(far)
        self.ids[1].add(near)
        return far, near


def track_summary(tracked: DataFrame) -> DataFrame:
    """Of each video: detected, predicted and lost frames, and the last velocity and misses."""
    n = lambda s: F.count_if(F.col("source") == s).alias(s)
    last = lambda c: F.max_by(c, "frame_number").alias(f"last_{c}")
    return tracked.groupBy("video_id").agg(n("detected"), n("predicted"), n("lost"), last("vx"), last("vy"), last("missed"))


def windowed_player_speed(samples: DataFrame, most_meters: float = 5.0, most_kmh: float = 40.0, size: int = 5) -> DataFrame:
    """Distance by time over the last `size` samples of a player (court_x, court_y): null where there are fewer, or too fast."""
    w = Window.partitionBy("track_id").orderBy("timestamp_seconds", "frame_number")
    c = F.col
    dt = c("timestamp_seconds") - F.lag("timestamp_seconds").over(w)
    d = G.distance(F.lag("court_x").over(w), F.lag("court_y").over(w), c("court_x"), c("court_y"))
    out = samples.withColumns({"dt": dt, "d": d, "place": F.row_number().over(w)})
    ok = (c("dt") > 0) & (c("d") < most_meters)
    recent = w.rowsBetween(2 - size, 0)
    out = out.withColumn("kmh", F.try_divide(F.sum(F.when(ok, c("d"))).over(recent), F.sum(F.when(ok, c("dt"))).over(recent)) * 3.6)
    return out.withColumn("speed_kmh", F.when((c("place") >= size) & (c("kmh") < most_kmh), F.round("kmh", 3))).drop("dt", "d", "place", "kmh")


def median_ball_speed(confirmed: DataFrame, size: int = 15) -> DataFrame:
    """The median speed over the last `size` confirmed points (court_x, court_y, confidence): null of fewer than two samples.
    Exact: an array of at most size - 1 values is sorted."""
    w = Window.partitionBy("track_id").orderBy("timestamp_seconds", "frame_number")
    c = F.col
    before = lambda k: F.lag(k).over(w)
    dt = c("timestamp_seconds") - before("timestamp_seconds")
    d = G.distance(before("court_x"), before("court_y"), c("court_x"), c("court_y"))
    kmh = F.try_divide(d, dt) * 3.6
    ok = (dt > 0) & (d < 15.0) & (kmh > 10) & (kmh < 300) & (F.least("confidence", before("confidence")) > 0.2)
    out = confirmed.withColumn("sample", F.when(ok, kmh))
    out = out.withColumn("samples", F.array_sort(F.collect_list("sample").over(w.rowsBetween(2 - size, 0))))
    n = F.size("samples")
    middle = (F.get("samples", F.floor((n - 1) / 2).cast("int")) + F.get("samples", F.floor(n / 2).cast("int"))) / 2
    return out.withColumn("speed_kmh", F.when(n >= 2, F.round(middle, 3))).drop("sample", "samples")
