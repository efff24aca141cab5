"""Folds over streams with typed state: what a match or a video holds between batches is a row, or a map, of plain columns.

State lives in the state store under names and column types, so it is read again after a restart and by later versions of the
code, and can be looked at with the state data source. It goes by itself: after a time to live on the clock, or, where rows
have an event_time, when the watermark passes the key's last event by `idle` (a timer). A row that comes after a later one of
its key is told apart and changes nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from rallyframe.config import ScoringConfig
from rallyframe.operators.scoring import BOARD, COUNTS, Score

UNITS = {"millisecond": 1, "second": 1_000, "minute": 60_000, "hour": 3_600_000, "day": 86_400_000, "week": 604_800_000}


def milliseconds(text: str) -> int:
    """Of a number and a unit, such as `10 minutes` or `1 day`."""
    number, _, unit = text.partition(" ")
    if unit.rstrip("s") not in UNITS:
        raise ValueError(f"no length of time: {text}")
    return int(float(number) * UNITS[unit.rstrip("s")])


def stored(spark: SparkSession) -> None:
    """State of several columns needs the state store that is kept on disk; the session's other choice is left alone."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "HDFSBackedStateStoreProvider" in spark.conf.get(name):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Keyed(StatefulProcessor):
    """Rows of a key in order, its state, and when that goes."""

    def __init__(self, idle: int | None, timed: bool):
        self.idle, self.timed = idle, timed

    @property
    def ttl(self) -> int | None:
        return None if self.timed else self.idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle

    def awake(self, pdf: pd.DataFrame) -> None:
        """Puts the key's timer `idle` behind its last event."""
        if self.timed and self.idle:
            known = list(self.handle.listTimers())
            wanted = int(pdf["event_time"].max().timestamp() * 1000) + self.idle
            if not known or wanted > max(known):
                for timer in known:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(wanted)

    def close(self) -> None:
        pass


class Scores(Keyed):
    STATE = ", ".join(f"{c} int" for c in COUNTS) + ", in_tiebreak boolean, match_winner string, last_point long"

    def __init__(self, config: ScoringConfig, idle: int | None, timed: bool):
        super().__init__(idle, timed)
        self.config = config

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.score = handle.getValueState("score", self.STATE, self.ttl)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        score, last = Score(self.config), None
        if self.score.exists():
            *counts, score.in_tiebreak, winner, last = self.score.get()
            score.points, score.games, score.sets, score.tie = (list(counts[i : i + 2]) for i in (0, 2, 4, 6))
            score.winner = None if winner is None else "AB".index(winner)
        pdf = pd.concat(rows).sort_values("point_number", kind="stable")
        out = []
        for number, winner in zip(pdf["point_number"].tolist(), pdf["winner"]):
            late = last is not None and number < last
            events = ["late"] if late else score.award("AB".index(winner))
            last = number if last is None else max(last, number)
            won = None if score.winner is None else "AB"[score.winner]
            out.append((key[0], number, winner, late or events is None, score.in_tiebreak, *score.points, *score.games, *score.sets, *score.tie, won, ",".join(events or [])))
        self.score.update((*score.points, *score.games, *score.sets, *score.tie, score.in_tiebreak, None if score.winner is None else "AB"[score.winner], last))
        self.awake(pdf)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in BOARD.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.score.clear()
        return iter(())


def _mode(rows: DataFrame, idle: str | None) -> tuple[int | None, bool, str]:
    """The time that state is kept, whether timers follow event_time, and Spark's name for that."""
    timed = bool(idle) and "event_time" in rows.columns
    return (milliseconds(idle) if idle else None), timed, "EventTime" if timed else "ProcessingTime" if idle else "None"


def stream_scores(points: DataFrame, config: ScoringConfig = ScoringConfig(), idle: str | None = None) -> DataFrame:
    """The score after each point of a stream of match_id, point_number, winner. Points of a batch are sorted; one that comes after a later
    point of its match has been scored is rejected with the event `late`. idle: how long a match without points is kept (none: for
    good), by event_time (with a watermark) if points have it, else by the clock."""
    stored(points.sparkSession)
    keep, timed, mode = _mode(points, idle)
    some = points.select("match_id", "point_number", "winner", *(["event_time"] if timed else []))
    return some.groupBy("match_id").transformWithStateInPandas(Scores(config, keep, timed), BOARD, "Append", mode)


class Tracked(Keyed):
    """A tracker of a video. Its state is a row of the columns in STATE, and a map where it has one (MAP: key and value)."""

    def __init__(self, make, schema: str, idle: int | None, timed: bool):
        super().__init__(idle, timed)
        named = [c.split(" ") for c in schema.split(", ")]
        self.make, self.names, self.maps = make, ["video_id", "frame_number", "late", *(n for n, _ in named)], [n for n, kind in named if kind.startswith("map<")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.row = handle.getValueState("tracker", ", ".join(filter(None, (self.make.STATE, "last long"))), self.ttl)
        self.map = handle.getMapState("known", *self.make.MAP, self.ttl) if self.make.MAP else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tracker, last, known = self.make(), -1, {}
        if self.row.exists():
            *values, last = self.row.get()
            known = {k[0]: v[0] for k, v in self.map.iterator()} if self.map else {}
            tracker.restore(tuple(values), known)
        pdf = pd.concat(rows).sort_values("frame_number", kind="stable")
        out = []
        for frame, time, found in zip(pdf["frame_number"].tolist(), pdf["timestamp_seconds"].tolist(), pdf["candidates"]):
            late = frame <= last
            step = (None,) * (len(self.names) - 3) if late else tracker.step(time, [c if isinstance(c, dict) else c.asDict() for c in found])
            out.append((key[0], frame, late, *step))
            last = max(last, frame)
        values, now = tracker.saved()
        self.row.update((*values, last))
        for k, v in now.items():
            if known.get(k) != v:
                self.map.updateValue((k,), (v,))
        self.awake(pdf)
        pdf = pd.DataFrame(out, columns=self.names)
        for name in self.maps:
            pdf[name] = [v if v is None else dict(v) for v in pdf[name]]
        yield pdf

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.row.clear()
        if self.map:
            self.map.clear()
        return iter(())


def stream_tracked(frames: DataFrame, make, schema: str, idle: str | None = None) -> DataFrame:
    """A tracker (its class) over a stream of frames with their candidates, as trackers.frames_with_candidates makes them: one row for each
    frame, as trackers.folded gives, and `late`. Frames of a batch are sorted; one that comes after a later frame of its video, or
    again, is late and has nothing else. idle: as for stream_scores()."""
    stored(frames.sparkSession)
    keep, timed, mode = _mode(frames, idle)
    some = frames.select("video_id", "frame_number", "timestamp_seconds", "candidates", *(["event_time"] if timed else []))
    out = f"video_id long, frame_number long, late boolean, {schema}"
    return some.groupBy("video_id").transformWithStateInPandas(Tracked(make, schema, keep, timed), out, "Append", mode)


def score_events(board: DataFrame) -> DataFrame:
    """match_id, point_number, place (order within the point), event, winner, and the state after the point, of every event of a board. A
    point that doesn't count has the event `rejected`, or `late`."""
    names = F.when(F.col("events") != "", F.split("events", ",")).when(F.col("rejected"), F.array(F.lit("rejected"))).otherwise(F.array().cast("array<string>"))
    state = F.struct(*COUNTS, "in_tiebreak", "match_winner").alias("state")
    return board.select("match_id", "point_number", "winner", state, F.posexplode(names).alias("place", "event")).select("match_id", "point_number", "place", "event", "winner", "state")
