"""What comes out of a stream: listeners for its events, writes that a repeated batch leaves as they are, and counters."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

#: Called with the events of a batch and its number; the same batch may come again after a failure.
Listener = Callable[[DataFrame, int], None]
ANY = "*"


def written_once(path: str) -> Listener:
    """A listener that keeps the rows of every batch under path, each batch in a folder of its own: a batch that comes again replaces what it
    has written before, whole or in part, so nothing is there twice. Read with `batch` as a further column."""

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")

    return write


def delivered(events: DataFrame, listeners: dict[str, list[Listener]], checkpoint: str, **options: str) -> StreamingQuery:
    """Starts a query that hands the rows of each batch, by their `event`, to those who listen for it; `*` gets all. A batch is computed once
    for all of them. Without options everything there is is read and the query ends."""
    for name, some in listeners.items():
        if not name.strip() or not all(callable(f) for f in some):
            raise ValueError(f"listeners of {name!r}: a name and functions are needed")

    def hand_out(rows: DataFrame, batch: int) -> None:
        rows.persist()
        try:
            for name, some in listeners.items():
                for listener in some:
                    listener(rows if name == ANY else rows.where(F.col("event") == name), batch)
        finally:
            rows.unpersist()

    return events.writeStream.foreachBatch(hand_out).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()


def counted(rows: DataFrame, name: str, **measures: Column) -> DataFrame:
    """The same rows; measures (aggregates) of every batch are told to listeners of the query under that name."""
    return rows.observe(name, *(m.alias(k) for k, m in measures.items()))


class Counters(StreamingQueryListener):
    """Sums of what counted() tells, by name and measure, over the batches of all queries it hears of; a batch counts once."""

    def __init__(self):
        self.seen: dict[tuple, dict[str, int]] = {}
        self.ended: list[str] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        for name, row in progress.observedMetrics.items():
            self.seen[str(progress.id), progress.batchId, name] = row.asDict()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended.append(str(event.id))

    def totals(self) -> dict[str, dict[str, int]]:
        sums: dict[str, dict[str, int]] = {}
        for (_, _, name), measures in self.seen.items():
            own = sums.setdefault(name, {})
            for k, v in measures.items():
                own[k] = own.get(k, 0) + (v or 0)
        return sums

    def __str__(self) -> str:
        return json.dumps(self.totals(), sort_keys=True)
