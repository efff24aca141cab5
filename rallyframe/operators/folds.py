"""Ordered folds: what a row gives depends on the rows before it under the same key.

The rows of a key meet in one task, sorted by Spark, and go by in Arrow batches; only the state of one key is held, so
a key may have any number of rows. A fold asks for its rows as a window does, so that Spark adds an exchange and a sort only
where the rows aren't placed and in order already."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "map<string,string>": pa.map_(pa.string(), pa.string())}


class State(Protocol):
    def step(self, *row) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def folded(rows: DataFrame, keys: list[str], order: list[str], columns: list[str], make: Callable[[], State], schema: str) -> DataFrame:
    """The keys and what the states give for the columns of each row (step) and at the end of a key (end).

    schema: the keys, then the columns of the result."""
    named = [c.split(" ") for c in schema.split(", ")]
    arrow = pa.schema([(n, _KINDS[k]) for n, k in named])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(zip(*out), arrow)], schema=arrow)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in it:
            out: list[tuple] = []
            for row in zip(*(batch[c].to_pylist() for c in (*keys, *columns))):
                if state is None or row[: len(keys)] != key:
                    if state is not None:
                        out += [(*key, *r) for r in state.end()]
                    key, state = row[: len(keys)], make()
                out += [(*key, *r) for r in state.step(*row[len(keys) :])]
            if out:
                yield batch_of(out)
        if state is not None and (out := [(*key, *r) for r in state.end()]):
            yield batch_of(out)

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.select(*dict.fromkeys([*keys, *order, *columns])).withColumn("_place", place).mapInArrow(run, schema)
