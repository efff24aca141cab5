"""As-of join of two tables: for each row the last row of the other table, of the same key, that isn't later.

Rows of both sides meet by key and slice of time, so a key with very many rows is spread over its slices; inside a slice a
window carries the last row of the right side on. What a slice begins with is the last row of the slices before it, found on a
table of one row for each key and slice, and joined back by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

c = F.col


def asof_join(left: DataFrame, right: DataFrame, key: str, time: str, values: list[str], tolerance: float | None = None, slice_length: float = 3600.0, ties: list[str] | None = None) -> DataFrame:
    """left with the values of the last row of right (key, time, values) that is no later, and `matched_at`, its time. At equal times the
    row counts; among such rows the one of the greatest `ties` (else values). Nulls where there is none, or none within the tolerance.
    A null key or time has no match."""
    order = ties or values
    held = F.struct(c(time).alias("at"), *(c(v).alias(f"o_{i}") for i, v in enumerate(order)), *(c(v).alias(f"v_{i}") for i, v in enumerate(values))).alias("r")
    ok = c(key).isNotNull() & c(time).isNotNull()
    names = [f"l_{i}" for i in range(len(left.columns))]
    mine = left.select(c(key).alias("k"), c(time).alias("t"), F.lit(True).alias("is_left"), F.struct(*(c(f"`{n}`").alias(a) for n, a in zip(left.columns, names, strict=True))).alias("l"))
    other = right.where(ok).select(c(key).alias("k"), c(time).alias("t"), F.lit(False).alias("is_left"), held)
    rows = mine.unionByName(other, allowMissingColumns=True).withColumn("slice", F.floor(c("t") / slice_length))
    # the right side's last row of each slice, carried over the slices of a key
    last = other.withColumn("slice", F.floor(c("t") / slice_length)).groupBy("k", "slice").agg(F.max("r").alias("r"))
    starts = rows.where("is_left").select("k", "slice").distinct()
    before = Window.partitionBy("k").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    both = last.join(starts, ["k", "slice"], "full").withColumn("carried", F.last("r", ignorenulls=True).over(before)).select("k", "slice", "carried")
    w = Window.partitionBy("k", "slice").orderBy("t", "is_left", "r").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.withColumn("own", F.last("r", ignorenulls=True).over(w)).where("is_left")
    found = seen.join(both, ["k", "slice"], "left").withColumn("r", F.coalesce("own", "carried"))
    near = c("r").isNotNull() if tolerance is None else c("t") - c("r.at") <= tolerance
    value = lambda name: F.when(near, c(f"r.{name}"))
    return found.select(*(c(f"l.{a}").alias(n) for n, a in zip(left.columns, names, strict=True)), value("at").alias("matched_at"), *(value(f"v_{i}").alias(v) for i, v in enumerate(values)))
