"""Connected components by star merging, for many small graphs at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rallyframe.sources.shared import Shared


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every neighbour above a node is linked with the smallest node around it."""
    both = edges.unionByName(edges.select(*keys, F.col("w").alias("u"), F.col("u").alias("w")))
    least = F.least("u", F.min("w").over(Window.partitionBy(*keys, "u")))
    return both.withColumn("m", least).where("w > u").select(*keys, F.col("w").alias("u"), F.col("m").alias("w")).distinct()


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """A node and all its neighbours below it are linked with the smallest of these."""
    found = edges.withColumn("m", F.min("w").over(Window.partitionBy(*keys, "u")))
    pairs = F.explode(F.array(F.struct("u", F.col("m").alias("w")), F.struct(F.col("w").alias("u"), F.col("m").alias("w"))))
    return found.select(*keys, pairs.alias("p")).select(*keys, "p.u", "p.w").where("u > w").distinct()


def components(nodes: DataFrame, edges: DataFrame, keys: list[str], shared: Shared) -> DataFrame:
    """The columns of nodes (keys, node, ...) and component: the smallest node that can be reached. edges: keys, u, w.

    Each round is a pair of large and small stars over edges partitioned by the keys, so it has one exchange; rounds grow with the
    logarithm of a graph's diameter. A round's table is deleted when the next one is written."""
    apart = F.col("u") != F.col("w")
    edges = edges.where(apart).select(*keys, F.greatest("u", "w").alias("u"), F.least("u", "w").alias("w")).distinct()
    edges, before = shared.written(edges), None
    while True:
        total = edges.agg(F.count("*"), F.sum(F.xxhash64(*keys, "u", "w").cast("decimal(20,0)"))).first()
        if tuple(total) == before or not total[0]:
            break
        before, last = tuple(total), shared.count
        edges = shared.written(_small_star(_large_star(edges.repartition(*keys), keys), keys))
        shared.drop(last)
    found = edges.select(*keys, F.col("u").alias("node"), F.col("w").alias("component"))
    return nodes.join(found, [*keys, "node"], "left").withColumn("component", F.coalesce("component", "node"))
