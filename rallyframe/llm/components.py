"""Connected components of links between 64-bit nodes, inside a task and over the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rallyframe.llm import common


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links u-v: every node but the least of its component, and that least node."""
    nodes, k = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = k[: len(u)], k[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def roots(links: DataFrame) -> DataFrame:
    """`node, root` for links `u, v` (long): the least node of its component for each node that has a link to another.

    Alternates the two star operations: first every node hands its larger neighbours to its least one, then its smaller
    ones. Each round is a grouped minimum (combined before the shuffle) and a join that AQE can split, its result is a
    table in the shared folder, and the number of rounds grows with the logarithm of the longest path."""
    edges = common.written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    sign = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = common.written(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = common.written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        last, sign = sign, tuple(new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        edges = new
        if sign == last:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
