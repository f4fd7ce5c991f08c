"""Connected components by alternating stars, each round an aggregate and a join."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(least, "u").where("v <> m").select("v", "m").union(least.select("u", "m")).toDF("u", "v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str = "stars") -> DataFrame:
    """edges (u, v) of one ordered type -> (node, root): root is the smallest node reachable, for nodes with links.

    Stops when a round leaves the edge set as it was (row count and two order-free sums of hashes). Nothing but
    these three numbers reaches the driver. The result is the scratch table `name`; each round replaces the last.
    """
    edges = scratch.write(name, edges.where("u <> v").select("u", "v").distinct())
    mark = None
    while True:
        sums = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.hash("v", "u").cast("bigint"))).first()
        if mark == tuple(sums) or not sums[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(sums)
        edges = scratch.write(name, small_star(large_star(edges)))


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable, for each of n nodes."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return label
        label = new
