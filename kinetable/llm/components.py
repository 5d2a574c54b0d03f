"""Connected components of a table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import written


def _oriented(a, b) -> list:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _with_least(edges: DataFrame, name: str) -> DataFrame:
    """Each edge (u, v) with the smallest neighbour of u.

    The minima are pre-aggregated in the tasks and written, so the join reads two plain shuffles, whose hot
    partitions the engine can split.
    """
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")), name)
    return edges.join(least, "u")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable over the links, for every node of a link between two nodes.

    Alternating large and small stars: every round joins each node's neighbours to its smallest one, so that the
    number of rounds grows with the logarithm of the longest path.  Each round is written to the shared folder.
    """
    edges = links.select(*_oriented(F.col(a), F.col(b))).where("u <> v").distinct()
    edges, before = written(edges, "links"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        before = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours go to the smallest of u and its neighbours
        large = _with_least(both, "large").where("v > u").select(*_oriented(F.col("v"), F.least("u", "m"))).where("u <> v")
        large = written(large.distinct(), "large-star")
        # small star: u and its smaller neighbours go to the smallest of them
        small = _with_least(large, "small")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = written(small.where("u <> v").distinct(), "small-star")


def least_reached(ids: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest id in the component of each of a task's nodes; ``i`` and ``j`` are the ends of its links."""
    least = ids.copy()
    while len(i):
        before = least.copy()
        low = np.minimum(least[i], least[j])
        np.minimum.at(least, i, low)
        np.minimum.at(least, j, low)
        if (least == before).all():
            break
    return least
