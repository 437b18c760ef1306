"""Path maps: points and histograms keyed by edge paths; paths in trees.

A path map is a table (key columns, path, x, y, h); ``path`` is a string of edge
indices joined by dots.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.functions.arrays import chi_square
from partweave.operators.keyed import by_keys, lists


def under(maps: DataFrame, index: int) -> DataFrame:
    """The map with an edge index put before every path."""
    return maps.withColumn("path", F.concat_ws(".", F.lit(str(index)), "path"))


def mean_paths(maps: DataFrame, keys: list[str]) -> DataFrame:
    """Mean point per key and path with its count; partial means merge by count."""
    return maps.groupBy(*keys, "path").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count(F.lit(1)).alias("n"))


def completed(maps: DataFrame, full: DataFrame) -> DataFrame:
    """``maps`` with the paths that only ``full`` has."""
    more = full.join(maps.select("path").distinct(), "path", "left_anti")
    return maps.withColumn("added", F.lit(False)).unionByName(more.withColumn("added", F.lit(True)))


def matched(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Per key the paths of a found in b, the mean displacement, the summed
    chi-square distance of their histograms and the number without partner."""
    other = b.select(F.col(key).alias("k"), F.col("path").alias("p"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("h").alias("oh"))
    met = a.join(other, (F.col(key) == F.col("k")) & (F.col("path") == F.col("p")), "left")
    return met.groupBy(key).agg(
        F.count("p").alias("n_matched"), F.count_if(F.col("p").isNull()).alias("n_unmatched"),
        F.avg(F.col("ox") - F.col("x")).alias("mean_dx"), F.avg(F.col("oy") - F.col("y")).alias("mean_dy"), F.sum(chi_square(F.col("h"), F.col("oh"))).alias("chi"),
    )


def _farthest(near: dict[int, list[int]], start: int) -> list[int]:
    before, depth, queue = {start: None}, {start: 0}, [start]
    for v in queue:
        for w in near[v]:
            if w not in before:
                before[w], depth[w] = v, depth[v] + 1
                queue.append(w)
    end = min(depth, key=lambda v: (-depth[v], v))
    path = [end]
    while before[path[-1]] is not None:
        path.append(before[path[-1]])
    return path[::-1]


def longest_paths(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, path): the longest path by node count of each key's tree (edges a, b),
    by two searches; ties go to smaller ids."""

    def longest(a: np.ndarray, b: np.ndarray) -> list[int]:
        near: dict[int, list[int]] = {}
        for v, w in zip(a.tolist(), b.tolist(), strict=True):
            near.setdefault(v, []).append(w)
            near.setdefault(w, []).append(v)
        for ends in near.values():
            ends.sort()
        return _farthest(near, _farthest(near, min(near))[-1])

    def run(ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
        return np.arange(len(ends) - 1), lists([longest(a[i:j], b[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)])

    return by_keys(edges, keys, ["a", "b"], ["a", "b"], "path array<long>", run)
