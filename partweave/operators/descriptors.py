"""Shape contexts, histograms of compositions, co-occurrence maps, moments."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partweave.functions.geometry import ellipse, polar_bin
from partweave.operators.keyed import by_keys, near_pairs, owners
from partweave.operators.ranges import window_join


def shape_contexts(nodes: DataFrame, *, angles: int, radii: list[float]) -> DataFrame:
    """(image_id, node_id, bin, n): occupied positions around each node by sector
    and ring."""
    reach = int(max(radii))
    occupied = nodes.select("image_id", "x", "y").distinct()
    met = window_join(nodes.select("image_id", "node_id", "x", "y"), occupied, ["image_id"], reach, reach)
    bin_ = polar_bin(F.col("o_x") - F.col("x"), F.col("o_y") - F.col("y"), angles, radii)
    return met.withColumn("bin", bin_).where("bin IS NOT NULL").groupBy("image_id", "node_id", "bin").agg(F.count(F.lit(1)).alias("n"))


def dense_histogram(bins: DataFrame, keys: list[str], size: int, value: str = "n") -> DataFrame:
    """(keys, h): an array with a place per bin."""
    sums = bins.groupBy(*keys).agg(*[F.sum(F.when(F.col("bin") == b, F.col(value).cast("double"))).alias(f"_{b}") for b in range(size)])
    return sums.select(*keys, F.array(*[F.coalesce(f"_{b}", F.lit(0.0)) for b in range(size)]).alias("h"))


def compositions(nodes: DataFrame, window: int, step: int, grid: int) -> DataFrame:
    """Histogram of compositions: per sliding window, grid cell and type the share
    of summed r. (image_id, wx, wy, bin, m, share)."""
    spread = nodes.withColumn("wx", F.explode(F.sequence(F.floor((F.col("x") - window) / step).cast("int") + 1, F.floor(F.col("x") / step).cast("int")))).withColumn(
        "wy", F.explode(F.sequence(F.floor((F.col("y") - window) / step).cast("int") + 1, F.floor(F.col("y") / step).cast("int")))
    )
    side = window / grid
    ix, iy = F.floor((F.col("x") - F.col("wx") * step) / side), F.floor((F.col("y") - F.col("wy") * step) / side)
    sums = spread.withColumn("bin", (iy * grid + ix).cast("int")).groupBy("image_id", "wx", "wy", "bin", "m").agg(F.sum("r").alias("s"))
    whole = F.sum("s").over(Window.partitionBy("image_id", "wx", "wy"))
    return sums.withColumn("share", F.col("s") / whole).drop("s")


def cooccurrence(nodes: DataFrame, radius: int, least_distance: int = 1) -> DataFrame:
    """(mc, mn, dx, dy, v, n): summed r of neighbours by offset and type pair. Neighbours are
    found and summed in the task of their images, so only the sums move."""

    def run(ends: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple:
        owner, x, y = owners(ends), x.astype(np.int64), y.astype(np.int64)
        a, b = near_pairs(owner, x, y, owner, x, y, (-radius, radius), (-radius, radius))
        dx, dy = x[b] - x[a], y[b] - y[a]
        far = np.maximum(np.abs(dx), np.abs(dy)) >= least_distance
        a, b, dx, dy = a[far], b[far], dx[far], dy[far]
        kinds, kind = np.unique(m, return_inverse=True)
        side = 2 * radius + 1
        cells, cell = np.unique(((kind[a] * len(kinds) + kind[b]) * side + dx + radius) * side + dy + radius, return_inverse=True)
        some = ~np.isnan(r[b])
        v = np.bincount(cell[some], r[b][some], minlength=len(cells))
        v[np.bincount(cell[some], minlength=len(cells)) == 0] = np.nan
        pair, at = np.divmod(cells, side * side)
        whole = [kinds[pair // max(1, len(kinds))], kinds[pair % max(1, len(kinds))], at // side - radius, at % side - radius]
        return np.zeros(len(cells), dtype=np.int64), *[c.astype(np.int32) for c in whole], pa.array(v, from_pandas=True), np.bincount(cell, minlength=len(cells))

    rows = nodes.select("image_id", F.col("m").cast("int").alias("m"), F.col("x").cast("int").alias("x"), F.col("y").cast("int").alias("y"), F.col("r").cast("double").alias("r"))
    sums = by_keys(rows.dropna(subset=["image_id", "m", "x", "y"]), ["image_id"], ["m", "x", "y", "r"], [], "mc int, mn int, dx int, dy int, v double, n long", run)
    return sums.groupBy("mc", "mn", "dx", "dy").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))


def moments(points: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, covariance and fitted ellipse of each key's points."""
    got = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"),
        F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"),
    )
    a, b, angle = ellipse(F.col("sxx"), F.col("syy"), F.col("sxy"))
    return got.select(*keys, "n", "mx", "my", a.alias("axis_a"), b.alias("axis_b"), angle.alias("angle"))


def pair_offsets(nodes: DataFrame, radius: int) -> DataFrame:
    """Number and mean of offsets by ordered type pair."""
    met = window_join(nodes.select("image_id", "x", "y", "m", "node_id"), nodes.select("image_id", "x", "y", "m", "node_id"), ["image_id"], radius, radius)
    return (
        met.where("node_id <> o_node_id")
        .groupBy("m", "o_m")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("o_x") - F.col("x")).alias("mean_dx"), F.avg(F.col("o_y") - F.col("y")).alias("mean_dy"))
    )
