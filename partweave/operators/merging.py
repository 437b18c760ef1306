"""Merging of scales, tiles, results and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partweave.operators.ranges import unmatched


def rescaled(nodes: DataFrame, factor: float) -> DataFrame:
    return nodes.withColumns({c: F.round(F.col(c) * factor).cast("int") for c in ("x", "y")})


def merge_scales(first: DataFrame, other: DataFrame, factor: float) -> DataFrame:
    """Nodes of the first scale, and those of the other that, rescaled, find no
    node of their type at their place."""
    both = first.withColumn("_s", F.lit(0)).unionByName(rescaled(other, factor).withColumn("_s", F.lit(1)))
    w = Window.partitionBy("image_id", "z", "x", "y", "m").orderBy("_s", F.desc("g"), "node_id")
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").withColumnRenamed("_s", "scale").drop("_n")


def merge_results(a: DataFrame, b: DataFrame) -> DataFrame:
    """Per position the node of the higher g."""
    w = Window.partitionBy("image_id", "z", "x", "y").orderBy(F.desc("g"), "m", "node_id")
    return a.unionByName(b).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_tiles(nodes: DataFrame, tiles: DataFrame) -> DataFrame:
    """Tile nodes back in image coordinates; where tiles overlap, the best stays.
    ``tiles`` is (tile_id, ox, oy)."""
    moved = nodes.join(tiles, "tile_id").withColumns({"x": F.col("x") + F.col("ox"), "y": F.col("y") + F.col("oy")}).drop("ox", "oy")
    w = Window.partitionBy("image_id", "z", "x", "y", "m").orderBy(F.desc("g"), "node_id")
    return moved.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "tile_id")


def highest_group(rows: DataFrame) -> DataFrame:
    """Of each group type the members with the highest group id; rows without a
    group pass."""
    top = rows.groupBy(F.col("group_type").alias("_type")).agg(F.max("group_id").alias("_top"))
    # One row a type, so the frequent types' rows need not meet in a task.
    found = rows.join(top, F.col("group_type").eqNullSafe(F.col("_type")), "left")
    return found.where(F.col("group_id").isNull() | (F.col("group_id") == F.col("_top"))).drop("_type", "_top")


def layer_difference(a: DataFrame, b: DataFrame, tolerance: int = 2, keys: tuple[str, ...] = ("image_id", "m")) -> DataFrame:
    """Per image the nodes of b without a node of a of their type nearby."""
    gone = unmatched(b, a, list(keys), tolerance)
    return gone.groupBy("image_id").agg(F.count(F.lit(1)).alias("n_new"))


def sliding_windows(frames: DataFrame, size: int, key: str = "user_id") -> DataFrame:
    """Per frame the aggregate of it and the ``size - 1`` before."""
    w = Window.partitionBy(key).orderBy("frame").rowsBetween(-(size - 1), 0)
    return frames.select(
        key, "frame", F.count(F.lit(1)).over(w).alias("n"), F.sum("value").over(w).alias("sum_value"), F.max("value").over(w).alias("max_value")
    )


def change_sessions(frames: DataFrame, threshold: float, key: str = "user_id") -> DataFrame:
    """Sessions that a change of type from one frame to the next ends when the
    values differ by more than the threshold."""
    w = Window.partitionBy(key).orderBy("frame")
    new = (F.lag("value").over(w).isNull() | (F.abs(F.col("value") - F.lag("value").over(w)) > threshold)).cast("int")
    marked = frames.withColumn("_new", new).withColumn("session", F.sum("_new").over(w))
    return marked.groupBy(key, "session").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))
