"""Boxes against ground truth: hits, misses, precision and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partweave.functions.geometry import columns_box, covered_share, intersection_area, area, iou
from partweave.operators.ranges import box_pairs


def best_iou(boxes: DataFrame, truth: DataFrame, keys: list[str], id_col: str = "box_id") -> DataFrame:
    """Every box with the best overlap over the truths of equal keys (0 if none)."""
    met = box_pairs(boxes, truth, keys).select(id_col, iou(columns_box(), columns_box("o_")).alias("iou"))
    best = met.groupBy(id_col).agg(F.max("iou").alias("best_iou"))
    return boxes.join(best, id_col, "left").withColumn("best_iou", F.coalesce("best_iou", F.lit(0.0)))


def hits_and_misses(boxes: DataFrame, truth: DataFrame, keys: list[str], threshold: float, by: list[str]) -> DataFrame:
    found = best_iou(boxes, truth, keys)
    return found.groupBy(*by).agg(
        F.count_if(F.col("best_iou") >= threshold).alias("hits"), F.count_if(F.col("best_iou") < threshold).alias("misses")
    )


def truth_hits(boxes: DataFrame, truth: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """Per truth the number of boxes that hit it."""
    met = box_pairs(boxes, truth, keys).where(iou(columns_box(), columns_box("o_")) >= threshold)
    hits = met.groupBy(F.col("o_gt_id").alias("gt_id")).agg(F.count(F.lit(1)).alias("n_hits"))
    return truth.join(hits, "gt_id", "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))


def split_by_overlap(boxes: DataFrame, truth: DataFrame, keys: list[str], low: float, high: float) -> DataFrame:
    """``role``: positive at best overlap >= high, negative at <= low; boxes between go."""
    found = best_iou(boxes, truth, keys)
    role = F.when(F.col("best_iou") >= high, "positive").when(F.col("best_iou") <= low, "negative")
    return found.withColumn("role", role).where("role IS NOT NULL")


def outside_regions(boxes: DataFrame, regions: DataFrame, keys: list[str], id_col: str = "box_id") -> DataFrame:
    """Boxes that intersect no region."""
    return boxes.join(box_pairs(boxes, regions, keys).select(id_col).distinct(), id_col, "left_anti")


def mutual_coverage(a: DataFrame, b: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Per key the pairs whose intersection is at least ``share`` of both boxes."""
    left, right = columns_box(), columns_box("o_")
    inter = intersection_area(left, right)
    met = box_pairs(a, b, keys).where((inter >= share * area(left)) & (inter >= share * area(right)))
    return met.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_pairs"))


def precision_recall(boxes: DataFrame, truth: DataFrame, keys: list[str], threshold: float, by: list[str]) -> DataFrame:
    """Confidence-ordered cumulative precision and recall per ``by``. Running sums
    within the grouping columns; use a fine-grained ``by`` on large data."""
    found = best_iou(boxes, truth, keys)
    w = Window.partitionBy(*by).orderBy(F.desc("val"), F.asc("box_id")).rowsBetween(Window.unboundedPreceding, 0)
    tp = (F.col("best_iou") >= threshold).cast("long")
    totals = truth.groupBy(*by).agg(F.count(F.lit(1)).alias("n_truth"))
    return (
        found.join(totals, by)
        .withColumns({"tp": F.sum(tp).over(w), "n": F.count(F.lit(1)).over(w)})
        .select(*by, "box_id", "val", "tp", "n", (F.col("tp") / F.col("n")).alias("precision"), (F.col("tp") / F.col("n_truth")).alias("recall"))
    )


def tile_truths(tiles: DataFrame, truth: DataFrame, keys: list[str], share: float) -> DataFrame:
    """Truths moved into the tiles that cover at least ``share`` of them."""
    met = box_pairs(tiles, truth, keys).where(covered_share(columns_box(), columns_box("o_")) >= share)
    return met.select(
        *keys, "tile_id", F.col("o_gt_id").alias("gt_id"),
        (F.col("o_llx") - F.col("llx")).alias("llx"), (F.col("o_lly") - F.col("lly")).alias("lly"),
        (F.col("o_urx") - F.col("llx")).alias("urx"), (F.col("o_ury") - F.col("lly")).alias("ury"),
    )


def mean_overlap_by_type(boxes: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    return best_iou(boxes, truth, keys).groupBy("m").agg(F.avg("best_iou").alias("mean_iou"), F.count(F.lit(1)).alias("n"))


def hard_negatives(boxes: DataFrame, truth: DataFrame, keys: list[str], threshold: float, every: int, by: list[str]) -> DataFrame:
    """Misses by descending value, an evenly spaced one of ``every`` kept."""
    missed = best_iou(boxes, truth, keys).where(F.col("best_iou") < threshold)
    w = Window.partitionBy(*by).orderBy(F.desc("val"), F.asc("box_id"))
    return missed.withColumn("rn", F.row_number().over(w)).where((F.col("rn") - 1) % every == 0)
