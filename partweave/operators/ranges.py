"""Spatial joins: windows, nearest neighbours and theta joins as equi-joins.

Points fall into square cells as wide as the window, or 8; the left side is written once for
each of the one to four cells that its window touches, and the join is on (keys, cell).
So a window join never compares all pairs of an image, and where both sides are dealt by
a key already, nothing moves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_join(left: DataFrame, right: DataFrame, keys: list[str], dx: int, dy: int, how: str = "inner", on: Column | None = None) -> DataFrame:
    """Rows of ``left`` with those of ``right`` within dx, dy. Both have x, y and
    the keys; the right side's other columns and x, y come out prefixed ``o_``."""
    w, h = max(8, 2 * dx + 1), max(8, 2 * dy + 1)
    touched = lambda c, r, n: F.explode(F.sequence(F.floor((F.col(c) - r) / n).cast("int"), F.floor((F.col(c) + r) / n).cast("int")))
    other = right.select(*[F.col(k).alias(f"k_{k}") for k in keys], *[F.col(c).alias(f"o_{c}") for c in right.columns if c not in keys])
    other = other.withColumns({"cx": F.floor(F.col("o_x") / w).cast("int"), "cy": F.floor(F.col("o_y") / h).cast("int")})
    spread = left.withColumn("cx", touched("x", dx, w)).withColumn("cy", touched("y", dy, h))
    inside = (F.abs(F.col("x") - F.col("o_x")) <= dx) & (F.abs(F.col("y") - F.col("o_y")) <= dy)
    match = inside if on is None else inside & on
    condition = (spread["cx"] == other["cx"]) & (spread["cy"] == other["cy"]) & match
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"k_{k}"))
    return spread.join(other, condition, how).drop("cx", "cy", *[f"k_{k}" for k in keys])


def with_model(rows: DataFrame, key: str, model: DataFrame, model_key: str) -> DataFrame:
    """``rows`` with each row of a small table of a model, as the struct ``_p``, whose key is
    theirs. The table goes along as one value, a map by key, so rows need not move to meet
    it, whatever Spark knows of its size."""
    each = model.groupBy(F.col(model_key).alias("_key")).agg(F.collect_list(F.struct(*model.columns)).alias("_rows"))
    whole = each.agg(F.map_from_entries(F.collect_list(F.struct("_key", "_rows"))).alias("_model"))  # one row
    return rows.crossJoin(whole).withColumn("_p", F.explode(F.try_element_at("_model", F.col(key)))).drop("_model")


def neighbour_counts(nodes: DataFrame, keys: list[str], dx: int, dy: int) -> DataFrame:
    """Per node the number, distinct types and mean r of its window, itself included."""
    met = window_join(nodes.select(*keys, "x", "y", "node_id"), nodes.select(*keys, "x", "y", "m", "r"), keys, dx, dy)
    return met.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_near"), F.countDistinct("o_m").alias("n_types"), F.avg("o_r").alias("mean_r"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], radius: int, id_col: str = "node_id") -> DataFrame:
    """Each left row's nearest right row within the window, ties to the smaller id."""
    met = window_join(left, right, keys, radius, radius)
    d2 = (F.col("x") - F.col("o_x")) * (F.col("x") - F.col("o_x")) + (F.col("y") - F.col("o_y")) * (F.col("y") - F.col("o_y"))
    best = met.groupBy(id_col).agg(F.min(F.struct(d2.alias("d2"), F.col(f"o_{id_col}").alias("near_id"))).alias("best"))
    return best.select(id_col, F.col("best.near_id").alias("near_id"), F.col("best.d2").alias("d2"))


def unmatched(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, id_col: str = "node_id") -> DataFrame:
    """Left rows without a right row of the same keys within the tolerance."""
    hit = window_join(left, right.select(*keys, "x", "y"), keys, tolerance, tolerance).select(id_col).distinct()
    return left.join(hit, id_col, "left_anti")


def box_pairs(a: DataFrame, b: DataFrame, keys: list[str], cell: int = 32) -> DataFrame:
    """Pairs of intersecting boxes of equal keys, each pair once: both sides are
    written for the cells they touch, and a pair counts in the cell of its
    intersection's lower corner. Columns of b come prefixed ``o_``."""

    def spread(df: DataFrame, p: str) -> DataFrame:
        lo = lambda c: F.floor(F.col(p + c) / cell).cast("int")
        hi = lambda c: F.floor((F.col(p + c) - 1) / cell).cast("int")
        proper = df.where((F.col(f"{p}urx") > F.col(f"{p}llx")) & (F.col(f"{p}ury") > F.col(f"{p}lly")))
        return proper.withColumn("cx", F.explode(F.sequence(lo("llx"), hi("urx")))).withColumn("cy", F.explode(F.sequence(lo("lly"), hi("ury"))))

    left = spread(a, "")
    right = spread(b.select(*[F.col(k).alias(f"k_{k}") for k in keys], *[F.col(c).alias(f"o_{c}") for c in b.columns if c not in keys]), "o_")
    condition = (left["cx"] == right["cx"]) & (left["cy"] == right["cy"])
    for k in keys:
        condition = condition & (F.col(k) == F.col(f"k_{k}"))
    corner_x, corner_y = F.greatest("llx", "o_llx"), F.greatest("lly", "o_lly")
    met = left.join(right, condition).where(
        (corner_x < F.least("urx", "o_urx")) & (corner_y < F.least("ury", "o_ury"))
        & (F.floor(corner_x / cell) == left["cx"]) & (F.floor(corner_y / cell) == left["cy"])
    )
    return met.drop("cx", "cy", *[f"k_{k}" for k in keys])


def in_rectangle(nodes: DataFrame, llx: int, lly: int, urx: int, ury: int, closed: bool = False) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    upper = (x <= urx) & (y <= ury) if closed else (x < urx) & (y < ury)
    return nodes.where((x >= llx) & (y >= lly) & upper)


def rank_in_cell(nodes: DataFrame, order: list[Column], cell: tuple[str, ...] = ("image_id", "z", "x", "y")) -> DataFrame:
    """``rn``: 1 for the best node of each position."""
    return nodes.withColumn("rn", F.row_number().over(Window.partitionBy(*cell).orderBy(*order)))
