"""Non-maximum suppression and other greedy selections.

Greedy rules depend on order, so each has a total order ending in an id. They run
per key (an image, an image and type): Spark deals the keys out, a task holds one
key's boxes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partweave.operators.keyed import kept_by_keys

SIDES = ["llx", "lly", "urx", "ury"]


def _overlaps(box: np.ndarray, others: np.ndarray, kind: str) -> np.ndarray:
    w = np.minimum(box[2], others[:, 2]) - np.maximum(box[0], others[:, 0])
    h = np.minimum(box[3], others[:, 3]) - np.maximum(box[1], others[:, 1])
    inter = np.where((w > 0) & (h > 0), w * h, 0).astype(float)
    area = lambda b: (b[..., 2] - b[..., 0]) * (b[..., 3] - b[..., 1])
    base = {"iou": area(box) + area(others) - inter, "min": np.minimum(area(box), area(others)), "contained": area(others)}[kind]
    return np.divide(inter, base, out=np.zeros_like(inter), where=base > 0)


def keep_boxes(sides: np.ndarray, values: np.ndarray, ids: np.ndarray, threshold: float, kind: str) -> np.ndarray:
    """Greedy: the best box stays, boxes that overlap it by more than the
    threshold go, and so on. Returns the positions that stay."""
    alive = np.ones(len(sides), dtype=bool)
    kept = []
    for k in np.lexsort((ids, -values)):
        if alive[k]:
            kept.append(k)
            alive &= ~(_overlaps(sides[k], sides, kind) > threshold)
    return np.array(kept, dtype=np.int64)


def suppress_boxes(
    boxes: DataFrame, keys: list[str], threshold: float, kind: str = "iou", value: str = "val", id_col: str = "box_id", most: int | None = None
) -> DataFrame:
    """``kind``: iou, min (share of the smaller box) or contained (share of the
    weaker box). ``most`` keeps only so many of the best of a key before. Boxes are
    dealt by the first key and told apart by the others within the task."""
    if most is not None:
        boxes = top_k(boxes, keys, most, value, id_col)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        group = frame.groupby(keys[1:], sort=False).ngroup().to_numpy() if keys[1:] else np.zeros(len(frame), dtype=int)
        order = np.argsort(group, kind="stable")
        sides, values, ids = frame[SIDES].to_numpy(dtype=float), frame[value].to_numpy(), frame[id_col].to_numpy()
        cuts = np.flatnonzero(np.diff(group[order])) + 1
        parts = [own[keep_boxes(sides[own], values[own], ids[own], threshold, kind)] for own in np.split(order, cuts)]
        return frame.iloc[np.concatenate(parts)]

    return boxes.groupBy(keys[0]).applyInPandas(run, boxes.schema)


def top_k(rows: DataFrame, keys: list[str], k: int, value: str, id_col: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(value), F.asc(id_col))
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def suppress_points(points: DataFrame, keys: list[str], radius: float, order: str, id_col: str) -> DataFrame:
    """Greedy discs: in order, a point stays if no kept one lies within the radius."""

    def run(x: np.ndarray, y: np.ndarray) -> list[int]:
        x, y = x.astype(float), y.astype(float)
        far = (x[:, None] - x) ** 2 + (y[:, None] - y) ** 2 > radius * radius
        alive, kept = np.ones(len(x), dtype=bool), []
        for k in range(len(x)):
            if alive[k]:
                kept.append(k)
                alive &= far[k]
        return kept

    return kept_by_keys(points, keys, [order, id_col], ["x", "y"], run)


def suppress_by_leaves(support: DataFrame, keys: list[str], threshold: float, value: str = "val", id_col: str = "node_id") -> DataFrame:
    """``support`` has keys, id, value and ``leaves`` (array<long>): best first, a
    node goes if more than the threshold's share of its leaves is already covered."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.iloc[np.lexsort((frame[id_col].to_numpy(), -frame[value].to_numpy()))]
        covered: set[int] = set()
        kept = []
        for k, leaves in enumerate(frame["leaves"]):
            own = set(map(int, leaves))
            if own and len(own & covered) > threshold * len(own):
                continue
            kept.append(k)
            covered |= own
        return frame.iloc[kept]

    return support.groupBy(*keys).applyInPandas(run, support.schema)


def greedy_cover(support: DataFrame, keys: list[str], overlap: float, enough: float, id_col: str = "node_id") -> DataFrame:
    """Nodes by support size, largest first; one is taken if less than the
    overlap's share of it is covered, until ``enough`` of all leaves is."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sizes = frame["leaves"].map(len).to_numpy()
        frame = frame.iloc[np.lexsort((frame[id_col].to_numpy(), -sizes))]
        every = set().union(*(set(map(int, x)) for x in frame["leaves"])) if len(frame) else set()
        covered: set[int] = set()
        kept = []
        for k, leaves in enumerate(frame["leaves"]):
            own = set(map(int, leaves))
            if own and len(own & covered) < overlap * len(own):
                kept.append(k)
                covered |= own
            if len(covered) >= enough * len(every):
                break
        return frame.iloc[kept]

    return support.groupBy(*keys).applyInPandas(run, support.schema)


def pick_peaks(cells: DataFrame, keys: list[str], *, radius: int, share: float, most: int) -> DataFrame:
    """Peaks of offset maps (keys, dx, dy, v): at least ``share`` of the key's
    maximum, the largest in their window, greedy suppression around picks, ``most``
    per key."""
    top = F.max("v").over(Window.partitionBy(*keys))
    strong = cells.withColumn("_top", top).where(F.col("v") >= share * F.col("_top")).drop("_top")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.iloc[np.lexsort((frame["dy"], frame["dx"], -frame["v"]))]
        xy = frame[["dx", "dy"]].to_numpy()
        alive, kept = np.ones(len(frame), dtype=bool), []
        for k in range(len(frame)):
            if alive[k]:
                kept.append(k)
                if len(kept) == most:
                    break
                alive &= np.abs(xy - xy[k]).max(axis=1) > radius
        return frame.iloc[kept]

    return strong.groupBy(*keys).applyInPandas(run, strong.schema)
