"""Growing object models from pairs of parts that stand at typical offsets.

``offset_peaks`` finds where parts of one type stand around those of another: offsets of
all pairs are counted, blurred, and their local peaks picked. A model is a set of nodes
of one image. A round looks from every part of every model along the peaks of its type,
joins the best node of the peak's type near that place, and keeps of a model's candidates
those that share little support with the model and with each other. Each makes a larger
model, so all models of a size are found together; the nodes of a model come in a fixed
order of preference, so a set of nodes is made once.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.operators.keyed import as_value, by_keys, lists, near_pairs, owners, ranges


def blurred_peaks(counts: np.ndarray, *, sigma: float, share: float, radius: int, most: int) -> list[tuple[int, int, float]]:
    """(dx, dy, v) of a square map of offset counts with offset 0 in its middle: the
    blurred map's local maxima over ``share`` of its largest value, best first, none
    within ``radius`` of the middle or of a better one."""
    reach = max(1, int(3 * sigma + 0.5))
    kernel = np.exp(-np.arange(-reach, reach + 1) ** 2 / (2 * sigma * sigma))
    kernel /= kernel.sum()
    smooth = np.apply_along_axis(np.convolve, 0, counts.astype(float), kernel, "same")
    smooth = np.round(np.apply_along_axis(np.convolve, 1, smooth, kernel, "same"), 9)
    middle = len(counts) // 2
    places = sorted((-smooth[x, y], int(x), int(y)) for x, y in zip(*np.nonzero(smooth > share * smooth.max(initial=0)), strict=True))
    taken, found = [(middle, middle)], []
    for negative, x, y in places:
        if len(found) == most:
            break
        if smooth[max(0, x - radius) : x + radius + 1, max(0, y - radius) : y + radius + 1].max() > -negative:
            continue
        if all(max(abs(x - a), abs(y - b)) > radius for a, b in taken):
            taken.append((x, y))
            found.append((x - middle, y - middle, float(-negative)))
    return found


def offset_peaks(nodes: DataFrame, *, reach: int, sigma: float = 0.75, share: float = 0.05, radius: int = 5, most: int = 7) -> DataFrame:
    """(m, o_m, peak, dx, dy, v): peaks of the offsets from nodes of type m to those of type
    o_m. Offsets are counted before they meet, so a pair of types is a map of bounded size."""

    def count(ends: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray) -> tuple:
        """Offsets of many images, under the first one."""
        own, x, y, m = owners(ends), x.astype(np.int64), y.astype(np.int64), m.astype(np.int64)
        i, j = near_pairs(own, x, y, own, x, y, (-reach, reach), (-reach, reach))
        i, j = i[i != j], j[i != j]
        kinds, kind = np.unique(m, return_inverse=True)
        wide = 2 * reach + 1
        code, n = np.unique(((kind[i] * len(kinds) + kind[j]) * wide + x[j] - x[i] + reach) * wide + y[j] - y[i] + reach, return_counts=True)
        both, dx, dy = code // (wide * wide), code // wide % wide - reach, code % wide - reach
        return np.zeros(len(code), dtype=np.int64), *(v.astype(np.int32) for v in (kinds[both // len(kinds)], kinds[both % len(kinds)], dx, dy)), n.astype(np.int64)

    places = nodes.select("image_id", "x", "y", "m").dropna()
    met = by_keys(places, ["image_id"], ["x", "y", "m"], [], "m int, o_m int, dx int, dy int, n long", count)
    offsets = met.groupBy("m", "o_m", "dx", "dy").agg(F.sum("n").alias("n"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros((2 * reach + 1, 2 * reach + 1))
        counts[frame["dx"] + reach, frame["dy"] + reach] = frame["n"]
        rows = [(k, *p) for k, p in enumerate(blurred_peaks(counts, sigma=sigma, share=share, radius=radius, most=most))]
        out = pd.DataFrame(rows, columns=["peak", "dx", "dy", "v"])
        out.insert(0, "o_m", frame["o_m"].iloc[0])
        out.insert(0, "m", frame["m"].iloc[0])
        return out

    return offsets.groupBy("m", "o_m").applyInPandas(run, "m int, o_m int, peak int, dx int, dy int, v double")


def apart(sets: list[frozenset[int]], known: list[frozenset[int]], share: float, of_other: bool) -> list[int]:
    """Greedy: positions of the sets that share less than ``share`` (of the earlier set,
    or of their own) with every one kept before, ``known`` included."""
    kept, held = [], list(known)
    for k, own in enumerate(sets):
        if all(len(own & o) < share * max(1, len(o if of_other else own)) for o in held):
            kept.append(k)
            held.append(own)
    return kept


def best_aims(own: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray, r: np.ndarray, peaks: dict[str, np.ndarray], tolerance: int) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), in order of i: for each node and each peak of its type the best node near the
    place that the peak points to, by value and then by place in the rows."""
    kinds = np.unique(np.concatenate([m, peaks["o_m"], peaks["m"]]))
    n, at = len(kinds), np.searchsorted(kinds, m)
    order = np.argsort(peaks["m"], kind="stable")
    kind = np.searchsorted(kinds, peaks["m"][order])
    node, place = ranges(np.searchsorted(kind, at, "left"), np.searchsorted(kind, at, "right"))
    peak = order[place]
    aim = np.searchsorted(kinds, peaks["o_m"][peak])
    a, j = near_pairs(own[node] * n + aim, x[node] + peaks["dx"][peak], y[node] + peaks["dy"][peak], own * n + at, x, y, (-tolerance, tolerance), (-tolerance, tolerance))
    best = np.lexsort((j, -np.nan_to_num(r[j], nan=-np.inf), a))
    a, j = a[best], j[best]
    head = np.diff(a, prepend=-1) != 0
    return node[a[head]], j[head]


def larger_models(model: tuple[int, ...], held: frozenset[int], found: list[int], kinds: list[int], points: list[frozenset[int]], *, overlap: float, alike: float, distinct: float, most_types: int) -> list[tuple]:
    """(nodes, points) of the next size that the candidates of a model make; nodes are numbers in
    their order of preference, candidates in that order too."""
    by_kind: dict[int, list[int]] = {}
    for k in found:
        by_kind.setdefault(kinds[k], []).append(k)
    grown, known, used = [], [], 0
    for own in by_kind.values():
        rows = [k for k in own if points[k] and len(points[k] & held) < overlap * len(points[k])]
        rows = [rows[k] for k in apart([points[k] for k in rows], [], alike, True)]
        rows = [rows[k] for k in apart([points[k] for k in rows], known, distinct, False)]
        known += [points[k] for k in rows]
        grown += [((*model, k), held | points[k]) for k in rows]
        used += bool(rows)
        if used == most_types:
            break
    return grown


def first_apart(sets: list[frozenset[int]], share: float, most: int) -> list[int]:
    """The first ``most`` positions that ``apart`` keeps."""
    kept: list[int] = []
    for k, own in enumerate(sets):
        if len(kept) == most:
            break
        if all(len(own & sets[o]) < share * max(1, len(own)) for o in kept):
            kept.append(k)
    return kept


def object_models(
    nodes: DataFrame, peaks: DataFrame, *, tolerance: int = 2, least: int = 2, longest: int = 4, overlap: float = 0.4, alike: float = 0.6, distinct: float = 0.5, start_overlap: float = 0.7,
    most_starts: int = 4, most_types: int = 4, most_models: int = 64,
) -> DataFrame:
    """(image_id, model, points): models of ``least`` to ``longest`` nodes. ``nodes``:
    (image_id, node_id, x, y, m, r, points); nodes of frequent types come first, then by
    value. Models start from the first nodes of an image that share little support. An
    image's models grow in its task; of many images the nodes that peaks point to are found at once."""
    frequent = nodes.groupBy("m").agg(F.count(F.lit(1)).alias("often"))
    grow = partial(larger_models, overlap=overlap, alike=alike, distinct=distinct, most_types=most_types)

    def run(peaks: dict, frequent: dict, ends: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray, m: np.ndarray, r: np.ndarray, points: np.ndarray) -> tuple:
        own, r = owners(ends), r.astype(float)
        x, y = x.astype(np.int64), y.astype(np.int64)
        often = dict(zip(frequent["m"].tolist(), frequent["often"].tolist(), strict=True))
        count = np.array([often[k] for k in m.tolist()], dtype=np.int64)
        i, j = best_aims(own, x, y, m, r, peaks, tolerance)
        order = np.lexsort((ids, -r, m, -count, own))
        rank = np.empty(len(ids), dtype=np.int64)
        rank[order] = np.arange(len(ids)) - np.repeat(ends[:-1], np.diff(ends))
        # Aims by image, from rank to rank.
        cuts = np.searchsorted(own[i], np.arange(len(ends)))
        i, j = rank[i].tolist(), rank[j].tolist()
        image, models, covers = [], [], []
        for k, (p, q) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
            mine = order[p:q]
            held = [frozenset() if v is None else frozenset(v.tolist()) for v in points[mine]]
            kinds, names = m[mine].tolist(), ids[mine].tolist()
            aims: dict[int, set[int]] = {}
            for a, b in zip(i[cuts[k] : cuts[k + 1]], j[cuts[k] : cuts[k + 1]], strict=True):
                aims.setdefault(a, set()).add(b)
            now = [((s,), held[s]) for s in first_apart(held, start_overlap, most_starts)]
            for size in range(1, longest + 1):
                if size > 1:
                    larger = []
                    for model, cover in now:
                        found = sorted({b for part in model for b in aims.get(part, ()) if b > model[-1]})
                        larger += grow(model, cover, found, kinds, held)
                    larger.sort(key=lambda g: (-len(g[1]), [names[n] for n in g[0]]))
                    now = larger[:most_models]
                if size >= least:
                    for model, cover in now:
                        image.append(k)
                        models.append([names[n] for n in model])
                        covers.append(sorted(cover))
        return np.array(image, dtype=np.int64), lists(models), lists(covers)

    known = nodes.dropna(subset=["image_id", "node_id", "x", "y", "m"])
    model = as_value(peaks.select("m", "o_m", "dx", "dy"), frequent.dropna())
    return by_keys(known, ["image_id"], ["node_id", "x", "y", "m", "r", "points"], ["node_id"], "model array<long>, points array<long>", run, model)


def model_boxes(models: DataFrame, nodes: DataFrame) -> DataFrame:
    """(image_id, model, m, val, llx, lly, urx, ury): the box of a model's nodes, half open,
    with the type of its first node and its nodes' mean value."""
    parts = models.select("image_id", "model", F.posexplode("model").alias("k", "node_id")).join(nodes.select("image_id", "node_id", "x", "y", "m", "r"), ["image_id", "node_id"])
    return parts.groupBy("image_id", "model").agg(
        F.min_by("m", "k").alias("m"), F.avg("r").alias("val"),
        F.min("x").alias("llx"), F.min("y").alias("lly"), (F.max("x") + 1).alias("urx"), (F.max("y") + 1).alias("ury"),
    )
