"""Learning of part libraries: statistics in Spark, small greedy loops over types.

What depends on images is aggregated by Spark. The loops run over part types and
candidate parts, of which a library has tens to hundreds; each step is one job.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partweave.operators.descriptors import cooccurrence
from partweave.operators.keyed import as_value, by_keys, near_pairs, owners, ranges
from partweave.operators.ordering import numbered, running_sum
from partweave.operators.suppression import pick_peaks
from partweave.sources.scratch import stored


def duplets(nodes: DataFrame, *, radius: int, peak_radius: int, share: float, most: int) -> DataFrame:
    """Offset peaks of each ordered type pair: the candidate subparts."""
    cells = cooccurrence(nodes, radius).select("mc", "mn", "dx", "dy", "v")
    return pick_peaks(cells, ["mc", "mn"], radius=peak_radius, share=share, most=most)


def merge_statistics(maps: DataFrame, keys: list[str]) -> DataFrame:
    """Element-wise sum of partial maps."""
    return maps.groupBy(*keys).agg(F.sum("v").alias("v"))


def part_sequences(nodes: DataFrame, peaks: DataFrame, *, tolerance: int, least: float, longest: int, beam: float = 0.9) -> DataFrame:
    """Symbolic sequences (centre type, then subpart types) seen in the images:
    (seq, n). Each node's realised subparts are looked up in its image's task; sequences
    are then extended best first within ``beam`` of the best, and counted where they are found."""

    def run(peak: dict, ends: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> tuple:
        owner = owners(ends)
        m, x, y = m.astype(np.int64), x.astype(np.int64), y.astype(np.int64)
        # In this order a smaller number goes first on ties.
        mc, mn, px, py = np.unique(np.stack([peak[c].astype(np.int64) for c in ("mc", "mn", "dx", "dy")], axis=1), axis=0).T
        node, p = ranges(np.searchsorted(mc, m, "left"), np.searchsorted(mc, m, "right"))
        there = np.flatnonzero(r >= least)
        kinds = np.unique(np.concatenate([mn, m]))
        kind = lambda own, of: own * len(kinds) + np.searchsorted(kinds, of)
        wide = (-tolerance, tolerance)
        a, b = near_pairs(kind(owner[node], mn[p]), x[node] + px[p], y[node] + py[p], kind(owner[there], m[there]), x[there], y[there], wide, wide)
        # ``a`` comes in order: the best response of each place asked for.
        first = np.flatnonzero(np.diff(a, prepend=-1))
        v = np.maximum.reduceat(r[there[b]], first) if len(first) else np.zeros(0)
        node, p = node[a[first]], p[a[first]]
        best_first = np.lexsort((p, -v, node))
        node, p, v = node[best_first], p[best_first], v[best_first]
        start = np.flatnonzero(np.diff(node, prepend=-1))
        size = np.diff(np.append(start, len(node)))
        place = np.arange(len(node)) - np.repeat(start, size)
        good = (v >= beam * np.repeat(v[start], size)) & (place < longest)
        node, p, place = node[good], p[good], place[good]
        # A sequence is the one without its last subpart, by number, and that subpart.
        name, own, found, counts = {}, np.full(len(m), -1), [], []
        for n in range(longest):
            at = node[place == n]
            before = own[at] if n else m[at]
            seqs, own[at] = np.unique(np.stack([before, p[place == n]], axis=1), axis=0, return_inverse=True)
            name = {k: f"{name[int(s)] if n else s}>{mn[q]}@{px[q]},{py[q]}" for k, (s, q) in enumerate(seqs)}
            found += name.values()
            counts.append(np.bincount(own[at], minlength=len(seqs)))
        return np.zeros(len(found), dtype=np.int64), pa.array(found, pa.string()), np.concatenate([np.zeros(0, np.int64), *counts])

    rows = nodes.select("image_id", *[F.col(c).cast("int").alias(c) for c in ("m", "x", "y")], F.col("r").cast("double").alias("r")).dropna(subset=["image_id", "m", "x", "y"])
    counted = by_keys(rows, ["image_id"], ["m", "x", "y", "r"], [], "seq string, n long", run, as_value(peaks.select("mc", "mn", "dx", "dy")))
    return counted.groupBy("seq").agg(F.sum("n").alias("n"))


def cut_by_support(parts: DataFrame, most: int) -> DataFrame:
    """The ``most`` candidates of the largest support, ties by name: a library's size."""
    return parts.orderBy(F.desc("n"), F.asc("seq")).limit(most)


def edge_statistics(realised: DataFrame) -> DataFrame:
    """Offsets and types realised per part and subpart: (part, idx, n, mean and
    variance of dx, dy)."""
    return realised.groupBy("part", "idx").agg(
        F.count(F.lit(1)).alias("n"), F.avg("dx").alias("mean_dx"), F.avg("dy").alias("mean_dy"),
        F.var_pop("dx").alias("var_dx"), F.var_pop("dy").alias("var_dy"), F.avg("v").alias("mean_v"),
    )


def greedy_types(covers: DataFrame, most: int) -> list[tuple[int, int]]:
    """Greedy set cover: (type, newly covered) in the order of choice. ``covers`` is
    (m, leaf). A step is one aggregation; it collects one row, the winner."""
    chosen: list[tuple[int, int]] = []
    pairs = stored(covers.select("m", "leaf").distinct(), "covers")
    left = pairs
    for _ in range(most):
        best = left.groupBy("m").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc("m")).first()
        if best is None:
            break
        chosen.append((best["m"], best["n"]))
        done = pairs.where(F.col("m").isin([m for m, _ in chosen])).select("leaf").distinct()
        left = pairs.join(done, "leaf", "left_anti")
    return chosen


def learned_thresholds(scored: DataFrame, share: float = 0.05) -> DataFrame:
    """Per type the value that all but ``share`` of the positives reach; ``scored``
    is (m, r, positive)."""
    counts = scored.where("positive").groupBy("m", "r").agg(F.count(F.lit(1)).alias("c"))
    totals = counts.groupBy("m").agg(F.sum("c").alias("n"))
    upto = running_sum(counts, ["m"], ["r"], F.col("c"), "upto")
    reached = upto.join(totals, "m").where(F.col("upto") >= F.floor(share * F.col("n")) + 1)
    return reached.groupBy("m").agg(F.min("r").alias("threshold"))


def inserted_parts(library: DataFrame, new: DataFrame) -> DataFrame:
    """``library`` (part, structure) with the new structures that it lacks, numbered on."""
    fresh = new.select("structure").distinct().join(library.select("structure"), "structure", "left_anti")
    start = library.agg(F.coalesce(F.max("part") + 1, F.lit(0)).alias("start"))
    added = numbered(fresh, [], ["structure"], "k").crossJoin(start)  # one row
    return library.unionByName(added.select((F.col("start") + F.col("k") - 1).cast("int").alias("part"), "structure"))


def kept_parts(library: DataFrame, keep: DataFrame) -> DataFrame:
    """Only the listed parts, densely renumbered: (part, old_part, structure)."""
    kept = library.join(keep.select("part").distinct(), "part", "left_semi")
    return numbered(kept, [], ["part"], "k").select((F.col("k") - 1).cast("int").alias("part"), F.col("part").alias("old_part"), "structure")


def position_sets(nodes: DataFrame, most: int) -> DataFrame:
    """(types, n): how often each set of the ``most`` best types shares a position."""
    w = Window.partitionBy("image_id", "z", "x", "y").orderBy(F.desc("g"), F.asc("m"))
    top = nodes.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= most)
    sets = top.groupBy("image_id", "z", "x", "y").agg(F.array_join(F.array_sort(F.collect_set("m")), ",").alias("types"))
    return sets.groupBy("types").agg(F.count(F.lit(1)).alias("n"))
