"""Alignment of point sets: trees by their longest paths, labelled sets by translation.

Two trees are aligned along their longest paths, place for place in proportion; the other
nodes of the second tree take the partner of the nearest aligned node along the edges. The
search goes from all aligned nodes of all pairs at once, one edge a round, and carries
where it came from.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.operators.keyed import by_keys, one_key
from partweave.operators.ranges import window_join
from partweave.sources.scratch import stored


def matched_paths(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair, node, partner): place i of the first path meets place round(f * i) of the
    second, f the ratio of their lengths less one. ``a`` and ``b``: (tree, path array),
    ``pairs``: (pair, tree_a, tree_b). Where several places meet one node the last
    counts; of a path of one node only the first place is met."""
    left = pairs.join(a.select(F.col("tree").alias("tree_a"), F.col("path").alias("path_a")), "tree_a")
    both = left.join(b.select(F.col("tree").alias("tree_b"), F.col("path").alias("path_b")), "tree_b")
    factor = F.when(F.size("path_a") > 1, (F.size("path_b") - 1) / (F.size("path_a") - 1)).otherwise(0.0)
    each = both.withColumn("f", factor).select("pair", "f", "path_b", F.posexplode("path_a").alias("i", "partner"))
    # Halves go up, as lengths are never negative.
    placed = each.withColumn("j", F.floor(F.col("f") * F.col("i") + 0.5).cast("int"))
    return placed.select("pair", "i", "partner", F.get("path_b", F.col("j")).alias("node")).groupBy("pair", "node").agg(F.max_by("partner", "i").alias("partner"))


def carried(start: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair, node, partner, origin, dist): every node that edges (pair, src, dst) reach takes
    the partner of the nearest start (pair, node, partner), of the smallest node among equally
    near ones. One round for each step; it ends when no node is new."""
    steps = stored(edges.select("pair", "src", "dst").distinct(), "steps")
    front = stored(start.select("pair", "node", "partner", F.col("node").alias("origin"), F.lit(0).alias("dist")), "front")
    out, dist = front, 0
    while True:
        dist += 1
        ahead = front.join(steps.withColumnRenamed("src", "node"), ["pair", "node"]).groupBy("pair", F.col("dst").alias("node")).agg(F.min(F.struct("origin", "partner")).alias("best"))
        # Steps go both ways, so what is new can only touch what came before: all of it.
        new = ahead.join(out.select("pair", "node"), ["pair", "node"], "left_anti")
        front = stored(new.select("pair", "node", F.col("best.partner").alias("partner"), F.col("best.origin").alias("origin"), F.lit(dist).alias("dist")), "front")
        if front.limit(1).count() == 0:
            return out
        out = out.unionByName(front)


def aligned_trees(pairs: DataFrame, paths: DataFrame, edges: DataFrame) -> DataFrame:
    """(pair, node, partner, origin, dist) of every node of the second tree of each pair.
    ``paths``: (tree, path) longest paths; ``edges``: (tree, a, b) undirected. A tree is one
    image's, so its nodes take their partners in one task, many pairs a call; ``carried``
    does the same for graphs of any size."""
    start = matched_paths(paths, paths, pairs).select("pair", F.col("node").alias("a"), F.col("partner").alias("b"), F.lit(True).alias("placed"))
    own = pairs.select("pair", F.col("tree_b").alias("tree")).join(edges.select("tree", "a", "b"), "tree")
    rows = start.unionByName(own.select("pair", "a", "b", F.lit(False).alias("placed")))

    def carry(a: np.ndarray, b: np.ndarray, placed: np.ndarray) -> list[np.ndarray]:
        near: dict[int, list[int]] = {}
        for v, w in zip(a[~placed].tolist(), b[~placed].tolist(), strict=True):
            near.setdefault(v, []).append(w)
            near.setdefault(w, []).append(v)
        found = {n: (n, p, 0) for n, p in zip(a[placed].tolist(), b[placed].tolist(), strict=True)}
        front, dist = dict(found), 0
        while front:
            dist += 1
            ahead: dict[int, tuple[int, int, int]] = {}
            for node, (origin, partner, _) in front.items():
                for w in near.get(node, ()):
                    if w not in found and (w not in ahead or (origin, partner) < ahead[w][:2]):
                        ahead[w] = (origin, partner, dist)
            found |= ahead
            front = ahead
        columns = zip(*[(n, p, o, d) for n, (o, p, d) in found.items()], strict=True) if found else [()] * 4
        return [np.array(c, dtype=t) for c, t in zip(columns, (np.int64, np.int64, np.int64, np.int32), strict=True)]

    return by_keys(rows, ["pair"], ["a", "b", "placed"], ["a", "b"], "node long, partner long, origin long, dist int", one_key(carry))


def alignment_cost(found: DataFrame, points: DataFrame) -> DataFrame:
    """(pair, n, cost): summed squared distances between nodes and their partners."""
    at = lambda n: points.select(F.col("node").alias(n), F.col("x").alias(f"{n}_x"), F.col("y").alias(f"{n}_y"))
    met = found.join(at("node"), "node").join(at("partner"), "partner")
    dx, dy = F.col("node_x") - F.col("partner_x"), F.col("node_y") - F.col("partner_y")
    return met.groupBy("pair").agg(F.count(F.lit(1)).alias("n"), F.sum(dx * dx + dy * dy).cast("double").alias("cost"))


def best_translations(sets: DataFrame, pairs: DataFrame, *, tolerance: int, reach: int) -> DataFrame:
    """(pair, dx, dy, n): the translation within ``reach`` under which most points of the
    first set have a point of their label within ``tolerance`` in the second; ties go to
    the shortest, then the smallest. ``sets``: (set, label, x, y), ``pairs``: (pair, set_a,
    set_b). Points vote for offsets; a point's votes are spread over the tolerance and
    counted once."""
    a = pairs.join(sets.withColumnRenamed("set", "set_a"), "set_a").select("pair", "label", "x", "y").distinct()
    b = pairs.join(sets.withColumnRenamed("set", "set_b"), "set_b").select("pair", "label", "x", "y").distinct()
    met = window_join(a, b, ["pair", "label"], reach + tolerance, reach + tolerance)
    spread = F.sequence(F.lit(-tolerance), F.lit(tolerance))
    votes = met.select("pair", "label", "x", "y", (F.col("o_x") - F.col("x")).alias("vx"), (F.col("o_y") - F.col("y")).alias("vy"))
    votes = votes.withColumn("i", F.explode(spread)).withColumn("j", F.explode(spread)).select("pair", "label", "x", "y", (F.col("vx") + F.col("i")).alias("dx"), (F.col("vy") + F.col("j")).alias("dy"))
    inside = votes.where((F.abs("dx") <= reach) & (F.abs("dy") <= reach)).distinct()
    counted = inside.groupBy("pair", "dx", "dy").agg(F.count(F.lit(1)).alias("n"))
    best = counted.groupBy("pair").agg(F.max(F.struct("n", -(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")), -F.col("dx"), -F.col("dy"))).alias("b"))
    return best.select("pair", (-F.col("b.col3")).alias("dx"), (-F.col("b.col4")).alias("dy"), F.col("b.n").alias("n"))
