"""Part graphs: closures over edges, support, coverage, paths, spanning trees.

A closure is a semi-naive loop of joins: a frontier goes down one edge at a time,
without the nodes already reached, is stored in the shared folder, and the loop
ends when it is empty. ``closure`` is the one materialised table (node, reached)
that supports, boxes and coverage are aggregated from.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.operators.keyed import by_keys, lists
from partweave.operators.ordering import numbered, running_sum
from partweave.sources.scratch import stored

def named(edges: DataFrame, names: list[str] | None) -> DataFrame:
    return edges if names is None else edges.where(F.col("name").isin(names))


def closure(
    edges: DataFrame, start: DataFrame | None = None, *, names: list[str] | None = None, depth: int | None = None, expand: Column | None = None
) -> DataFrame:
    """(node, reached, dist): everything that edges reach, or ``depth`` of them, each at
    its least distance, the start included at distance 0. ``start`` (node) defaults to
    all edge sources; ``expand`` is a condition on the edge. Cycles end by themselves."""
    steps = named(edges, names)
    if expand is not None:
        steps = steps.where(expand)
    steps = stored(steps.select(F.col("src").alias("reached"), "dst").distinct(), "steps")
    if start is None:
        start = edges.select(F.col("src").alias("node")).distinct()
    front = stored(start.select("node", F.col("node").alias("reached"), F.lit(0).alias("dist")).distinct(), "front")
    out, dist = front, 0
    while depth is None or dist < depth:
        dist += 1
        ahead = front.join(steps, "reached").select("node", F.col("dst").alias("reached")).distinct()
        front = stored(ahead.join(out.select("node", "reached"), ["node", "reached"], "left_anti").withColumn("dist", F.lit(dist)), "front")
        if front.limit(1).count() == 0:
            break
        out = out.unionByName(front)
    return out


def leaves(edges: DataFrame, reached: DataFrame) -> DataFrame:
    """The rows of a closure that end where no edge starts."""
    return reached.join(edges.select(F.col("src").alias("reached")).distinct(), "reached", "left_anti").select("node", F.col("reached").alias("leaf"))


def layered_leaves(edges: DataFrame, layers: int) -> DataFrame:
    """(z, node, leaf) of a graph whose edges carry the layer z of their source and
    end on layer z - 1: one join per layer, each from the last one's result."""
    found = edges.where("z = 1").select("z", F.col("src").alias("node"), F.col("dst").alias("leaf")).distinct()
    out = found
    for z in range(2, layers + 1):
        up = edges.where(F.col("z") == z).select("src", F.col("dst").alias("node"))
        found = found.join(up, "node").select(F.lit(z).alias("z"), F.col("src").alias("node"), "leaf").distinct()
        out = out.unionByName(found)
    return out


def support_boxes(support: DataFrame, points: DataFrame) -> DataFrame:
    """Bounding box and size of each node's leaves; ``points`` is (leaf, x, y)."""
    return support.join(points, "leaf").groupBy("node").agg(
        F.min("x").alias("llx"), F.min("y").alias("lly"), F.max("x").alias("urx"), F.max("y").alias("ury"), F.count(F.lit(1)).alias("n_leaves")
    )


def cumulative_coverage(support: DataFrame, ranks: DataFrame) -> DataFrame:
    """(rank, covered): leaves covered by the nodes of rank 1, 2, ... up to each;
    ``ranks`` is (node, rank). A leaf counts at its best rank, so the running
    number needs no distinct window."""
    first = support.join(ranks, "node").groupBy("leaf").agg(F.min("rank").alias("rank"))
    added = first.groupBy("rank").agg(F.count(F.lit(1)).alias("added"))
    return running_sum(added, [], ["rank"], F.col("added"), "covered").select("rank", "covered")


def coverage(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The share of nodes (node) that some edge reaches."""
    hit = edges.select(F.col("dst").alias("node"), F.lit(1).alias("hit")).distinct()
    return nodes.join(hit, "node", "left").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("covered_share"), F.count(F.lit(1)).alias("n_nodes"))


def edge_paths(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, reached, path): paths of edge indices, to their ends or of up to ``depth`` edges.
    A path does not come back to a node that it holds."""
    step = stored(edges.select(F.col("src").alias("reached"), "dst", "idx"), "steps")
    front = start.select("node", F.col("node").alias("reached"), F.array().cast("array<int>").alias("path"), F.array("node").alias("over"))
    out, length = front, 0
    while depth is None or length < depth:
        length += 1
        ahead = front.join(step, "reached").where(~F.array_contains("over", F.col("dst")))
        front = stored(ahead.select("node", F.col("dst").alias("reached"), F.concat("path", F.array("idx")).alias("path"), F.concat("over", F.array("dst")).alias("over")), "paths")
        if front.limit(1).count() == 0:
            break
        out = out.unionByName(front)
    return out.drop("over")


def shortest_distances(edges: DataFrame, start: DataFrame, depth: int | None = None) -> DataFrame:
    """(node, reached, dist) breadth first, up to ``depth`` edges or to the end."""
    return closure(edges, start, depth=depth)


def inverse(edges: DataFrame, name: str) -> DataFrame:
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(name).alias("name"), *[c for c in edges.columns if c not in ("src", "dst", "name")]).select(*edges.columns))


def renamed(edges: DataFrame, old: str, new: str) -> DataFrame:
    return edges.withColumn("name", F.when(F.col("name") == old, new).otherwise(F.col("name")))


def without_nodes(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges that touch no node of ``gone`` (node)."""
    for end in ("src", "dst"):
        edges = edges.join(gone.select(F.col("node").alias(end)), end, "left_anti")
    return edges


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends among ``kept`` (node)."""
    for end in ("src", "dst"):
        edges = edges.join(kept.select(F.col("node").alias(end)).distinct(), end, "left_semi")
    return edges


def degrees(edges: DataFrame) -> DataFrame:
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n_out"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("n_in"))
    return out.join(into, "node", "full").select("node", F.coalesce("n_out", F.lit(0)).alias("n_out"), F.coalesce("n_in", F.lit(0)).alias("n_in"))


def dense_ids(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """``rows`` numbered from 0 within each key, however large."""
    return numbered(rows, keys, order, "dense_id").withColumn("dense_id", F.col("dense_id") - 1)


def _prim(x: np.ndarray, y: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(link, new, d2) by step of the trees of many point sets, a row each, filled up to one
    length. The row's points come by id, so the first of equally near ones is the smallest."""
    sets, n = x.shape
    row = np.arange(sets)
    best, link, inside = np.full((sets, n), np.inf), np.zeros((sets, n), dtype=np.int64), np.arange(n)[None] >= size[:, None]
    now = np.zeros(sets, dtype=np.int64)
    steps = [np.zeros((sets, max(n - 1, 0)), dtype=t) for t in (np.int64, np.int64, float)]
    for step in range(n - 1):
        inside[row, now] = True
        d2 = (x - x[row, now][:, None]) ** 2 + (y - y[row, now][:, None]) ** 2
        closer = d2 < best
        best, link = np.where(closer, d2, best), np.where(closer, now[:, None], link)
        best[inside] = np.inf
        now = best.argmin(axis=1)
        for held, found in zip(steps, (link[row, now], now, best[row, now]), strict=True):
            held[:, step] = found
    return tuple(steps)


def spanning_trees(points: DataFrame, keys: list[str], id_col: str = "node_id") -> DataFrame:
    """Minimum spanning tree edges (keys, a, b, d2) per key, by Prim's rule on
    squared distances; ties go to the smaller id. A task grows the trees of many keys of
    much the same size in step."""

    def run(ends: np.ndarray, ids: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
        sizes, found = np.diff(ends), []
        order = np.argsort(sizes, kind="stable")
        for some in np.array_split(order, max(1, len(order) // 32)):
            n = int(sizes[some].max(initial=0))
            at = ends[:-1][some][:, None] + np.minimum(np.arange(n)[None], sizes[some][:, None] - 1)
            link, new, d2 = _prim(x[at].astype(float), y[at].astype(float), sizes[some])
            own = np.arange(max(n - 1, 0))[None] < sizes[some][:, None] - 1
            rows, first = np.nonzero(own)[0], ends[:-1][some]
            found.append((some[rows], ids[first[rows] + link[own]], ids[first[rows] + new[own]], d2[own]))
        owner, a, b, d2 = (np.concatenate(c) for c in zip(*found, strict=True))
        return owner, a.astype(np.int64), b.astype(np.int64), d2

    return by_keys(points, keys, [id_col, "x", "y"], [id_col], "a long, b long, d2 double", run)


def _cliques(a: np.ndarray, b: np.ndarray) -> list[list[int]]:
    near: dict[int, set[int]] = {}
    for v, w in zip(a.tolist(), b.tolist(), strict=True):
        near.setdefault(v, set()).add(w)
        near.setdefault(w, set()).add(v)
    found: list[list[int]] = []
    stack = [(set(), set(near), set())]
    while stack:
        chosen, open_, shut = stack.pop()
        if not open_ and not shut:
            found.append(sorted(chosen))
            continue
        pivot = max(open_ | shut, key=lambda v: len(near[v] & open_))
        for v in sorted(open_ - near[pivot]):
            stack.append((chosen | {v}, open_ & near[v], shut & near[v]))
            open_ = open_ - {v}
            shut = shut | {v}
    return found


def cliques(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Maximal cliques (keys, clique) of undirected edges (keys, a, b), by the
    pivoting rule."""

    def run(ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple:
        found = [_cliques(a[i:j], b[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        return np.repeat(np.arange(len(found)), [len(f) for f in found]), lists([c for f in found for c in f])

    return by_keys(edges, keys, ["a", "b"], ["a", "b"], "clique array<long>", run)


def sampled_children(edges: DataFrame, seed: int) -> DataFrame:
    """One child per (src, idx), drawn with a probability proportional to r: the least of
    the races -ln(u) / r, with u from a hash (48 bits of an MD5) so reruns agree."""
    name = F.concat_ws(":", "src", "idx", "dst", F.lit(seed))
    u = (F.conv(F.substring(F.md5(name.cast("binary")), 1, 12), 16, 10).cast("double") + 1) / F.lit(float((1 << 48) + 1))
    race = (-F.ln(u) / F.col("r")).alias("race")
    return edges.where("r > 0").groupBy("src", "idx").agg(F.min_by("dst", F.struct(race, "dst")).alias("dst"))


def flood(cells: DataFrame, keys: list[str], least: float) -> DataFrame:
    """8-neighbour islands of cells (keys, x, y, v) with v >= least: (keys, x, y,
    island), numbered by their smallest cell."""
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", x int, y int, island int"

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        open_ = {(int(x), int(y)) for x, y in zip(frame["x"], frame["y"], strict=True)}
        rows, number = [], 0
        for seed in sorted(open_):
            if seed not in open_:
                continue
            stack = [seed]
            open_.discard(seed)
            while stack:
                x, y = stack.pop()
                rows.append((x, y, number))
                near = {(x + i, y + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & open_
                open_ -= near
                stack += near
            number += 1
        out = pd.DataFrame(rows, columns=["x", "y", "island"])
        for k in reversed(keys):
            out.insert(0, k, frame[k].iloc[0])
        return out

    return cells.where(F.col("v") >= least).groupBy(*keys).applyInPandas(run, schema)
