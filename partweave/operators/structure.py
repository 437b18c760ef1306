"""Graphs, supports and libraries: neighbours, sub-trees, merges, similarities."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.operators.clustering import assignment
from partweave.operators.keyed import ranges
from partweave.operators.ordering import numbered
from partweave.sources.scratch import stored


def split_by_neighbour(nodes: DataFrame, edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """``nodes`` (node) with whether some edge of it ends in ``wanted`` (node)."""
    hit = edges.join(wanted.select(F.col("node").alias("dst")).distinct(), "dst", "left_semi").select(F.col("src").alias("node")).distinct()
    return nodes.join(hit.withColumn("hit", F.lit(True)), "node", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def neighbour_union(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(group, dst): the neighbours of each group of nodes (group, node), once."""
    return edges.join(groups.withColumnRenamed("node", "src"), "src").select("group", "dst").distinct()


def without_incoming(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """``gone`` (node) but those that some edge reaches: these may be deleted."""
    return gone.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")


def first_children(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, leaf): the end of the way over each node's first child (the smallest), however
    long it is; a way that comes back to where it was has no end and no row."""
    first = stored(edges.groupBy("src").agg(F.min("dst").alias("child")), "first")
    open_ = stored(start.select("node", F.col("node").alias("leaf")).distinct(), "ways")
    # The length of a way without a circle is below the number of nodes with a child.
    most, ends = first.count(), None
    for _ in range(most + 1):
        step = stored(open_.join(first, F.col("leaf") == F.col("src"), "left").select("node", "leaf", "child"), "ways")
        ended = step.where("child IS NULL").select("node", "leaf")
        ends = ended if ends is None else ends.unionByName(ended)
        open_ = step.where("child IS NOT NULL AND child <> node").select("node", F.col("child").alias("leaf"))
        if open_.limit(1).count() == 0:
            break
    return ends


def subtree_sums(support: DataFrame, values: DataFrame, by: list[str]) -> DataFrame:
    """Sums of the values of all nodes below each node, by bin; ``support`` is (node, leaf),
    ``values`` (leaf, v, x, y and the columns ``by``)."""
    return support.join(values, "leaf").groupBy("node", *by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.min("x").alias("llx"), F.min("y").alias("lly"), F.max("x").alias("urx"), F.max("y").alias("ury")
    )


def overlapping_neighbours(support: DataFrame, groups: DataFrame) -> DataFrame:
    """(node, other, overlap): for nodes of one group (node, group) that share leaves, the
    shared part of the node's own leaves."""
    own = support.join(groups, "node")
    size = own.groupBy("node").agg(F.count(F.lit(1)).alias("size"))
    other = own.select("group", "leaf", F.col("node").alias("other"))
    shared = own.join(other, ["group", "leaf"]).where("node <> other").groupBy("node", "other").agg(F.count(F.lit(1)).alias("both"))
    return shared.join(size, "node").select("node", "other", (F.col("both") / F.col("size")).alias("overlap"))


def uncovered_types(support: DataFrame, types: DataFrame, covered: DataFrame, least: float) -> DataFrame:
    """(m, n): how many nodes of each type (node, m) have less than ``least`` of their
    leaves among ``covered`` (leaf)."""
    hit = support.join(covered.select("leaf").distinct().withColumn("hit", F.lit(1)), "leaf", "left")
    share = hit.groupBy("node").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))
    return share.where(F.col("share") < least).join(types, "node").groupBy("m").agg(F.count(F.lit(1)).alias("n"))


# --- libraries ---------------------------------------------------------------


def merged_libraries(center: DataFrame, sub: DataFrame, into: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A library whose parts are renamed by ``into`` (part, to): types follow, parts that
    become one keep the subparts of the smallest, and types without a row stay."""
    named = lambda df, c: df.join(into.select(F.col("part").alias(c), F.col("to").alias(f"_{c}")), c, "left").withColumn(c, F.coalesce(f"_{c}", c)).drop(f"_{c}")
    first = into.groupBy("to").agg(F.min("part").alias("part"))
    kept = lambda df: df.join(first, "part").drop("part").withColumnRenamed("to", "part")
    return named(kept(center), "center_m"), named(kept(sub), "sub_m")


def mask_similarities(masks: DataFrame) -> DataFrame:
    """(m, other, s): the normalised correlation of the masks (m, x, y, v) of two types."""
    other = masks.select(F.col("m").alias("other"), "x", "y", F.col("v").alias("w"))
    size = masks.groupBy("m").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("size"))
    dots = masks.join(other, ["x", "y"]).groupBy("m", "other").agg(F.sum(F.col("v") * F.col("w")).alias("dot"))
    met = dots.join(size, "m").join(size.select(F.col("m").alias("other"), F.col("size").alias("o_size")), "other")
    return met.select("m", "other", F.try_divide("dot", F.col("size") * F.col("o_size")).alias("s")).where("s IS NOT NULL")


#: Classes of a block, of which each meets all classes of its cell.
BLOCK = 16384


def _classes(sub: DataFrame) -> DataFrame:
    """(subs, class, parts): parts with the same subparts, whatever their order, are one class,
    named by its smallest part."""
    subs = sub.groupBy("part").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("dx", "dy", "sub_m")]))).alias("subs"))
    return subs.groupBy("subs").agg(F.min("part").alias("class"), F.collect_list("part").alias("parts"))


def part_classes(sub: DataFrame) -> DataFrame:
    """(part, class, subs): the class of each part."""
    return _classes(sub).select(F.explode("parts").alias("part"), "class", "subs")


def _reach(n: int, strongest: float, sigma: float, least: float) -> tuple[int, int] | None:
    """How far one coordinate can differ in a pair of subparts, and in the sum over ``n`` pairs,
    of a matching of mean ``least``; nothing if one pair may be lost altogether."""
    budget = n * (strongest - least) + 1e-9
    if budget >= strongest * (1 - 1e-12):
        return None
    loss, d = [], 0
    while (lost := strongest * (1 - math.exp(-d * d / (2 * sigma * sigma)))) <= budget:
        loss.append(lost)
        d += 1
    # The least loss for each sum of differences.
    sums = {0: 0.0}
    for _ in range(n):
        more: dict[int, float] = {}
        for total, lost in sums.items():
            for k, extra in enumerate(loss):
                if lost + extra <= budget:
                    more[total + k] = min(more.get(total + k, math.inf), lost + extra)
        sums = more
    return len(loss) - 1, max(sums)


#: Moves of a class's subparts that are looked up; where there are more, classes are compared.
MOST_MOVES = 4096

#: Pairs of classes that a task holds at once.
PAIRS = 1 << 18


def _moves(n: int, strongest: float, sigma: float, least: float) -> tuple[np.ndarray, np.ndarray] | None:
    """(x, y): all moves of ``n`` subparts, a row each, that a matching of mean ``least`` allows;
    nothing where they are too many."""
    found, budget = _reach(n, strongest, sigma, least), n * (strongest - least) + 1e-9
    if found is None or (2 * found[0] + 1) ** 2 > MOST_MOVES:
        return None
    x, y = (v.ravel() for v in np.mgrid[-found[0] : found[0] + 1, -found[0] : found[0] + 1])
    loss = strongest * (1 - np.exp(-(x * x + y * y) / (2 * sigma * sigma)))
    x, y, loss = x[loss <= budget], y[loss <= budget], loss[loss <= budget]
    rows, sums = np.zeros((1, 0), dtype=np.int64), np.zeros(1)
    for _ in range(n):
        total = sums[:, None] + loss
        row, k = np.nonzero(total <= budget)
        if len(row) > MOST_MOVES:
            return None
        rows, sums = np.hstack([rows[row], k[:, None]]), total[row, k]
    return x[rows], y[rows]


def _in_pieces(weights: np.ndarray) -> list[slice]:
    """Runs of rows whose weights sum to about ``PAIRS``."""
    cuts = np.flatnonzero(np.diff(np.cumsum(weights) // PAIRS)) + 1
    ends = [0, *cuts.tolist(), len(weights)]
    return [slice(i, j) for i, j in zip(ends[:-1], ends[1:], strict=True) if i < j]


def _moved_pairs(dx: np.ndarray, dy: np.ndarray, asks: np.ndarray, moves: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]] | None:
    """(a, b): rows that ask with all others that lie where a move leads to. A set of places is
    one number, so a move is looked up and no two rows are compared; nothing where that number
    would be too large."""
    low_x, low_y = dx.min(), dy.min()
    wide, high = int(dx.max() - low_x) + 1, int(dy.max() - low_y) + 1
    n, cells = dx.shape[1], wide * high
    if cells**n >= 1 << 62:
        return None

    def numbers(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        places = np.sort((x - low_x) * high + (y - low_y), axis=1)
        out = places[:, 0]
        for k in range(1, n):
            out = out * cells + places[:, k]
        return out

    def find() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        number = numbers(dx, dy)
        left, right = (np.flatnonzero(v)[np.argsort(number[v], kind="stable")] for v in (asks, ~asks))
        own, own_at, own_n = np.unique(number[left], return_index=True, return_counts=True)
        there, there_at, there_n = np.unique(number[right], return_index=True, return_counts=True)
        if not len(own) or not len(there):
            return
        sums = [(v[left[own_at]].sum(axis=1), m.sum(axis=1), v[right].sum(axis=1)) for v, m in zip((dx, dy), moves, strict=True)]
        step = max(1, (1 << 20) // len(moves[0]))
        for first in range(0, len(own), step):
            some = left[own_at[first : first + step]]
            near = np.ones((len(some), len(moves[0])), dtype=bool)
            for mine, moved, others in sums:
                total = mine[first : first + step, None] + moved
                near &= (total >= others.min()) & (total <= others.max())
            u, v = np.nonzero(near)
            x, y = dx[some[u]] + moves[0][v], dy[some[u]] + moves[1][v]
            inside = ((x >= low_x) & (x < low_x + wide) & (y >= low_y) & (y < low_y + high)).all(axis=1)
            u, code = u[inside], numbers(x[inside], y[inside])
            at = np.minimum(np.searchsorted(there, code), len(there) - 1)
            hit = there[at] == code
            u, at = np.divmod(np.unique(u[hit] * len(there) + at[hit]), len(there))
            u += first
            for piece in _in_pieces(own_n[u] * there_n[at]):
                row, i = ranges(own_at[u[piece]], (own_at + own_n)[u[piece]])
                to = at[piece][row]
                row, j = ranges(there_at[to], (there_at + there_n)[to])
                yield left[i[row]], right[j]

    return find()


def class_similarities(classes: DataFrame, types: DataFrame, sigma: float, least: float, once: bool = False, first: bool = False) -> DataFrame:
    """(class, other, similarity) of the classes (class, subs), of equally many subparts, that
    are similar by ``least`` or more, see ``similarities``. With ``once`` two classes
    have one row, from the smaller class, with the better of both ways; with ``first`` a class
    has at most one row a task, with the smallest of its others there. Classes may stand for
    several (weight).

    A matching that good bounds the differences of its pairs, and so those of the sorted
    columns dx and dy of two classes, place for place, and of their sums. Classes meet in
    cells of those sums, a block of the ones with all of the others. Where few moves of its
    subparts are that good, a class looks up the places that they lead to; else blocks are
    compared in slices. A task holds a cell's classes and passes on what it finds in pieces.
    The pairs themselves are as many as are similar."""
    if not least > 0:
        raise ValueError("parts meet by a least similarity above 0")
    kind = classes.schema["class"].dataType.simpleString()
    schema = f"class {kind}, other {kind}, similarity double"
    table = {(r["m"], r["other"]): r["s"] for r in types.select("m", "other", "s").collect()}  # the types of a model
    strongest = max(table.values(), default=0.0)
    none = classes.select("class", F.col("class").alias("other"), F.lit(0.0).alias("similarity")).where("false")
    if strongest < least:
        return none
    names = sorted({m for pair in table for m in pair})
    known = np.zeros((len(names) + 1, len(names) + 1))
    for (m, other), s in table.items():
        known[names.index(m), names.index(other)] = s
    sized = classes.select("class", "subs", F.size("subs").alias("n"))
    weight = F.col("weight") if "weight" in classes.columns else F.lit(1)
    counts = classes.groupBy(F.size("subs").alias("n")).agg(F.sum(weight).alias("c")).collect()  # a row a number of subparts
    parts = []
    for n, count in sorted((r["n"], r["c"]) for r in counts):
        found, blocks = _reach(n, strongest, sigma, least), -(-count // BLOCK)
        total = lambda c: F.aggregate(f"subs.{c}", F.lit(0), lambda a, v: a + v)
        own = sized.where(F.col("n") == n)
        wide = 2 * found[1] + 1 if found else 1
        cell = lambda c, by: F.floor((total(c) + by) / wide).cast("int") if found else F.lit(0)  # noqa: E731, B023
        reach = found[1] if found else 0
        left = own.withColumn("cx", F.explode(F.sequence(cell("dx", -reach), cell("dx", reach)))).withColumn("cy", F.explode(F.sequence(cell("dy", -reach), cell("dy", reach))))
        left = left.withColumn("block", F.pmod(F.xxhash64("class"), F.lit(blocks)).cast("int")).withColumn("asks", F.lit(True))
        right = own.withColumns({"cx": cell("dx", 0), "cy": cell("dy", 0)}).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asks", F.lit(False))
        parts.append(left.unionByName(right))
    if not parts:
        return none
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        n = table["n"][0].as_py()
        found = _reach(n, strongest, sigma, least)
        ids, asks = table["class"].combine_chunks(), table["asks"].to_numpy()
        subs = table["subs"].combine_chunks().flatten()
        dx, dy, m = (subs.field(c).to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(asks), n) for c in ("dx", "dy", "sub_m"))
        names_of = ids.to_numpy(zero_copy_only=False) if once or first else None
        number = {name: k for k, name in enumerate(names)}
        m = np.array([number.get(v, len(names)) for v in m.ravel().tolist()], dtype=np.int64).reshape(m.shape)
        orders = np.array(list(permutations(range(n)))) if n <= 4 else None

        def best(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            d2 = (dx[a][:, :, None] - dx[b][:, None]) ** 2 + (dy[a][:, :, None] - dy[b][:, None]) ** 2
            score = known[m[a][:, :, None], m[b][:, None]] * np.exp(-d2 / (2.0 * sigma * sigma))
            if orders is not None:
                return np.max([sum(score[:, k, o[k]] for k in range(n)) / n for o in orders], axis=0) if len(a) else np.zeros(0)
            # No matching is better than each subpart with its best partner.
            mean = score.max(axis=2).mean(axis=1)
            for k in np.flatnonzero(mean >= least * (1 - 1e-9)):
                mean[k] = score[k][np.arange(n), assignment(1 - score[k])].mean()
            return mean

        def within() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            bounds = []
            if found:
                for c in (dx, dy):
                    bounds += [(c.sum(axis=1), found[1]), *[(v, found[0]) for v in np.sort(c, axis=1).T]]
            there = np.flatnonzero(~asks)
            step = max(1, (1 << 22) // max(1, len(there)))
            for start in range(0, int(asks.sum()), step):
                here = np.flatnonzero(asks)[start : start + step]
                near = np.ones((len(here), len(there)), dtype=bool)
                for v, most in bounds:
                    small = v.astype(np.int32)
                    near &= np.abs(small[here][:, None] - small[there]) <= most
                places = np.argwhere(near)
                for some in np.array_split(places, len(places) // PAIRS + 1):
                    yield here[some[:, 0]], there[some[:, 1]]

        moves = _moves(n, strongest, sigma, least)
        met = _moved_pairs(dx, dy, asks, moves) if moves else None
        lowest = np.full(len(asks), -1)
        for i, j in within() if met is None else met:
            if once:
                smaller = names_of[i] <= names_of[j]
                i, j = i[smaller], j[smaller]
            for a, b in zip(np.array_split(i, len(i) // 65536 + 1), np.array_split(j, len(i) // 65536 + 1), strict=True):
                mean = best(a, b)
                if once:  # sums of another order differ in their last bit: the larger one
                    mean = np.maximum(mean, best(b, a))
                kept = mean >= least
                a, b, mean = a[kept], b[kept], mean[kept]
                if first:  # the smallest other of each row that asks
                    order = np.lexsort((names_of[b], a))
                    a, b = a[order], b[order]
                    head = np.diff(a, prepend=-1) != 0
                    a, b = a[head], b[head]
                    better = (lowest[a] < 0) | (names_of[b] < names_of[lowest[a]])
                    lowest[a[better]] = b[better]
                elif len(a):
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(mean)], ["class", "other", "similarity"])
        if first and (lowest >= 0).any():
            a = np.flatnonzero(lowest >= 0)
            b = lowest[a]
            mean = np.concatenate([best(*pair) for pair in zip(np.array_split(a, len(a) // 65536 + 1), np.array_split(b, len(a) // 65536 + 1), strict=True)])
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(mean)], ["class", "other", "similarity"])

    return rows.groupBy("n", "cx", "cy", "block").applyInArrow(compare, schema)


def similarities(sub: DataFrame, types: DataFrame, sigma: float, least: float, digits: int | None = None) -> DataFrame:
    """(part, other, similarity) of parts with equally many subparts that are similar by
    ``least`` or more: over all matchings of their subparts the best mean of type
    similarity times a normal of the distance. ``types`` is (m, other, s); what it lacks
    is 0. Recursive: a layer's result is the next layer's ``types``.

    Parts of the same subparts are alike, so only their classes are compared. A class goes
    by its parts, so that each pair of similar classes becomes the pairs of their parts where
    it is found, and no pair moves. With ``digits`` the similarity is rounded, once for all
    parts of two classes."""
    classes = stored(_classes(sub).select(F.array_sort("parts").alias("class"), "subs"), "classes")
    found = class_similarities(classes.withColumn("weight", F.size("class")), types, sigma, least)
    if digits is not None:
        found = found.withColumn("similarity", F.round("similarity", digits))
    return found.select(F.explode("class").alias("part"), "other", "similarity").select("part", F.explode("other").alias("other"), "similarity")


def alike_classes(sub: DataFrame, types: DataFrame, sigma: float, least: float, once: bool = False) -> tuple[DataFrame, DataFrame]:
    """(part, class) and (class, other, similarity), where parts of a class are wholly alike: one
    whose subparts are not alike themselves (of types without a mask) is a class of its own.
    With ``once`` each two classes have one row."""
    parts = stored(part_classes(sub), "classes")
    pairs = stored(class_similarities(parts.where("part = class"), types, sigma, least, once), "alike")
    self_alike = pairs.where(f"class = other AND similarity > {1 - 1e-9}").select("class")
    several = parts.where("part <> class").select("class").distinct()
    apart = stored(several.join(self_alike, "class", "left_anti"), "apart")
    if apart.limit(1).count():
        names = parts.join(apart.withColumn("alone", F.lit(True)), "class", "left").select("class", "part", F.when(F.col("alone"), F.col("part")).otherwise(F.col("class")).alias("name"))
        ends = names.select("class", "name").distinct()
        pairs = pairs.join(ends, "class").join(ends.select(F.col("class").alias("other"), F.col("name").alias("o_name")), "other").select(F.col("name").alias("class"), F.col("o_name").alias("other"), "similarity")
        return names.select("part", F.col("name").alias("class")), pairs
    return parts.select("part", "class"), pairs


def place_classes(sub: DataFrame, types: DataFrame, sigma: float, least: float) -> tuple[DataFrame, DataFrame, DataFrame] | None:
    """(part, class), (class, subs) and types for parts that only the places of their subparts
    tell apart: where all types are so alike that no two sets of places pass ``least`` for
    some of them only, parts of the same places are similar to the same parts. Nothing where
    some do, or where a type has no mask: then types decide."""
    parts = stored(sub.groupBy("part").agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("dx", "dy", "sub_m")]))).alias("subs")), "parts")
    named = parts.select(F.explode("subs.sub_m").alias("m")).distinct()
    table = {(r["m"], r["other"]): r["s"] for r in types.select("m", "other", "s").collect()}  # the types of a model
    used = [r["m"] for r in named.collect()]
    of_pair = [table.get((m, o), 0.0) for m in used for o in used]
    weakest, strongest = min(of_pair, default=0.0), max(of_pair, default=0.0)
    most = parts.agg(F.max(F.size("subs"))).first()[0]
    for n in range(1, (most or 0) + 1):
        if not _decided(n, weakest, strongest, sigma, least):
            return None
    at = F.transform("subs", lambda t: F.struct(t["dx"].alias("dx"), t["dy"].alias("dy"), F.lit(0).alias("sub_m")))
    placed = parts.select("part", at.alias("subs")).groupBy("subs").agg(F.min("part").alias("class"), F.collect_list("part").alias("parts"))
    placed = stored(placed, "places")
    one = parts.sparkSession.createDataFrame([(0, 0, float(strongest))], "m int, other int, s double")
    return placed.select(F.explode("parts").alias("part"), "class"), placed.select("class", "subs"), one


def _decided(n: int, weakest: float, strongest: float, sigma: float, least: float) -> bool:
    """Whether a matching of ``n`` whole distances is as good as ``least``, or not, for the
    weakest types as for the strongest."""
    if weakest < least + 1e-6:
        return False
    # A hair more, so that what is just not as good is looked at too.
    moves = _moves(n, strongest, sigma, least - 1e-6)
    if moves is None:
        return False
    mean = np.exp(-(moves[0] ** 2 + moves[1] ** 2) / (2 * sigma * sigma)).mean(axis=1)
    return bool((mean * weakest >= least + 1e-6).all())


def similarity_roots(similar: DataFrame, least: float) -> DataFrame:
    """(part, root): the smallest part at least so similar, itself included."""
    return similar.where(F.col("similarity") >= least).groupBy("part").agg(F.min("other").alias("root"))


def with_categories(center: DataFrame, members: DataFrame) -> DataFrame:
    """(part, category): new parts after the last one, one a category (name, part)."""
    start = center.agg(F.max("part").alias("last"))  # one row
    new = numbered(members.select("name").distinct(), [], ["name"], "k").crossJoin(start).select("name", (F.col("last") + F.col("k")).cast("int").alias("category"))
    return members.join(new, "name").select("part", "category")


def redundant(structures: DataFrame) -> DataFrame:
    """(part, kept): parts of equal structure and the smallest of them."""
    first = structures.groupBy("structure").agg(F.min("part").alias("kept"))
    return structures.join(first, "structure").select("part", "kept")


def kept_models(hits: DataFrame, ratio: float, share: float) -> DataFrame:
    """Models (m, n_hits, n_misses, n_boxes) with hits, of at least so good a ratio, that
    find more than the share of the boxes."""
    good = F.try_divide(F.col("n_hits").cast("double"), F.col("n_hits") + F.col("n_misses"))
    return hits.where((F.col("n_hits") > 0) & (good >= ratio) & (F.col("n_hits") > share * F.col("n_boxes"))).withColumn("ratio", good)
