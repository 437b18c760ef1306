"""Vectors, histograms and point sets as higher-order column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, v: acc + v)


def scaled(a: Column, by) -> Column:
    return F.transform(a, lambda v: v * by)


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def euclidean2(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def l1_normalised(a: Column) -> Column:
    """Components over their sum; an all-zero vector stays as it is."""
    s = total(a)
    return F.when(s == 0, a).otherwise(F.transform(a, lambda v: v / s))


def chi_square(a: Column, b: Column) -> Column:
    """Half the sum of (a - b)^2 / (a + b) over the shorter length, 0/0 as 0."""
    n = F.least(F.size(a), F.size(b))
    terms = F.zip_with(
        F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: F.when(x + y == 0, F.lit(0.0)).otherwise((x - y) * (x - y) / (x + y))
    )
    return total(terms) / 2


def argsort(a: Column, descending: bool = False) -> Column:
    keyed = F.transform(a, lambda v, i: F.struct((-v if descending else v).alias("v"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda s: s["i"])


def jaccard(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)))


def overlap_share(a: Column, b: Column) -> Column:
    """|A n B| / min(|A|, |B|)."""
    return F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.least(F.size(a), F.size(b)))


def proper_subset(a: Column, b: Column) -> Column:
    return (F.size(F.array_except(a, b)) == 0) & (F.size(a) < F.size(b))


def directed_hausdorff2(a: Column, b: Column) -> Column:
    """max over points of a of the least squared distance to b; points are
    structs x, y."""
    near = F.transform(
        a, lambda p: F.array_min(F.transform(b, lambda q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))
    )
    return F.array_max(near)


def single_linkage2(a: Column, b: Column) -> Column:
    """The least squared distance between two point sets."""
    near = F.transform(
        a, lambda p: F.array_min(F.transform(b, lambda q: (p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))
    )
    return F.array_min(near)


def loop_value(values: Column, loop: Column) -> Column:
    """The parameter at an iteration; the last one is repeated."""
    return F.element_at(values, F.least(loop + 1, F.size(values)))


def sparse_text(a: Column) -> Column:
    """``idx:value`` of the nonzero components, from index 1."""
    pairs = F.transform(a, lambda v, i: F.struct((i + 1).alias("i"), v.alias("v")))
    return F.array_join(F.transform(F.filter(pairs, lambda p: p["v"] != 0), lambda p: F.concat_ws(":", p["i"].cast("string"), p["v"].cast("string"))), " ")
