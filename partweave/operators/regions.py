"""Regions and curves: polygons filled by scan lines, splines through points, fitted cubics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partweave.operators.keyed import by_sorted_keys

#: Nodes and weights of five-point Gauss-Legendre quadrature on 0..1.
GAUSS = [(float((x + 1) / 2), float(w / 2)) for x, w in zip(*np.polynomial.legendre.leggauss(5), strict=True)]

#: Up to this number a crossing and its row fit into one double to well below a hair.
EXACT = 1 << 22


def _spans(owner: np.ndarray, x: np.ndarray, y: np.ndarray, nxt: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, y, first, last), sorted, of the pixels of many polygons, without overlaps. Rows of
    polygons are numbered, so a crossing is one number that is sorted as such."""
    edge = np.flatnonzero(y != y[nxt])
    low = y[edge] < y[nxt][edge]
    a, c = np.where(low, edge, nxt[edge]), np.where(low, nxt[edge], edge)
    heights = y[c] - y[a]
    a, c = np.repeat(a, heights), np.repeat(c, heights)
    up = np.arange(len(a)) - np.repeat(np.cumsum(heights) - heights, heights)
    left, bottom = int(x.min(initial=0)) - 1, int(y.min(initial=0))
    wide, high = int(x.max(initial=0)) - left + 2, int(y.max(initial=0)) - bottom + 1
    at = x[a] - left + up * (x[c] - x[a]) / (y[c] - y[a])
    row = owner[a] * high + y[a] + up - bottom
    # A polygon is closed: of the edges over a row there are two, or four, and so on.
    if int(owner.max(initial=0) + 1) * high * wide <= EXACT:
        key = np.sort(row * wide + at)
        row = (key[::2] // wide).astype(np.int64)
        begin, end = key[::2] - row * wide, key[1::2] - row * wide
    else:
        order = np.lexsort((at, row))
        row, begin, end = row[order][::2], at[order][::2], at[order][1::2]
    # A crossing a hair beside a pixel by rounding is on it.
    first, last = np.ceil(begin - 1e-9).astype(np.int64), np.floor(end + 1e-9).astype(np.int64)
    some = first <= last
    row = np.concatenate([row[some], owner * high + y - bottom])
    first, last = np.concatenate([first[some], x - left]), np.concatenate([last[some], x - left])
    if int(owner.max(initial=0) + 1) * high * wide <= EXACT:
        span, last = np.divmod(np.sort((row * wide + first) * wide + last), wide)
        row, first = np.divmod(span, wide)
    else:
        order = np.lexsort((last, first, row))
        row, first, last = row[order], first[order], last[order]
    # Spans that overlap are one: the furthest end so far, counted up from row to row.
    far = np.maximum.accumulate(last + row * wide) - row * wide
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (first[1:] > far[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(row)) - 1
    own, row = np.divmod(row[begin], high)
    return own, row + bottom, first[begin] + left, far[end[: len(begin)]] + left


def filled_spans(corners: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, y, first, last): the pixels of each polygon (keys, k, x, y; whole numbers, closed
    by its first corner) as spans of its rows that do not overlap. A row takes the edges that
    begin at it or below and end above it; between each two of their crossings all pixels
    belong to the region, both ends included. The corners belong to it as well."""

    def run(ends: np.ndarray, _: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
        nxt = np.arange(1, ends[-1] + 1)
        nxt[ends[1:] - 1] = ends[:-1]
        owner, *spans = _spans(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), x.astype(np.int64), y.astype(np.int64), nxt)
        return owner, *[s.astype(np.int32) for s in spans]

    return by_sorted_keys(corners, keys, ["k", "x", "y"], ["k"], "y int, first int, last int", run)


def filled(corners: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y): the pixels of ``filled_spans``."""
    return filled_spans(corners, keys).select(*keys, F.explode(F.sequence("first", "last")).alias("x"), "y")


def filled_sizes(corners: DataFrame, keys: list[str], name: str = "n_pixels") -> DataFrame:
    """(keys, name): how many pixels each polygon has, counted where its spans are found."""

    def run(ends: np.ndarray, _: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
        nxt = np.arange(1, ends[-1] + 1)
        nxt[ends[1:] - 1] = ends[:-1]
        owner, _, first, last = _spans(np.repeat(np.arange(len(ends) - 1), np.diff(ends)), x.astype(np.int64), y.astype(np.int64), nxt)
        sizes = np.bincount(owner, weights=last - first + 1, minlength=len(ends) - 1)
        return np.arange(len(ends) - 1), sizes.astype(np.int64)

    return by_sorted_keys(corners, keys, ["k", "x", "y"], ["k"], f"{name} long", run)


def spline(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, a0..a3, b0..b3): cubic pieces through points (keys, k, x, y) in order, whose
    tangents are half the way from the point before to the point after (at the ends, to or
    from the neighbour). Piece k is x = a0 + a1 t + a2 t**2 + a3 t**3, t from 0 to 1."""
    own = Window.partitionBy(*keys).orderBy("k")
    at = lambda c, n: F.lead(c, n).over(own) if n > 0 else F.lag(c, -n).over(own)
    around = points.withColumns({f"{c}{n}": at(c, n) for c in "xy" for n in (-1, 1, 2)}).where("x1 IS NOT NULL")
    out = {}
    for c, name in (("x", "a"), ("y", "b")):
        here, there = F.col(c), F.col(f"{c}1")
        begin = F.when(F.col(f"{c}-1").isNull(), there - here).otherwise((there - F.col(f"{c}-1")) / 2)
        end = F.when(F.col(f"{c}2").isNull(), there - here).otherwise((F.col(f"{c}2") - here) / 2)
        out |= {f"{name}0": here.cast("double"), f"{name}1": begin.cast("double"), f"{name}2": 3 * (there - here) - 2 * begin - end, f"{name}3": 2 * (here - there) + begin + end}
    return around.select(*keys, "k", *[v.cast("double").alias(n) for n, v in out.items()])


def piece_length() -> Column:
    """The arc length of a piece of ``spline`` by five-point quadrature."""
    total = F.lit(0.0)
    for t, w in GAUSS:
        dx, dy = (F.col(f"{c}1") + 2 * t * F.col(f"{c}2") + 3 * t * t * F.col(f"{c}3") for c in "ab")
        total = total + w * F.sqrt(dx * dx + dy * dy)
    return total


def fitted_cubics(points: DataFrame, keys: list[str], degree: int = 3) -> DataFrame:
    """(keys, n, cx, cy): the least-squares polynomials x(t) and y(t) of points (keys, t, x, y),
    lowest power first. Only sums of powers meet, so a key may hold any number of points; a
    key with too few different t gets the shortest solution."""
    power = lambda p: F.pow("t", F.lit(float(p)))
    sums = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.sum(power(p)) for p in range(2 * degree + 1)]).alias("tt"),
        *[F.array(*[F.sum(power(p) * F.col(c)) for p in range(degree + 1)]).alias(f"t{c}") for c in "xy"],
    )
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = {"cx": [], "cy": []}
            for tt, tx, ty in zip(frame["tt"], frame["tx"], frame["ty"], strict=True):
                normal = np.array([[tt[i + j] for j in range(degree + 1)] for i in range(degree + 1)])
                for name, own in (("cx", tx), ("cy", ty)):
                    found[name].append(np.linalg.lstsq(normal, np.asarray(own), rcond=1e-12)[0].tolist())
            yield frame[[*keys, "n"]].assign(**found)

    return sums.mapInPandas(solve, f"{kinds}, n long, cx array<double>, cy array<double>")
