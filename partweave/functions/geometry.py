"""Rectangles, points and polar bins as column expressions.

A rectangle is a struct or a set of columns llx, lly, urx, ury; its area is
half-open, and one with a negative side is invalid and has area 0.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDES = ("llx", "lly", "urx", "ury")


def box(llx, lly, urx, ury) -> Column:
    return F.struct(*[F.expr(v).alias(n) if isinstance(v, str) else v.alias(n) for n, v in zip(SIDES, (llx, lly, urx, ury), strict=True)])


def columns_box(prefix: str = "") -> Column:
    return F.struct(*[F.col(prefix + n).alias(n) for n in SIDES])


def area(b: Column) -> Column:
    w, h = b["urx"] - b["llx"], b["ury"] - b["lly"]
    return F.when((w > 0) & (h > 0), w * h).otherwise(0)


def intersection(a: Column, b: Column) -> Column:
    return box(F.greatest(a["llx"], b["llx"]), F.greatest(a["lly"], b["lly"]), F.least(a["urx"], b["urx"]), F.least(a["ury"], b["ury"]))


def union_box(a: Column, b: Column) -> Column:
    return box(F.least(a["llx"], b["llx"]), F.least(a["lly"], b["lly"]), F.greatest(a["urx"], b["urx"]), F.greatest(a["ury"], b["ury"]))


def intersection_area(a: Column, b: Column) -> Column:
    return area(intersection(a, b))


def union_area(a: Column, b: Column) -> Column:
    return area(a) + area(b) - intersection_area(a, b)


def iou(a: Column, b: Column) -> Column:
    """Null for two boxes without area."""
    return F.try_divide(intersection_area(a, b).cast("double"), union_area(a, b))


def min_overlap(a: Column, b: Column) -> Column:
    """The intersection's share of the smaller box."""
    return F.try_divide(intersection_area(a, b).cast("double"), F.least(area(a), area(b)))


def covered_share(a: Column, b: Column) -> Column:
    """The share of b that a covers."""
    return F.try_divide(intersection_area(a, b).cast("double"), area(b))


def translate(b: Column, dx, dy) -> Column:
    return box(b["llx"] + dx, b["lly"] + dy, b["urx"] + dx, b["ury"] + dy)


def scale_box(b: Column, factor) -> Column:
    return F.struct(*[F.round(b[n] * factor).cast("int").alias(n) for n in SIDES])


def pad(b: Column, by) -> Column:
    return box(b["llx"] - by, b["lly"] - by, b["urx"] + by, b["ury"] + by)


def mirror(b: Column, width) -> Column:
    return box(width - 1 - b["urx"], b["lly"], width - 1 - b["llx"], b["ury"])


def contains_point(b: Column, x: Column, y: Column, closed: bool = False) -> Column:
    upper = (x <= b["urx"]) & (y <= b["ury"]) if closed else (x < b["urx"]) & (y < b["ury"])
    return (x >= b["llx"]) & (y >= b["lly"]) & upper


def in_ellipse(dx: Column, dy: Column, a, b) -> Column:
    return dx * dx * b * b + dy * dy * a * a <= F.lit(a * a * b * b)


def distance2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def rotate(x: Column, y: Column, angle: Column) -> tuple[Column, Column]:
    return x * F.cos(angle) - y * F.sin(angle), x * F.sin(angle) + y * F.cos(angle)


def polar_bin(dx: Column, dy: Column, angles: int, radii: list[float]) -> Column:
    """Bin 0 is the centre; then sectors within rings; null beyond the last ring.
    Sectors are rounded by half a sector."""
    turn = 2 * math.pi
    r = F.sqrt(dx * dx + dy * dy)
    sector = F.floor(F.pmod(F.atan2(dy, dx) + turn / angles / 2, F.lit(turn)) / (turn / angles)).cast("int")
    ring = F.lit(None).cast("int")
    for k in range(len(radii) - 1, -1, -1):
        ring = F.when(r <= radii[k], k).otherwise(ring)
    return F.when((dx == 0) & (dy == 0), 0).otherwise(1 + ring * angles + sector)


def ellipse(sxx: Column, syy: Column, sxy: Column) -> tuple[Column, Column, Column]:
    """Half axes and angle of the ellipse with the given second moments."""
    mid, gap = (sxx + syy) / 2, F.sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy)
    return 2 * F.sqrt(mid + gap), 2 * F.sqrt(F.greatest(mid - gap, F.lit(0.0))), F.atan2(2 * sxy, sxx - syy) / 2


def best_rotation(pairs: Column) -> Column:
    """The angle that turns points (x, y) closest to their partners (u, v), for an
    array of structs x, y, u, v of centred points."""
    cross = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["x"] * p["v"] - p["y"] * p["u"])
    inner = F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["x"] * p["u"] + p["y"] * p["v"])
    return F.atan2(cross, inner)


def normalised_points(points: Column) -> Column:
    """Points less their mean, over their root mean square norm. The mean and the norm
    are fields of one-element arrays, so each is computed once and not once a point."""
    total = lambda value: F.aggregate(points, F.lit(0.0), lambda a, p: a + value(p))
    n = F.size(points)
    means = F.array(F.struct((total(lambda p: p["x"]) / n).alias("x"), (total(lambda p: p["y"]) / n).alias("y")))
    norm = lambda m: F.sqrt(total(lambda p: (p["x"] - m["x"]) * (p["x"] - m["x"]) + (p["y"] - m["y"]) * (p["y"] - m["y"])) / n)
    known = F.transform(means, lambda m: F.struct(m["x"].alias("x"), m["y"].alias("y"), norm(m).alias("norm")))
    scaled = F.transform(known, lambda k: F.transform(points, lambda p: F.struct(((p["x"] - k["x"]) / k["norm"]).alias("x"), ((p["y"] - k["y"]) / k["norm"]).alias("y"))))
    return scaled[0]


def tiles(b: Column, nx: int, ny: int) -> Column:
    """array of nx * ny equal rectangles of a box."""
    w, h = (b["urx"] - b["llx"]) / nx, (b["ury"] - b["lly"]) / ny
    return F.flatten(
        F.transform(
            F.sequence(F.lit(0), F.lit(nx - 1)),
            lambda i: F.transform(
                F.sequence(F.lit(0), F.lit(ny - 1)),
                lambda j: box(b["llx"] + F.floor(i * w).cast("int"), b["lly"] + F.floor(j * h).cast("int"), b["llx"] + F.floor((i + 1) * w).cast("int"), b["lly"] + F.floor((j + 1) * h).cast("int")),
            ),
        )
    )
