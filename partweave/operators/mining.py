"""All combinations of supported subparts around centres, size by size.

A centre supports subparts: nodes found where the peaks of its type's offsets point.
Combinations of one size meet their centre's supports and make those of the next;
a combination's subparts come in the order of their keys, so each set is made once, and
a centre has no more rows than its supports allow. A combination is counted over all
centres under its name, the centre's type and the keys of its subparts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partweave.operators.ranges import window_join, with_model


def supported_subparts(nodes: DataFrame, peaks: DataFrame, *, tolerance: int, least: float, centre_least: float = 0.0) -> DataFrame:
    """(image_id, centre, centre_m, sub, node_id, r, points): of each centre and peak of
    its type the best node near the peak's place, of a value over the share ``least`` of
    the centre's. ``sub`` numbers the peaks of a type: 1000 * subpart type + peak.
    ``nodes``: (image_id, node_id, x, y, m, r, points); ``peaks``: (m, o_m, peak, dx, dy)."""
    centres = nodes.where(F.col("r") >= centre_least).select("image_id", F.col("node_id").alias("centre"), "x", "y", "m", F.col("r").alias("centre_r"))
    aims = with_model(centres, "m", peaks.select(F.col("m").alias("of"), "o_m", "peak", "dx", "dy"), "of").select(
        "image_id", "centre", "m", "centre_r", F.col("_p.o_m").alias("aim"), (F.col("_p.o_m") * 1000 + F.col("_p.peak")).alias("sub"), (F.col("x") + F.col("_p.dx")).alias("x"), (F.col("y") + F.col("_p.dy")).alias("y")
    )
    other = nodes.select("image_id", "x", "y", F.col("m").alias("aim"), "node_id", "r")
    met = window_join(aims, other, ["image_id", "aim"], tolerance, tolerance).where((F.col("o_node_id") != F.col("centre")) & (F.col("o_r") > least * F.col("centre_r")))
    best = met.groupBy("image_id", "centre", F.col("m").alias("centre_m"), "sub").agg(F.max_by(F.struct("o_node_id", "o_r"), F.struct("o_r", -F.col("o_node_id"))).alias("b"))
    found = best.select("image_id", "centre", "centre_m", "sub", F.col("b.o_node_id").alias("node_id"), F.col("b.o_r").alias("r"))
    return found.join(nodes.select("image_id", "node_id", "points"), ["image_id", "node_id"])


def strongest(supports: DataFrame, most: int, share: float) -> DataFrame:
    """Of each centre the ``most`` best supports, and of these only those over ``share``
    of the best one's value."""
    by = Window.partitionBy("image_id", "centre")
    ranked = supports.withColumns({"_n": F.row_number().over(by.orderBy(F.desc("r"), "sub")), "_top": F.max("r").over(by)})
    return ranked.where((F.col("_n") <= most) & (F.col("r") > share * F.col("_top"))).drop("_n", "_top")


def combinations(supports: DataFrame, *, longest: int, least_shared: int = 0, most_shared: int | None = None, once: bool = True) -> DataFrame:
    """(image_id, centre, centre_m, subs, nodes, value): sets of 1 to ``longest`` subparts
    of a centre. A further subpart shares at least ``least_shared`` and at most
    ``most_shared`` points with those before it (keys ascending); with ``once`` no two
    subparts are the same node."""
    # A centre's supports are a value of its row, no more than its type has peaks; so all
    # sizes are made in place.
    own = supports.groupBy("image_id", "centre", "centre_m").agg(F.array_sort(F.collect_list(F.struct("sub", "node_id", "r", "points"))).alias("_s"))
    one = lambda s: F.struct(F.array(s["sub"]).alias("subs"), F.array(s["node_id"]).alias("nodes"), s["r"].alias("value"), s["points"].alias("points"))

    def fits(c, s):
        shared = F.size(F.array_intersect(c["points"], s["points"]))
        inside = shared >= least_shared if most_shared is None else shared.between(least_shared, most_shared)
        after = s["sub"] > F.element_at(c["subs"], -1)
        return after & ~F.array_contains(c["nodes"], s["node_id"]) & inside if once else after & inside

    def grown(c):
        more = lambda s: F.struct(F.concat(c["subs"], F.array(s["sub"])).alias("subs"), F.concat(c["nodes"], F.array(s["node_id"])).alias("nodes"), (c["value"] + s["r"]).alias("value"), F.array_union(c["points"], s["points"]).alias("points"))
        return F.transform(F.filter("_s", lambda s: fits(c, s)), more)

    level = own.withColumn("_1", F.transform("_s", one))
    for size in range(2, longest + 1):
        level = level.withColumn(f"_{size}", F.flatten(F.transform(f"_{size - 1}", grown)))
    found = level.select("image_id", "centre", "centre_m", F.explode(F.concat(*[f"_{size}" for size in range(1, longest + 1)])).alias("c"))
    return found.select("image_id", "centre", "centre_m", "c.subs", "c.nodes", "c.value")


def combination_statistics(found: DataFrame) -> DataFrame:
    """(centre_m, subs, n, n_images, mean_value) of each kind of combination; ``subs`` as
    text, so that kinds sort and compare everywhere alike."""
    return found.groupBy("centre_m", F.array_join(F.transform("subs", lambda s: s.cast("string")), ",").alias("subs")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("n_images"), F.avg("value").alias("mean_value")
    )
