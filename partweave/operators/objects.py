"""Object layers: scaled and displaced matching, missing subparts, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partweave.operators.ranges import window_join


def scaled_matches(cand: DataFrame, nodes: DataFrame, lib_sub: DataFrame, factors: list[float], shifts: list[tuple[int, int]]) -> DataFrame:
    """Per candidate, subpart, scale factor and displacement the node found at the
    scaled offset: (cand_id, part, f, sx, sy, idx, r). The variants are a few of the
    model's own, written out before one equi-join."""
    variants = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(x).alias("sx"), F.lit(y).alias("sy")) for f in factors for x, y in shifts])
    asked = (
        cand.join(lib_sub, "part")
        .withColumn("v", F.explode(variants))
        .select(
            "image_id", "cand_id", "part", "idx", "sub_m", "v.f", "v.sx", "v.sy",
            (F.col("x") + F.round(F.col("dx") * F.col("v.f")).cast("int") + F.col("v.sx")).alias("ax"),
            (F.col("y") + F.round(F.col("dy") * F.col("v.f")).cast("int") + F.col("v.sy")).alias("ay"),
        )
    )
    there = nodes.select(F.col("image_id").alias("i"), F.col("x").alias("nx"), F.col("y").alias("ny"), F.col("m").alias("nm"), "r")
    met = asked.join(there, (F.col("image_id") == F.col("i")) & (F.col("ax") == F.col("nx")) & (F.col("ay") == F.col("ny")) & (F.col("sub_m") == F.col("nm")))
    return met.select("image_id", "cand_id", "part", "f", "sx", "sy", "idx", "r")


def infer_objects(cand: DataFrame, found: DataFrame, least_share: float, n_subs: DataFrame) -> DataFrame:
    """The best variant of each candidate: most realised subparts, then the highest
    r, then the smallest factor and shift. The part count starts at 1 for the centre.
    ``n_subs`` is (part, n_sub)."""
    per = found.groupBy("image_id", "cand_id", "part", "f", "sx", "sy").agg(F.count(F.lit(1)).alias("n"), F.sum("r").alias("sum_r"))
    met = cand.select("cand_id", "part", "x", "y", "r_c").join(per, ["cand_id", "part"]).join(n_subs, "part")
    scored = met.withColumns({"part_count": F.col("n") + 1, "r": (F.col("sum_r") + F.col("r_c")) / (F.col("n") + 1)})
    held = scored.where(F.col("n") / F.col("n_sub") >= least_share)
    w = Window.partitionBy("cand_id", "part").orderBy(F.desc("n"), F.desc(F.round("r", 9)), "f", "sx", "sy")
    return held.withColumn("_n", F.row_number().over(w)).where("_n = 1").select("image_id", "cand_id", "part", "x", "y", "f", "sx", "sy", "part_count", "r")


def apart(objects: DataFrame, distance: int) -> DataFrame:
    """Objects without a better one of their part within the distance."""
    met = window_join(
        objects.select("image_id", "part", "x", "y", "cand_id", "r"), objects.select("image_id", "part", "x", "y", "cand_id", "r"), ["image_id", "part"], distance, distance
    )
    rank = lambda p: F.struct(F.round(p + "r", 9), -F.col(p + "cand_id"))
    beaten = met.where(rank("o_") > rank("")).select("cand_id", "part").distinct()
    return objects.join(beaten, ["cand_id", "part"], "left_anti")


def missing_subparts(cand: DataFrame, best: DataFrame, lib_sub: DataFrame, most_share: float) -> DataFrame:
    """Hypothetical nodes (image_id, x, y, m, votes): places of unrealised subparts
    of candidates that miss at most a share of theirs."""
    asked = cand.join(lib_sub, "part").select("image_id", "cand_id", "part", "idx", "sub_m", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"))
    key = ["image_id", "cand_id", "part"]
    # One pass: how many each candidate asks for and misses stands beside each place asked for.
    met = asked.join(best.select(*key, "idx", F.lit(1).alias("hit")), [*key, "idx"], "left")
    own = Window.partitionBy(*key)
    counted = met.withColumns({"_g": F.count_if(F.col("hit").isNull()).over(own), "_n": F.count(F.lit(1)).over(own)})
    votes = counted.where(F.col("hit").isNull() & (F.col("_g") / F.col("_n") <= most_share))
    return votes.groupBy("image_id", "x", "y", F.col("sub_m").alias("m")).agg(F.count(F.lit(1)).alias("votes"))


def nearest_in_annulus(nodes: DataFrame, inner: int, outer: int) -> DataFrame:
    """Each node's nearest of its type at a distance from ``inner`` to ``outer``."""
    met = window_join(nodes.select("image_id", "m", "x", "y", "node_id"), nodes.select("image_id", "m", "x", "y", "node_id"), ["image_id", "m"], outer, outer)
    d2 = (F.col("x") - F.col("o_x")) * (F.col("x") - F.col("o_x")) + (F.col("y") - F.col("o_y")) * (F.col("y") - F.col("o_y"))
    ring = met.withColumn("d2", d2).where((F.col("d2") >= inner * inner) & (F.col("d2") <= outer * outer))
    best = ring.groupBy("node_id").agg(F.min(F.struct("d2", F.col("o_node_id").alias("near_id"))).alias("b"))
    return best.select("node_id", "b.near_id", "b.d2")


def directional_maxima(cells: DataFrame) -> DataFrame:
    """Cells (image_id, m, x, y, v) that no neighbour across their type's
    orientation beats; types count quarter turns of 45 degrees."""
    dx = F.when(F.col("m") % 4 == 2, 0).otherwise(1)
    dy = F.when(F.col("m") % 4 == 0, 0).when(F.col("m") % 4 == 3, -1).otherwise(1)
    asked = cells.withColumn("s", F.explode(F.array(F.lit(-1), F.lit(1)))).select("image_id", "m", "x", "y", "v", (F.col("x") + F.col("s") * dx).alias("ax"), (F.col("y") + F.col("s") * dy).alias("ay"))
    other = cells.select(F.col("image_id").alias("i"), F.col("m").alias("om"), F.col("x").alias("ox"), F.col("y").alias("oy"), F.col("v").alias("ov"))
    beaten = asked.join(other, (F.col("image_id") == F.col("i")) & (F.col("m") == F.col("om")) & (F.col("ax") == F.col("ox")) & (F.col("ay") == F.col("oy")) & (F.col("ov") > F.col("v")))
    return cells.join(beaten.select("image_id", "m", "x", "y").distinct(), ["image_id", "m", "x", "y"], "left_anti")
