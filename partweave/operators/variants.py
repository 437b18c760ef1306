"""Variants of inference, and checks and edits of layers and libraries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.operators.inference import best_matches, matches


def sliding_matches(cand: DataFrame, nodes: DataFrame, lib_sub: DataFrame, kernel: DataFrame, least: float, factors: list[float]) -> DataFrame:
    """The best node of each candidate's subpart over windows slid along the offset: the
    offset times each factor."""
    factor = F.explode(F.array(*[F.lit(float(f)) for f in factors])).alias("_f")
    slid = lib_sub.select("part", "idx", "sub_m", "dx", "dy", factor)
    place = lambda c: F.round(F.col(c) * F.col("_f")).cast("int").alias(c)
    return best_matches(matches(cand, nodes, slid.select("part", "idx", "sub_m", place("dx"), place("dy")).distinct(), kernel, least))


def centred_matches(cand: DataFrame, nodes: DataFrame, lib_sub: DataFrame, kernel: DataFrame, least: float) -> DataFrame:
    """Matches in the window around the candidate's own position, without offsets."""
    return matches(cand, nodes, lib_sub.withColumns({"dx": F.lit(0), "dy": F.lit(0)}), kernel, least)


def copied_layer(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The layer one up with the same nodes, and identity edges to those below."""
    up = nodes.withColumns({"z": F.col("z") + 1, "node_id": F.col("node_id") * 16 + F.col("z") + 1})
    edges = nodes.select((F.col("node_id") * 16 + F.col("z") + 1).alias("src"), F.col("node_id").alias("dst"), F.lit("identity").alias("name"))
    return up, edges


def without_link(nodes: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Nodes (node) that lack a link of the name; where one must be there, an error."""
    return nodes.join(edges.where(F.col("name") == name).select(F.col("src").alias("node")).distinct(), "node", "left_anti")


def leaves_off_layer(edges: DataFrame) -> DataFrame:
    """(leaf, z): ends of edges that lie above layer 0."""
    ends = edges.select(F.col("dst").alias("leaf"), (F.col("z") - 1).alias("z")).distinct()
    return ends.join(edges.select(F.col("src").alias("leaf")).distinct(), "leaf", "left_anti").where("z > 0")


def overridden(nodes: DataFrame, covers: DataFrame) -> DataFrame:
    """``nodes`` whose r is lowered to that of the best node that covers them: ``covers`` is
    (node_id, r of the coverer)."""
    best = covers.groupBy("node_id").agg(F.max("r").alias("_r"))
    return nodes.join(best, "node_id", "left").withColumn("r", F.least("r", F.coalesce("_r", "r"))).drop("_r")


def transformed_paths(maps: DataFrame, dx: float, dy: float, factor: float) -> DataFrame:
    """Path maps with their points moved and scaled."""
    return maps.withColumns({"x": (F.col("x") + dx) * factor, "y": (F.col("y") + dy) * factor})


def thinned_paths(maps: DataFrame, keys: list[str], radii: list[int], most: int) -> DataFrame:
    """Path maps of at most ``most`` points where a radius allows it: of each square of 2r + 1
    the first path stays, with the first radius that leaves few enough, else the last."""
    out, left = None, maps
    for k, r in enumerate(radii):
        square = [F.floor(F.col("x") / (2 * r + 1)), F.floor(F.col("y") / (2 * r + 1))]
        kept = left.groupBy(*keys, *[s.alias(n) for s, n in zip(square, ("_i", "_j"), strict=True)]).agg(F.min(F.struct("path", "x", "y")).alias("p")).select(*keys, "p.*", F.lit(r).alias("radius"))
        sizes = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        done = sizes if k == len(radii) - 1 else sizes.where(F.col("_n") <= most)
        found = kept.join(done.select(*keys), keys, "left_semi")
        out = found if out is None else out.unionByName(found)
        left = left.join(done.select(*keys), keys, "left_anti")
    return out


def nearest_listed(points: DataFrame, listed: list[tuple[int, int]]) -> Column:
    """The index of the list's point nearest to (x, y), the first on ties."""
    far = F.array(*[F.struct(((F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)).alias("d2"), F.lit(k).alias("k")) for k, (x, y) in enumerate(listed)])
    return F.array_min(far)["k"]


def angle_classes(angle: Column, table: list[tuple[float, str]]) -> Column:
    """The value of the last entry (from, value) of a sorted table that an angle reaches."""
    out = F.lit(table[0][1])
    for start, value in table[1:]:
        out = F.when(angle >= start, value).otherwise(out)
    return out


def extended_parts(sub: DataFrame, more: DataFrame) -> DataFrame:
    """Subparts with further ones (part, sub_m, dx, dy), numbered on within their part."""
    last = sub.groupBy("part").agg(F.max("idx").alias("_last"))
    order = F.array_sort(F.collect_list(F.struct("sub_m", "dx", "dy")))  # of a part: a handful
    listed = more.groupBy("part").agg(order.alias("_s")).select("part", F.posexplode("_s").alias("_k", "s"))
    new = listed.join(last, "part", "left").select("part", (F.coalesce("_last", F.lit(0)) + F.col("_k") + 1).alias("idx"), "s.sub_m", "s.dx", "s.dy")
    return sub.select("part", "idx", "sub_m", "dx", "dy").unionByName(new)


def feature_vectors(points: DataFrame, keys: list[str]) -> DataFrame:
    """Numbers of each key's ellipse: size, place, axes' ratio and turn, as a vector."""
    s = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.var_pop("x").alias("a"), F.covar_pop("x", "y").alias("b"), F.var_pop("y").alias("c"))
    root = F.sqrt((F.col("a") - F.col("c")) * (F.col("a") - F.col("c")) / 4 + F.col("b") * F.col("b"))
    half = (F.col("a") + F.col("c")) / 2
    ratio = F.when(half + root > 0, (half - root) / (half + root)).otherwise(F.lit(1.0))
    turn = F.atan2(2 * F.col("b"), F.col("a") - F.col("c")) / 2
    return s.select(*keys, F.array(F.col("n").cast("double"), F.col("mx"), F.col("my"), ratio, turn).alias("v"))


def subspace_distances(vectors: DataFrame, mean: list[float], axes: list[list[float]], vector_col: str = "h") -> DataFrame:
    """``vectors`` with the squared distance to the subspace of the axes through the mean;
    mean and axes are a model."""
    centred = F.zip_with(F.col(vector_col), F.lit(mean), lambda v, m: v - m)
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v)
    along = [F.aggregate(F.zip_with(centred, F.lit(list(axis)), lambda v, w: v * w), F.lit(0.0), lambda s, v: s + v) for axis in axes]
    inside = sum((c * c for c in along), F.lit(0.0))
    return vectors.withColumn("d2", F.greatest(F.lit(0.0), square(centred) - inside))
