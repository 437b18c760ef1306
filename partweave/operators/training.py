"""The learning loop over layers: statistics, candidates, selection, inference.

Each step is a Spark job over all images; what goes from step to step is a
library of a bounded number of parts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partweave.operators import inference, learning


@dataclass(frozen=True)
class Settings:
    """Bounds and thresholds of one layer."""

    radius: int = 4
    peak_radius: int = 2
    peak_share: float = 0.3
    peaks: int = 2
    tolerance: int = 1
    least: float = 0.2
    longest: int = 2
    most_parts: int = 20
    match: float = 0.1
    least_r: float = 0.2
    least_g: float = 0.0
    per_position: int = 2


def library_tables(sequences: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(lib_center, lib_sub) of the ``most`` sequences of the largest support; a part's
    number is its rank."""
    top = learning.cut_by_support(sequences, most)
    parts = F.split("seq", ">")
    numbered = top.select((F.row_number().over(Window.orderBy(F.desc("n"), "seq")) - 1).alias("part"), parts.alias("p"))
    center = numbered.select("part", F.col("p")[0].cast("int").alias("center_m"), F.lit(0).alias("cmx"), F.lit(0).alias("cmy"), F.size("p").alias("bp"))
    subs = numbered.select("part", F.posexplode(F.slice("p", F.lit(2), F.size("p"))).alias("k", "s"))
    number = lambda group: F.regexp_extract("s", r"^(-?\d+)@(-?\d+),(-?\d+)$", group).cast("int")
    return center, subs.select("part", (F.col("k") + 1).alias("idx"), number(1).alias("sub_m"), number(2).alias("dx"), number(3).alias("dy"))


def learn_layer(nodes: DataFrame, kernel: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lib_center, lib_sub, nodes of the next layer)."""
    s = settings
    peaks = learning.duplets(nodes, radius=s.radius, peak_radius=s.peak_radius, share=s.peak_share, most=s.peaks)
    sequences = learning.part_sequences(nodes, peaks, tolerance=s.tolerance, least=s.least, longest=s.longest)
    center, sub = library_tables(sequences, s.most_parts)
    # The library is read again by every job that uses it: a table of a few parts, whose
    # size Spark knows once it is there.
    center, sub = center.cache(), sub.cache()
    for table in (center, sub):
        table.count()
    above = inference.infer_layer(nodes, center, sub, kernel, least_r=s.least_r, least_g=s.least_g, match=s.match, per_position=s.per_position)
    return center, sub, above.select("image_id", "z", "x", "y", "m", "r", "g", "rr", "node_id")


def learn_layers(nodes: DataFrame, kernel: DataFrame, settings: list[Settings]) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """One entry per layer, each learned on the nodes of the layer below."""
    out = []
    for s in settings:
        layer = learn_layer(nodes, kernel, s)
        out.append(layer)
        # A candidate id names a node of the layer below; each layer gets ids of its own.
        nodes = layer[2].withColumn("node_id", F.xxhash64("image_id", "z", "x", "y", "m"))
    return out


def reestimated(lib_sub: DataFrame, found: DataFrame, cand: DataFrame, nodes: DataFrame) -> DataFrame:
    """``lib_sub`` with each subpart's offset moved to the mean of its realised ones;
    ``found`` is (image_id, cand_id, part, idx, sub_id)."""
    at = nodes.select("image_id", F.col("node_id").alias("sub_id"), F.col("x").alias("sx"), F.col("y").alias("sy"))
    seen = found.join(cand.select("image_id", "cand_id", "part", "x", "y"), ["image_id", "cand_id", "part"]).join(at, ["image_id", "sub_id"])
    mean = seen.groupBy("part", "idx").agg(F.round(F.avg(F.col("sx") - F.col("x"))).cast("int").alias("mx"), F.round(F.avg(F.col("sy") - F.col("y"))).cast("int").alias("my"))
    return lib_sub.join(mean, ["part", "idx"], "left").select("part", "idx", "sub_m", F.coalesce("mx", "dx").alias("dx"), F.coalesce("my", "dy").alias("dy"))


def covering_parts(layer: DataFrame, most: int) -> list[int]:
    """Part types in the order of a greedy cover of the positions they explain."""
    place = F.xxhash64("image_id", "x", "y").alias("leaf")
    return [m for m, _ in learning.greedy_types(layer.select("m", place), most)]
