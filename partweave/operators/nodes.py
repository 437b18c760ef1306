"""Node tables: filters, rankings per position, thresholds against layer maxima."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partweave.operators.ranges import neighbour_counts, rank_in_cell

LAYER = ("image_id", "z")


def by_response() -> list[Column]:
    """The total order of co-located nodes: g, then r, then type and id."""
    return [F.desc("g"), F.desc("r"), F.asc("m"), F.asc("node_id")]


def response_filter(nodes: DataFrame, least: dict[str, float] | None = None, most: dict[str, float] | None = None, parts: DataFrame | None = None) -> DataFrame:
    """Nodes whose responses pass every bound. ``parts`` (m, resp, value) gives a
    part its own lower bound in place of the common one."""
    least, most = least or {}, most or {}
    if parts is not None:
        own = parts.groupBy("m").agg(F.map_from_entries(F.collect_list(F.struct("resp", "value"))).alias("own"))
        nodes = nodes.join(own, "m", "left")
        for name, value in least.items():
            nodes = nodes.where(F.col(name) >= F.coalesce(F.element_at("own", name), F.lit(value)))
        nodes = nodes.drop("own")
    else:
        for name, value in least.items():
            nodes = nodes.where(F.col(name) >= value)
    for name, value in most.items():
        nodes = nodes.where(F.col(name) <= value)
    return nodes


def of_types(nodes: DataFrame, types: list[int], low: int | None = None, high: int | None = None) -> DataFrame:
    """Nodes between two layers whose type is listed; an empty list lists all."""
    if low is not None:
        nodes = nodes.where(F.col("z").between(low, high if high is not None else low))
    return nodes.where(F.col("m").isin(types)) if types else nodes


def best_at_position(nodes: DataFrame) -> DataFrame:
    return rank_in_cell(nodes, by_response()).where("rn = 1").drop("rn")


def near_best(nodes: DataFrame, share: float, value: str = "g") -> DataFrame:
    """Per position the nodes of at least ``share`` of the best value."""
    best = F.max(value).over(Window.partitionBy("image_id", "z", "x", "y"))
    return nodes.withColumn("_best", best).where(F.col(value) >= share * F.col("_best")).drop("_best")


def dedup_top_k(nodes: DataFrame, k: int, value: str = "g") -> DataFrame:
    """One node per position and type, the best; then the k best per position, a
    tie dropping the larger type."""
    one = Window.partitionBy("image_id", "z", "x", "y", "m").orderBy(F.desc(value), F.asc("node_id"))
    top = Window.partitionBy("image_id", "z", "x", "y").orderBy(F.desc(value), F.asc("m"))
    return (
        nodes.withColumn("_n", F.row_number().over(one)).where("_n = 1").withColumn("_n", F.row_number().over(top)).where(F.col("_n") <= k).drop("_n")
    )


def over_layer_share(nodes: DataFrame, share: float, value: str = "r") -> DataFrame:
    """Nodes of at least ``share`` of the layer's largest value."""
    top = F.max(value).over(Window.partitionBy(*LAYER))
    return nodes.withColumn("_top", top).where(F.col(value) >= share * F.col("_top")).drop("_top")


def normalised(nodes: DataFrame, value: str = "r", power: float = 1.0) -> DataFrame:
    """The value over the image's largest, raised to a power."""
    top = F.max(value).over(Window.partitionBy("image_id"))
    return nodes.withColumn(value, F.pow(F.col(value) / top, F.lit(power)))


def value_quantile(nodes: DataFrame, q: float, value: str = "r", keys: tuple[str, ...] = LAYER) -> DataFrame:
    """Per key the value at index floor(q * n) in descending order (clamped)."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(value), F.asc("node_id")))
    ranked = nodes.withColumns({"_n": n, "_at": at})
    return ranked.where(F.col("_at") == F.least(F.floor(q * F.col("_n")) + 1, F.col("_n"))).select(*keys, F.col(value).alias("quantile"))


def texture(nodes: DataFrame, radius: int, types: int) -> DataFrame:
    """Nodes whose window holds at least ``types`` distinct types."""
    found = neighbour_counts(nodes, ["image_id"], radius, radius)
    return nodes.join(found.where(F.col("n_types") >= types).select("node_id", "n_types"), "node_id")


def without_texture(nodes: DataFrame, radius: int, types: int, slack: float = 0.1) -> DataFrame:
    """Drops nodes in a window of more than ``types`` types that are, less the
    slack, weaker than the window's mean."""
    found = neighbour_counts(nodes, ["image_id"], radius, radius)
    met = nodes.join(found, "node_id")
    return met.where(~((F.col("n_types") > types) & (F.col("r") - slack < F.col("mean_r")))).drop("n_near", "n_types", "mean_r")


def renumbered(nodes: DataFrame, types: list[int]) -> DataFrame:
    """Only the listed types, numbered by their place in the list."""
    place = F.array_position(F.array(*[F.lit(t) for t in types]), F.col("m"))
    return nodes.where(F.col("m").isin(types)).withColumn("m", (place - 1).cast("int"))


def type_statistics(nodes: DataFrame, keys: tuple[str, ...] = ("m",)) -> DataFrame:
    """Count, mean and both variances of r per key; partial results merge."""
    return nodes.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("r").alias("mean_r"), F.var_pop("r").alias("var_pop_r"), F.var_samp("r").alias("var_samp_r")
    )


def layer_summary(nodes: DataFrame) -> DataFrame:
    """Nodes, positions and bounding box per image and layer."""
    ranked = rank_in_cell(nodes, by_response())
    return ranked.groupBy(*LAYER).agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("rn") == 1).alias("n_positions"),
        F.min("x").alias("llx"), F.min("y").alias("lly"), F.max("x").alias("urx"), F.max("y").alias("ury"),
        F.round(F.avg("x")).cast("int").alias("cx"), F.round(F.avg("y")).cast("int").alias("cy"),
        F.countDistinct("m").alias("n_types"), F.max("m").alias("max_type"),
    )


def local_maxima(nodes: DataFrame) -> DataFrame:
    """The best node of a position that no better one lies beside (3x3)."""
    from partweave.operators.ranges import window_join

    best = best_at_position(nodes)
    key = lambda p: F.struct(F.col(p + "g"), F.col(p + "r"), -F.col(p + "node_id"))
    met = window_join(best, best.select("image_id", "x", "y", "g", "r", "node_id"), ["image_id"], 1, 1)
    beaten = met.where(key("o_") > key("")).select("node_id").distinct()
    return best.join(beaten, "node_id", "left_anti")
