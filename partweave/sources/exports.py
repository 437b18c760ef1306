"""Text exports: one text per key, built in Spark and written by its writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _lines(rows: DataFrame, key: str, order: list[str], line: Column, separator: str = "\n") -> DataFrame:
    """(key, text): a key's lines in order. A key is an image or a layer."""
    kept = rows.select(key, F.struct(*order, line.alias("_line")).alias("s"))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["_line"]), separator).alias("text"))


def node_dump(nodes: DataFrame) -> DataFrame:
    """``z x y m r`` per node of an image."""
    return _lines(nodes, "image_id", ["z", "x", "y", "m"], F.concat_ws(" ", "z", "x", "y", "m", F.format_number("r", 4)))


def yaml_nodes(nodes: DataFrame) -> DataFrame:
    """A YAML list of an image's nodes."""
    line = F.concat(F.lit("- {x: "), "x", F.lit(", y: "), "y", F.lit(", type: "), "m", F.lit(", r: "), F.format_number("r", 4), F.lit("}"))
    return _lines(nodes, "image_id", ["z", "x", "y", "m"], line)


def edge_lists(edges: DataFrame, key: str) -> DataFrame:
    """``{{a,b},...}`` of a key's edges (key, a, b)."""
    got = _lines(edges, key, ["a", "b"], F.concat(F.lit("{"), "a", F.lit(","), "b", F.lit("}")), ",")
    return got.withColumn("text", F.concat(F.lit("{"), "text", F.lit("}")))


def networks(edges: DataFrame, key: str) -> DataFrame:
    """Vertex and edge sections of a key's graph, vertices numbered from 1 by id."""
    ends = edges.select(key, F.col("a").alias("v")).unionByName(edges.select(key, F.col("b").alias("v"))).distinct()
    names = ends.groupBy(key).agg(F.array_sort(F.collect_set("v")).alias("vs"))
    met = edges.join(names, key)
    place = lambda c: F.array_position("vs", F.col(c))
    arcs = _lines(met.select(key, place("a").alias("i"), place("b").alias("j")), key, ["i", "j"], F.concat_ws(" ", "i", "j"))
    head = F.array_join(F.transform("vs", lambda v, k: F.concat((k + 1).cast("string"), F.lit(' "'), v.cast("string"), F.lit('"'))), "\n")
    return names.join(arcs, key).select(
        key, F.concat(F.lit("*Vertices "), F.size("vs"), F.lit("\n"), head, F.lit("\n*Edges\n"), "text").alias("text")
    )


def area_lists(boxes: DataFrame, key: str) -> DataFrame:
    """``{{area,type},...}`` of a key's boxes, the largest first."""
    area = (F.col("urx") - F.col("llx")) * (F.col("ury") - F.col("lly"))
    rows = boxes.select(key, (-area).alias("k"), "m", area.alias("area"))
    got = _lines(rows, key, ["k", "m"], F.concat(F.lit("{"), "area", F.lit(","), "m", F.lit("}")), ",")
    return got.withColumn("text", F.concat(F.lit("{"), "text", F.lit("}")))


def confidence_vectors(judged: DataFrame, key: str) -> DataFrame:
    """(key, n_true, n_false, low_true, high_false): numbers and extremes of the
    values of hits and misses; ``judged`` is (key, val, hit)."""
    return judged.groupBy(key).agg(
        F.count_if("hit").alias("n_true"), F.count_if(~F.col("hit")).alias("n_false"),
        F.min(F.when(F.col("hit"), F.col("val"))).alias("low_true"), F.max(F.when(~F.col("hit"), F.col("val"))).alias("high_false"),
    )


def scaled_annotations(boxes: DataFrame, factor: float, scales: int, border: int) -> DataFrame:
    """``x y w h`` annotations (key columns, x, y, w, h) as boxes on each scale of a
    pyramid, moved by the border."""
    spread = boxes.withColumn("scale", F.explode(F.sequence(F.lit(0), F.lit(scales - 1)))).withColumn("f", F.pow(F.lit(factor), F.col("scale")))
    at = lambda e: (F.floor(e * F.col("f")) + border).cast("int")
    return spread.select(
        *[c for c in boxes.columns if c not in ("x", "y", "w", "h")], "scale",
        at(F.col("x")).alias("llx"), at(F.col("y")).alias("lly"), at(F.col("x") + F.col("w")).alias("urx"), at(F.col("y") + F.col("h")).alias("ury"),
    )


def type_table(nodes: DataFrame, types: list[int]) -> DataFrame:
    """Counts per image with a column per type."""
    return nodes.groupBy("image_id").agg(*[F.count_if(F.col("m") == t).alias(f"m{t}") for t in types])


def part_json(lib_center: DataFrame, lib_sub: DataFrame) -> DataFrame:
    """(part, json): a part with its subparts as JSON, an empty list if it has none."""
    subs = lib_sub.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("idx", "sub_m", "dx", "dy"))).alias("subparts"))
    full = lib_center.join(subs, "part", "left")
    held = F.coalesce("subparts", F.array().cast(subs.schema["subparts"].dataType)).alias("subparts")
    return full.select("part", F.to_json(F.struct("part", "center_m", "bp", held)).alias("json"))
