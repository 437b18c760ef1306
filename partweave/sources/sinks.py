"""Text and table sinks of part-hierarchy data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def truth_lines(boxes: DataFrame, key: str = "image_id") -> DataFrame:
    """(key, text): ground-truth text per image, in the order of the boxes' ids."""
    line = F.concat_ws(" ", "llx", "lly", "urx", "ury", "label")
    rows = boxes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col("gt_id"), line.alias("line")))).alias("l"))
    return rows.select(key, F.array_join(F.transform("l", lambda s: s["line"]), "\n").alias("text"))


def node_lines(nodes: DataFrame, support: DataFrame, points: DataFrame) -> DataFrame:
    """(node, line): ``m,r,rr,g,x,y,...`` with the node's leaf positions in order."""
    at = support.join(points.select("leaf", "x", "y"), "leaf").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("x", "y"))).alias("at"))
    tail = F.array_join(F.transform("at", lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), ",")
    return nodes.join(at, "node").select("node", F.concat_ws(",", "m", F.round("r", 4), F.round("rr", 4), F.round("g", 4), tail).alias("line"))


def edge_triples(edges: DataFrame, layers: DataFrame) -> DataFrame:
    """Distinct (source layer, edge name, target layer); ``layers`` is (node, z)."""
    a = layers.select(F.col("node").alias("src"), F.col("z").alias("z_src"))
    b = layers.select(F.col("node").alias("dst"), F.col("z").alias("z_dst"))
    return edges.select("src", "dst", "name").join(a, "src").join(b, "dst").select("z_src", "name", "z_dst").distinct()


def pyramid_records(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One nested record per image: layers of nodes with their links."""
    links = edges.groupBy(F.col("src").alias("node_id")).agg(F.array_sort(F.collect_list("dst")).alias("link"))
    full = nodes.join(links, "node_id", "left").withColumn("link", F.coalesce("link", F.array().cast("array<bigint>")))
    node = F.struct("node_id", "x", "y", F.col("m").alias("id"), F.col("g").alias("weight"), "link")
    layers = full.groupBy("image_id", "z").agg(F.max("x").alias("width"), F.max("y").alias("height"), F.array_sort(F.collect_list(node)).alias("node"))
    layer = F.struct("z", "width", "height", "node")
    return layers.groupBy("image_id").agg(F.array_sort(F.collect_list(layer)).alias("layer"))


def write_pyramids(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    pyramid_records(nodes, edges).write.option("compression", "zstd").parquet(path)


def write_text(rows: DataFrame, column: str, path: str, partition: str | None = None) -> None:
    kept = rows.select(F.col(column).alias("value"), *([partition] if partition else []))
    writer = kept.write.partitionBy(partition) if partition else kept.write
    writer.text(path)


def to_json_lines(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))
