"""Connected components of an edge table by alternating star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import stored


ROWS_PER_FILE = 50_000


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node.

    A round joins each node's neighbours to the smallest one it knows, first the
    larger neighbours, then the smaller. Both steps are a map-side combined
    minimum and a join back on the node, so a node with very many edges is never
    one task's list. Each round is stored in the shared folder.
    """

    def step(pairs: DataFrame, larger: bool) -> DataFrame:
        if larger:
            pairs = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = pairs.groupBy(F.col("a").alias("u")).agg(F.least(F.min("b"), F.first("a")).alias("m"))
        met = pairs.join(low, F.col("a") == F.col("u"))
        if larger:
            out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            out = met.select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        return out.where("a != b").distinct()

    def mark(pairs: DataFrame):
        return pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    now = stored(edges.where("a != b").select("a", "b").distinct(), "edges")
    seen = mark(now)
    for _ in range(max_rounds):
        now = stored(step(step(now, True), False), "edges", files=1 + seen[0] // ROWS_PER_FILE)
        found = mark(now)
        if found == seen:
            break
        seen = found
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
