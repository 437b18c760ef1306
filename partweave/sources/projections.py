"""Part-hierarchy tables projected from the star-schema tables.

Each projection is written twice from one definition: a DataFrame here and the
same relation as SQL text in ``SQL``, which the oracle queries use as common
table expressions. An image gathers the lines of 64 consecutive orders, so the
number of images grows with the data and the size of an image does not.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.operators.keyed import by_keys, owners

IMAGE_ORDERS = 64

#: A place and those around it.
AROUND = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1)]

# A six-part library, its subparts, and a 5x5 kernel of sigma 2.
LIB_CENTER_ROWS = [(0, 0, 1, 0, 3), (1, 1, 0, 1, 3), (2, 2, 1, 1, 2), (3, 3, 0, 0, 2), (4, 0, -1, 0, 2), (5, 4, 0, -1, 3)]
LIB_SUB_ROWS = [
    (0, 1, 1, 4, 0), (0, 2, 2, -4, 0), (1, 1, 0, 0, 4), (1, 2, 3, 0, -4), (2, 1, 4, 3, 3),
    (3, 1, 2, -3, 3), (4, 1, 5, 0, 5), (5, 1, 0, 5, 0), (5, 2, 1, -5, 0),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One node per image, position and type, with the best of its responses. They are dealt
    by image before they meet, so that what joins, groups or ranks within images afterwards
    finds its rows together and moves nothing again. For joins Spark only sees that if a
    part of their keys may deal the rows, which is a setting of the session."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return (
        _table(spark, sf_dir, "lineitem")
        .select(
            F.expr(f"l_orderkey DIV {IMAGE_ORDERS}").alias("image_id"),
            F.expr("CAST(l_partkey % 64 AS INT)").alias("x"),
            F.expr("CAST((l_orderkey * 7 + l_linenumber * 13) % 64 AS INT)").alias("y"),
            F.expr("CAST(l_linenumber - 1 AS INT)").alias("m"),
            (F.col("l_quantity") / 50.0).alias("r"),
            (1.0 - F.col("l_discount")).alias("g"),
            (1.0 - F.col("l_tax")).alias("rr"),
        )
        .repartition("image_id")
        .groupBy("image_id", "x", "y", "m")
        .agg(F.max("r").alias("r"), F.max("g").alias("g"), F.max("rr").alias("rr"))
        .withColumns({"node_id": F.expr("((image_id * 64 + x) * 64 + y) * 8 + m"), "z": F.lit(0)})
    )


def ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(
        F.expr(f"o_orderkey DIV {IMAGE_ORDERS}").alias("image_id"),
        F.expr("CAST(o_custkey % 48 AS INT)").alias("llx"),
        F.expr("CAST((o_orderkey * 3) % 48 AS INT)").alias("lly"),
        F.expr("CAST(o_custkey % 48 + 8 + o_orderkey % 9 AS INT)").alias("urx"),
        F.expr("CAST((o_orderkey * 3) % 48 + 8 + o_custkey % 9 AS INT)").alias("ury"),
        F.col("o_orderpriority").alias("label"),
        F.expr("CAST(o_orderkey % 7 AS INT)").alias("m"),
        F.col("o_orderkey").alias("gt_id"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detection per image, place and type, with its best value."""
    return (
        _table(spark, sf_dir, "lineitem")
        .groupBy(
            F.expr(f"l_orderkey DIV {IMAGE_ORDERS}").alias("image_id"),
            F.expr("CAST(l_partkey % 48 AS INT)").alias("llx"),
            F.expr("CAST((l_orderkey * 3) % 48 AS INT)").alias("lly"),
            F.expr("CAST(l_linenumber - 1 AS INT)").alias("m"),
        )
        .agg((F.max("l_quantity") / 50.0).alias("val"))
        .withColumns(
            {"urx": F.col("llx") + 10, "ury": F.col("lly") + 10, "box_id": F.expr("((image_id * 64 + llx) * 64 + lly) * 8 + m")}
        )
    )


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layered graph region (4), nation (3), customer (2), orders (1), lineitem
    (0); an id's low digit is its layer."""
    named = [
        ("nation", "n_regionkey", "n_nationkey", 4),
        ("customer", "c_nationkey", "c_custkey", 3),
        ("orders", "o_custkey", "o_orderkey", 2),
    ]
    parts = [
        _table(spark, sf_dir, t).select(
            (F.col(p).cast("long") * 10 + z).alias("src"), (F.col(c).cast("long") * 10 + z - 1).alias("dst"), F.lit("toPrev").alias("name"), F.lit(z).alias("z")
        )
        for t, p, c, z in named
    ]
    lines = _table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 10 + 1).alias("src"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10).alias("dst"),
        F.lit("toPrev").alias("name"),
        F.lit(1).alias("z"),
    )
    out = lines
    for p in parts:
        out = out.unionByName(p)
    return out.distinct()


def leaf_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position and type of the leaves of ``edges``, one a leaf."""
    return (
        _table(spark, sf_dir, "lineitem")
        .groupBy(((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10).alias("leaf"))
        .agg(
            F.expr("CAST(min(l_partkey % 64) AS INT)").alias("x"),
            F.expr("CAST(min((l_orderkey * 7 + l_linenumber * 13) % 64) AS INT)").alias("y"),
            F.expr("CAST(min(l_linenumber - 1) AS INT)").alias("m"),
        )
    )


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Absolute components scaled to sum 1."""
    h = F.transform("embedding", lambda v: F.abs(v.cast("double")))
    total = F.aggregate(h, F.lit(0.0), lambda a, v: a + v)
    return _table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform(h, lambda v: v / total).alias("h"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(
        "user_id",
        "event_id",
        "ts",
        F.expr("CAST(value AS DOUBLE)").alias("value"),
        F.col("event_type").alias("m"),
        F.expr("CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT)").alias("frame"),
    )


def _local(spark: SparkSession, rows: list[tuple], *columns: str) -> DataFrame:
    """A fixed table as VALUES: Spark knows its size, so no image row moves to meet it."""
    return spark.sql(f"SELECT * FROM VALUES {_values(rows)} AS t({', '.join(columns)})")


def lib_center(spark: SparkSession) -> DataFrame:
    return _local(spark, LIB_CENTER_ROWS, "part", "center_m", "cmx", "cmy", "bp")


def lib_sub(spark: SparkSession) -> DataFrame:
    return _local(spark, LIB_SUB_ROWS, "part", "idx", "sub_m", "dx", "dy")


def part_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A library that grows with the tables: a part for each row of ``part``."""
    return _table(spark, sf_dir, "part").selectExpr(
        "CAST(p_partkey AS INT) AS part", "CAST(p_size % 6 AS INT) AS center_m", "CAST(p_size % 3 - 1 AS INT) AS cmx", "CAST(p_partkey % 3 - 1 AS INT) AS cmy", "CAST(2 + p_size % 2 AS INT) AS bp"
    )


def part_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Its subparts, one to three a part, from the part's first lines."""
    lines = _table(spark, sf_dir, "lineitem").where("l_linenumber <= 1 + l_partkey % 3")
    return lines.groupBy(F.col("l_partkey").cast("int").alias("part"), F.col("l_linenumber").cast("int").alias("idx")).agg(
        F.expr("CAST(min(l_suppkey + l_orderkey) % 6 AS INT)").alias("sub_m"), F.expr("CAST(min(l_orderkey) % 11 - 5 AS INT)").alias("dx"), F.expr("CAST(max(l_orderkey) % 11 - 5 AS INT)").alias("dy")
    )


def type_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(m, x, y, v): how often a node of the lowest layer has another one at each place
    around it, by its type: the masks of the six types that the library is made of."""
    places = nodes(spark, sf_dir).select("image_id", "m", "x", "y")

    def run(ends: np.ndarray, m: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple:
        """Hits of many images in one row a type and place, under the first image."""
        x, y = x.astype(np.int64), y.astype(np.int64)
        wide, high = int(np.ptp(x)) + 3, int(np.ptp(y)) + 3  # a border of one
        at = (owners(ends) * wide + x - x.min() + 1) * high + y - y.min() + 1
        taken, own = np.unique(at), m < 6
        names, kind = np.unique(m[own], return_inverse=True)
        out = []
        for i, j in AROUND:
            aim = at[own] + i * high + j
            hit = taken[np.minimum(np.searchsorted(taken, aim), len(taken) - 1)] == aim
            hits = np.bincount(kind[hit], minlength=len(names))
            out.append((names, np.full(len(names), i, dtype=np.int32), np.full(len(names), j, dtype=np.int32), hits))
        m, i, j, hits = (np.concatenate(c) for c in zip(*out, strict=True))
        return np.zeros(len(m), dtype=np.int64), m, i, j, hits

    # A node without a place counts, and meets none.
    hits = by_keys(places.dropna(), ["image_id"], ["m", "x", "y"], [], "m int, x int, y int, hits long", run).groupBy("m", "x", "y").agg(F.sum("hits").alias("hits"))
    around = F.array(*[F.struct(F.lit(i).alias("x"), F.lit(j).alias("y")) for i, j in AROUND])
    all_ = places.where("m < 6").groupBy("m").agg(F.count(F.lit(1)).alias("n")).select("m", "n", F.inline(around))
    return all_.join(hits, ["m", "x", "y"], "left").select("m", "x", "y", (F.coalesce("hits", F.lit(0)) / F.col("n")).alias("v"))


def kernel(spark: SparkSession) -> DataFrame:
    side = F.sequence(F.lit(-2), F.lit(2))
    return (
        spark.range(1)
        .select(F.explode(side).alias("i"))
        .select("i", F.explode(side).alias("j"))
        .select("i", "j", F.exp(-(F.col("i") * F.col("i") + F.col("j") * F.col("j")) / 8.0).alias("w"))
    )


def _values(rows: list[tuple]) -> str:
    return ", ".join(str(r) for r in rows)


#: The same relations for an SQL engine.
SQL = {
    "nodes": f"""SELECT image_id, 0 AS z, x, y, m, max(r) AS r, max(g) AS g, max(rr) AS rr, ((image_id * 64 + x) * 64 + y) * 8 + m AS node_id FROM (
        SELECT l_orderkey // {IMAGE_ORDERS} AS image_id, CAST(l_partkey % 64 AS INT) AS x,
               CAST((l_orderkey * 7 + l_linenumber * 13) % 64 AS INT) AS y, CAST(l_linenumber - 1 AS INT) AS m,
               l_quantity / 50.0 AS r, 1.0 - l_discount AS g, 1.0 - l_tax AS rr
        FROM lineitem) GROUP BY image_id, x, y, m""",
    "gt": f"""SELECT o_orderkey // {IMAGE_ORDERS} AS image_id, CAST(o_custkey % 48 AS INT) AS llx, CAST((o_orderkey * 3) % 48 AS INT) AS lly,
        CAST(o_custkey % 48 + 8 + o_orderkey % 9 AS INT) AS urx, CAST((o_orderkey * 3) % 48 + 8 + o_custkey % 9 AS INT) AS ury,
        o_orderpriority AS label, CAST(o_orderkey % 7 AS INT) AS m, o_orderkey AS gt_id FROM orders""",
    "boxes": f"""SELECT *, llx + 10 AS urx, lly + 10 AS ury, ((image_id * 64 + llx) * 64 + lly) * 8 + m AS box_id FROM (
        SELECT l_orderkey // {IMAGE_ORDERS} AS image_id, CAST(l_partkey % 48 AS INT) AS llx, CAST((l_orderkey * 3) % 48 AS INT) AS lly,
               CAST(l_linenumber - 1 AS INT) AS m, max(l_quantity) / 50.0 AS val FROM lineitem GROUP BY 1, 2, 3, 4)""",
    "edges": """SELECT CAST(n_regionkey AS BIGINT) * 10 + 4 AS src, CAST(n_nationkey AS BIGINT) * 10 + 3 AS dst, 'toPrev' AS name, 4 AS z FROM nation
        UNION SELECT CAST(c_nationkey AS BIGINT) * 10 + 3, c_custkey * 10 + 2, 'toPrev', 3 FROM customer
        UNION SELECT o_custkey * 10 + 2, o_orderkey * 10 + 1, 'toPrev', 2 FROM orders
        UNION SELECT l_orderkey * 10 + 1, (l_orderkey * 10 + l_linenumber) * 10, 'toPrev', 1 FROM lineitem""",
    "leaf_points": """SELECT (l_orderkey * 10 + l_linenumber) * 10 AS leaf, CAST(min(l_partkey % 64) AS INT) AS x,
        CAST(min((l_orderkey * 7 + l_linenumber * 13) % 64) AS INT) AS y, CAST(min(l_linenumber - 1) AS INT) AS m FROM lineitem GROUP BY 1""",
    "hist": """SELECT vec_id, label, list_transform(a, lambda v: v / list_sum(a)) AS h FROM (
        SELECT vec_id, label, list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE))) AS a FROM embeddings)""",
    "frames": """SELECT user_id, event_id, ts, CAST(value AS DOUBLE) AS value, event_type AS m,
        CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT) AS frame FROM events""",
    "lib_center": f"SELECT * FROM (VALUES {_values(LIB_CENTER_ROWS)}) AS t(part, center_m, cmx, cmy, bp)",
    "lib_sub": f"SELECT * FROM (VALUES {_values(LIB_SUB_ROWS)}) AS t(part, idx, sub_m, dx, dy)",
    "kernel": "SELECT i, j, exp(-(i * i + j * j) / 8.0) AS w FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j)",
}


#: The library that grows with the tables, under the names of the fixed one.
LIBRARY = {
    "lib_center": """SELECT CAST(p_partkey AS INT) AS part, CAST(p_size % 6 AS INT) AS center_m, CAST(p_size % 3 - 1 AS INT) AS cmx, CAST(p_partkey % 3 - 1 AS INT) AS cmy,
        CAST(2 + p_size % 2 AS INT) AS bp FROM part""",
    "lib_sub": """SELECT CAST(l_partkey AS INT) AS part, CAST(l_linenumber AS INT) AS idx, CAST(min(l_suppkey + l_orderkey) % 6 AS INT) AS sub_m, CAST(min(l_orderkey) % 11 - 5 AS INT) AS dx,
        CAST(max(l_orderkey) % 11 - 5 AS INT) AS dy FROM lineitem WHERE l_linenumber <= 1 + l_partkey % 3 GROUP BY 1, 2""",
    "masks": f"""SELECT a.m, i AS x, j AS y, count(t.x) * 1.0 / count(*) AS v FROM (SELECT image_id, m, x, y, i, j FROM ({SQL["nodes"]}), range(-1, 2) AS r(i), range(-1, 2) AS s(j) WHERE m < 6) a
        LEFT JOIN (SELECT DISTINCT image_id, x, y FROM ({SQL["nodes"]})) t ON a.image_id = t.image_id AND t.x = a.x + i AND t.y = a.y + j GROUP BY a.m, i, j""",
}


def with_library(sql: str) -> str:
    """``sql`` with the library that grows with the tables, and the masks of its types."""
    views = ", ".join(f"{n} AS ({q})" for n, q in LIBRARY.items())
    body = sql.strip()
    return f"WITH {views}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {views} {body}"


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """``sql`` with the named relations as common table expressions."""
    views = ", ".join(f"{n} AS ({SQL[n]})" for n in names)
    lead = "WITH RECURSIVE" if recursive else "WITH"
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"{lead} {views}, {body[5:]}"
    return f"{lead} {views} {body}"
