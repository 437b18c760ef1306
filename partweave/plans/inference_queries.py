"""Inference, node filters and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from partweave.operators import inference as inf
from partweave.operators import nodes as nd
from partweave.plans.registry import query, r6, rounded
from partweave.sources import projections as p
from partweave.sources.projections import with_views

ALL = ("nodes", "lib_center", "lib_sub", "kernel")

CAND = """WITH cand AS (SELECT image_id, z, node_id AS cand_id, part, bp, x + cmx AS cx, y + cmy AS cy, x, y, r AS r_c, g AS g_c
  FROM nodes JOIN lib_center ON m = center_m WHERE r >= 0.2 AND g >= 0.2)"""
FOUND = (
    CAND
    + """, found AS (SELECT c.image_id, c.cand_id, c.part, s.idx, n.node_id AS sub_id, n.r AS s_r, n.rr AS s_rr, n.r * k.w AS v
  FROM cand c JOIN lib_sub s ON c.part = s.part CROSS JOIN kernel k
  JOIN nodes n ON n.image_id = c.image_id AND n.x = c.x + s.dx + k.i AND n.y = c.y + s.dy + k.j AND n.m = s.sub_m
  WHERE n.r * k.w > 0.1)"""
)
BEST = (
    FOUND
    + """, best AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY cand_id, part, idx ORDER BY v DESC, sub_id) AS rn FROM found) WHERE rn = 1)"""
)
RESP = (
    BEST
    + """, resp AS (SELECT c.image_id, c.z + 1 AS z, c.cx AS x, c.cy AS y, c.part AS m, (b.sum_r + c.r_c) / (b.n_sub + 1) AS r,
    b.pv * ((1.0 + b.sum_rr) / c.bp) AS g, (1.0 + b.sum_rr) / c.bp AS rr, b.n_sub, c.cand_id AS node_id
  FROM cand c JOIN (SELECT cand_id, part, sum(s_r) AS sum_r, count(*) AS n_sub, sum(s_rr) AS sum_rr, product(v) AS pv FROM best GROUP BY 1, 2) b
    ON c.cand_id = b.cand_id AND c.part = b.part)"""
)
LAYER = (
    RESP
    + """, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, z, x, y, m ORDER BY g DESC, node_id) AS n1 FROM resp WHERE r >= 0.2) WHERE n1 = 1),
  top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, z, x, y ORDER BY g DESC, m) AS n2 FROM one) WHERE n2 <= 2)"""
)


def _model(spark):
    return p.lib_center(spark), p.lib_sub(spark), p.kernel(spark)


def _found(spark, d):
    nodes = p.nodes(spark, d)
    center, sub, kernel = _model(spark)
    cand = inf.candidates(nodes, center, 0.2, 0.2)
    return nodes, cand, inf.matches(cand, nodes, sub, kernel, 0.1)


def layer_two(spark, d):
    nodes = p.nodes(spark, d)
    return inf.infer_layer(nodes, *_model(spark))


@query(with_views(LAYER + " SELECT image_id, z, x, y, m, round(r, 6) AS r, round(g, 6) AS g, round(rr, 6) AS rr, n_sub, node_id FROM top", *ALL))
def infer_layer(spark, d):
    return rounded(layer_two(spark, d), "r", "g", "rr")


@query(with_views(CAND + " SELECT image_id, z, cand_id, part, bp, cx, cy, x, y, r_c, g_c FROM cand", "nodes", "lib_center"))
def candidates(spark, d):
    return inf.candidates(p.nodes(spark, d), p.lib_center(spark), 0.2, 0.2)


@query(with_views(FOUND + " SELECT image_id, cand_id, part, idx, sub_id, s_r, s_rr, round(v, 6) AS v FROM found", *ALL))
def subpart_matches(spark, d):
    return rounded(_found(spark, d)[2], "v")


@query(with_views(BEST + " SELECT image_id, cand_id, part, idx, sub_id, s_r, s_rr, round(v, 6) AS v FROM best", *ALL))
def best_subparts(spark, d):
    return rounded(inf.best_matches(_found(spark, d)[2]), "v")


@query(
    with_views(
        FOUND
        + """ SELECT image_id, cand_id, part, idx, sub_id, s_r, s_rr, round(v, 6) AS v FROM (
        SELECT *, max(v) OVER (PARTITION BY cand_id, part, idx) AS top FROM found) WHERE v >= 0.8 * top""",
        *ALL,
    )
)
def strong_links(spark, d):
    return rounded(inf.strong_links(_found(spark, d)[2], 0.8), "v")


@query(with_views(RESP + " SELECT image_id, z, x, y, m, round(r, 6) AS r, round(g, 6) AS g, round(rr, 6) AS rr, n_sub, node_id FROM resp", *ALL))
def part_responses(spark, d):
    _, cand, found = _found(spark, d)
    return rounded(inf.responses(cand, inf.best_matches(found)), "r", "g", "rr")


@query(with_views("SELECT image_id, z + 1 AS z, x, y, m % 3 AS m, r, g, rr, node_id FROM nodes WHERE m < 6", "nodes"))
def category_layer(spark, d):
    categories = spark.range(6).select(F.col("id").cast("int").alias("m"), (F.col("id") % 3).cast("int").alias("category"))
    return inf.category_layer(p.nodes(spark, d), categories)


@query(
    with_views(
        CAND
        + """ SELECT cand_id, part FROM cand c WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.image_id = c.image_id
        AND n.x = c.x + c.part AND n.y = c.y - 1 AND n.m = (c.part + 2) % 7)""",
        "nodes",
        "lib_center",
    )
)
def without_forbidden(spark, d):
    nodes = p.nodes(spark, d)
    rule = spark.range(6).select(
        F.col("id").cast("int").alias("part"), ((F.col("id") + 2) % 7).cast("int").alias("f_m"), F.col("id").cast("int").alias("fx"), F.lit(-1).alias("fy")
    )
    cand = inf.candidates(nodes, p.lib_center(spark), 0.2, 0.2)
    return inf.not_forbidden(cand, nodes, rule).select("cand_id", "part")


NODE = "image_id, z, x, y, m, r, g, rr, node_id"


@query(with_views(f"SELECT {NODE} FROM nodes WHERE r >= 0.5 AND g >= 0.93 AND rr <= 0.98", "nodes"))
def response_filter(spark, d):
    return nd.response_filter(p.nodes(spark, d), {"r": 0.5, "g": 0.93}, {"rr": 0.98})


@query(with_views(f"SELECT {NODE} FROM nodes WHERE r >= CASE m WHEN 1 THEN 0.7 WHEN 3 THEN 0.3 ELSE 0.5 END", "nodes"))
def part_thresholds(spark, d):
    parts = spark.createDataFrame([(1, "r", 0.7), (3, "r", 0.3)], "m int, resp string, value double")
    return nd.response_filter(p.nodes(spark, d), {"r": 0.5}, parts=parts)


@query(with_views(f"SELECT {NODE} FROM nodes WHERE z BETWEEN 0 AND 2 AND m IN (1, 4)", "nodes"))
def nodes_of_types(spark, d):
    return nd.of_types(p.nodes(spark, d), [1, 4], 0, 2)


@query(
    with_views(
        f"SELECT {NODE} FROM (SELECT *, row_number() OVER (PARTITION BY image_id, z, x, y ORDER BY g DESC, r DESC, m, node_id) AS rn FROM nodes) WHERE rn = 1", "nodes"
    )
)
def best_at_position(spark, d):
    return nd.best_at_position(p.nodes(spark, d))


@query(with_views(f"SELECT {NODE} FROM (SELECT *, max(g) OVER (PARTITION BY image_id, z, x, y) AS b FROM nodes) WHERE g >= 0.97 * b", "nodes"))
def near_best(spark, d):
    return nd.near_best(p.nodes(spark, d), 0.97)


@query(with_views(f"SELECT {NODE} FROM (SELECT *, max(r) OVER (PARTITION BY image_id, z) AS b FROM nodes) WHERE r >= 0.8 * b", "nodes"))
def over_layer_share(spark, d):
    return nd.over_layer_share(p.nodes(spark, d), 0.8)


@query(with_views("SELECT image_id, node_id, round(pow(r / max(r) OVER (PARTITION BY image_id), 0.5), 6) AS r FROM nodes", "nodes"))
def normalised_responses(spark, d):
    return nd.normalised(p.nodes(spark, d), power=0.5).select("image_id", "node_id", r6("r").alias("r"))


@query(
    with_views(
        """SELECT image_id, z, r AS quantile FROM (SELECT *, row_number() OVER (PARTITION BY image_id, z ORDER BY r DESC, node_id) AS rn,
        count(*) OVER (PARTITION BY image_id, z) AS n FROM nodes) WHERE rn = least(CAST(floor(0.1 * n) AS BIGINT) + 1, n)""",
        "nodes",
    )
)
def response_quantile(spark, d):
    return nd.value_quantile(p.nodes(spark, d), 0.1)


@query(
    with_views(
        "SELECT m, count(*) AS n, round(avg(r), 6) AS mean_r, round(var_pop(r), 6) AS var_pop_r, round(var_samp(r), 6) AS var_samp_r FROM nodes GROUP BY m", "nodes"
    )
)
def type_statistics(spark, d):
    return rounded(nd.type_statistics(p.nodes(spark, d)), "mean_r", "var_pop_r", "var_samp_r")


@query(
    with_views(
        """SELECT image_id, z, count(*) AS n_nodes, count(DISTINCT x * 1000 + y) AS n_positions, min(x) AS llx, min(y) AS lly, max(x) AS urx, max(y) AS ury,
        CAST(round(avg(x)) AS INT) AS cx, CAST(round(avg(y)) AS INT) AS cy, count(DISTINCT m) AS n_types, max(m) AS max_type FROM nodes GROUP BY image_id, z""",
        "nodes",
    )
)
def layer_summary(spark, d):
    return nd.layer_summary(p.nodes(spark, d))


@query(with_views("SELECT image_id, z, x, y, CASE m WHEN 5 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS m, r, g, rr, node_id FROM nodes WHERE m IN (5, 2, 0)", "nodes"))
def renumbered_types(spark, d):
    return nd.renumbered(p.nodes(spark, d), [5, 2, 0])


NEAR = """WITH near AS (SELECT a.node_id, count(*) AS n_near, count(DISTINCT b.m) AS n_types, avg(b.r) AS mean_r FROM nodes a JOIN nodes b
  ON a.image_id = b.image_id AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 GROUP BY a.node_id)"""


@query(with_views(NEAR + " SELECT node_id, n_near, n_types, round(mean_r, 6) AS mean_r FROM near", "nodes"))
def neighbour_counts(spark, d):
    from partweave.operators.ranges import neighbour_counts as counts

    return rounded(counts(p.nodes(spark, d), ["image_id"], 3, 3), "mean_r")


@query(with_views(NEAR + " SELECT node_id, n_types FROM near WHERE n_types >= 4", "nodes"))
def texture_nodes(spark, d):
    return nd.texture(p.nodes(spark, d), 3, 4).select("node_id", "n_types")


@query(
    with_views(
        NEAR + " SELECT n.node_id FROM nodes n JOIN near USING (node_id) WHERE NOT (n_types > 3 AND round(r - 0.1, 9) < round(mean_r, 9))", "nodes"
    )
)
def without_texture(spark, d):
    # Rounded: a mean's last bit depends on the order of its terms.
    from partweave.operators.ranges import neighbour_counts as counts

    nodes = p.nodes(spark, d)
    met = nodes.join(counts(nodes, ["image_id"], 3, 3), "node_id")
    return met.where(~((F.col("n_types") > 3) & (F.round(F.col("r") - 0.1, 9) < F.round("mean_r", 9)))).select("node_id")


@query(
    with_views(
        """WITH best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, x, y ORDER BY g DESC, r DESC, m, node_id) AS rn FROM nodes) WHERE rn = 1)
        SELECT a.node_id FROM best a WHERE NOT EXISTS (SELECT 1 FROM best b WHERE a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1
          AND (b.g > a.g OR (b.g = a.g AND (b.r > a.r OR (b.r = a.r AND b.node_id < a.node_id)))))""",
        "nodes",
    )
)
def local_maxima(spark, d):
    return nd.local_maxima(p.nodes(spark, d)).select("node_id")


@query(
    with_views(
        """SELECT image_id, z, x, y, m, r, g, rr, node_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, z, x, y ORDER BY g DESC, m) AS n2 FROM nodes) WHERE n2 <= 1""",
        "nodes",
    )
)
def dedup_positions(spark, d):
    return nd.dedup_top_k(p.nodes(spark, d), 1)
