"""Cells and their nodes: chains, crops, maps, overlaps, discs, pyramids."""

from __future__ import annotations

from pyspark.sql import functions as F

from partweave.operators import cells as ce
from partweave.operators import images as im
from partweave.operators.ordering import running_sum
from partweave.operators.ranges import window_join
from partweave.plans.registry import query, r6, rounded
from partweave.sources import projections as p
from partweave.sources.projections import with_views

CELLS = "SELECT image_id, x, y, max(r) AS v FROM nodes GROUP BY image_id, x, y"


def _cells(spark, d, where="true"):
    return p.nodes(spark, d).where(where).groupBy("image_id", "x", "y").agg(F.max("r").alias("v"))


@query(with_views("SELECT image_id, x, y, string_agg(m, ',' ORDER BY g DESC, m) AS chain FROM nodes GROUP BY image_id, x, y", "nodes"))
def cell_chains(spark, d):
    return ce.chains(p.nodes(spark, d)).withColumn("chain", F.array_join(F.col("chain").cast("array<string>"), ","))


@query(with_views("SELECT m + 100 AS m, count(*) AS n FROM nodes GROUP BY m", "nodes"))
def shifted_types(spark, d):
    return ce.shifted_types(p.nodes(spark, d), 100).groupBy("m").agg(F.count(F.lit(1)).alias("n"))


INSIDE = "n.image_id = g.image_id AND n.x >= g.llx AND n.x < g.urx AND n.y >= g.lly AND n.y < g.ury"


@query(with_views(f"SELECT gt_id, node_id, n.x - llx AS x, n.y - lly AS y FROM nodes n JOIN gt g ON {INSIDE}", "nodes", "gt"))
def cropped_nodes(spark, d):
    return ce.cropped(p.nodes(spark, d).select("image_id", "node_id", "x", "y"), p.ground_truth(spark, d)).select("gt_id", "node_id", "x", "y")


@query(with_views(f"SELECT gt_id, count(node_id) AS n FROM gt g LEFT JOIN nodes n ON {INSIDE} AND n.m = g.m GROUP BY gt_id HAVING count(node_id) = 0", "nodes", "gt"))
def empty_rectangles(spark, d):
    truth = p.ground_truth(spark, d)
    hit = ce.cropped(p.nodes(spark, d).select("image_id", "node_id", "m", "x", "y"), truth.withColumn("gt", F.struct("gt_id", "m")).drop("m"), "gt").where("m = gt.m").select("gt.gt_id").distinct()
    return truth.join(hit, "gt_id", "left_anti").select("gt_id", F.lit(0).cast("long").alias("n"))


@query(with_views(f"SELECT gt_id, round(sum(r * (n.m + 1) / 7.0), 6) AS weight, count(*) AS n FROM nodes n JOIN gt g ON {INSIDE} GROUP BY gt_id", "nodes", "gt"))
def weighted_rectangles(spark, d):
    met = ce.cropped(p.nodes(spark, d).select("image_id", "node_id", "m", "r", "x", "y"), p.ground_truth(spark, d))
    return met.groupBy("gt_id").agg(r6(F.sum(F.col("r") * (F.col("m") + 1) / 7.0)).alias("weight"), F.count(F.lit(1)).alias("n"))


SIDE = "greatest(urx - llx, ury - lly)"


@query(
    with_views(
        f"""SELECT image_id, arg_min(gt_id, ({SIDE}, gt_id)) AS small_id, min({SIDE}) AS small_side, arg_min(gt_id, (-{SIDE}, gt_id)) AS large_id, max({SIDE}) AS large_side FROM gt GROUP BY image_id""", "gt"
    )
)
def extreme_boxes(spark, d):
    truth = p.ground_truth(spark, d)
    small, large = ce.extreme_boxes(truth, False), ce.extreme_boxes(truth, True)
    return small.select("image_id", F.col("gt_id").alias("small_id"), F.col("side").alias("small_side")).join(
        large.select("image_id", F.col("gt_id").alias("large_id"), F.col("side").alias("large_side")), "image_id"
    )


@query(with_views("SELECT image_id, m, count(*) AS n, max(r) AS best, arg_min(node_id, (-r, node_id)) AS node_id FROM nodes WHERE g >= 0.95 AND rr >= 0.96 GROUP BY image_id, m", "nodes"))
def nodes_by_type(spark, d):
    strong = p.nodes(spark, d).where("g >= 0.95 AND rr >= 0.96")
    return strong.groupBy("image_id", "m").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("best"), F.min_by("node_id", F.struct((-F.col("r")).alias("k"), "node_id")).alias("node_id"))


@query(with_views("SELECT image_id, m, count(*) AS n FROM nodes WHERE NOT (m IN (1, 3) AND g < 0.95) GROUP BY image_id, m", "nodes"))
def without_weak_nodes(spark, d):
    return ce.without_weak(p.nodes(spark, d), [1, 3], 0.95).groupBy("image_id", "m").agg(F.count(F.lit(1)).alias("n"))


@query(
    with_views(
        "SELECT a.node_id, count(*) AS n_near, max(b.r) AS best FROM nodes a JOIN nodes b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 2 AND b.m = 2 AND b.r >= 0.5 GROUP BY a.node_id", "nodes"
    )
)
def typed_neighbours(spark, d):
    nodes = p.nodes(spark, d)
    asked = nodes.where("m = 2 AND r >= 0.5").select("image_id", "x", "y", "r")
    met = window_join(nodes.select("image_id", "x", "y", "node_id"), asked, ["image_id"], 4, 2)
    return met.groupBy("node_id").agg(F.count(F.lit(1)).alias("n_near"), F.max("o_r").alias("best"))


@query(
    with_views(
        f"""WITH c AS ({CELLS}) SELECT a.image_id, a.x, a.y, max(b.v) AS best FROM c a JOIN c b ON a.image_id = b.image_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) < 20 GROUP BY 1, 2, 3""", "nodes"
    )
)
def disc_heads(spark, d):
    cells = _cells(spark, d)
    d2 = (F.col("x") - F.col("o_x")) * (F.col("x") - F.col("o_x")) + (F.col("y") - F.col("o_y")) * (F.col("y") - F.col("o_y"))
    met = window_join(cells.select("image_id", "x", "y"), cells, ["image_id"], 4, 4).where(d2 < 5 * 4)
    return met.groupBy("image_id", "x", "y").agg(F.max("o_v").alias("best"))


@query(
    with_views(
        "SELECT image_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, floor(x / 5.0), floor(y / 5.0) ORDER BY node_id) AS rn FROM nodes) WHERE rn = 1", "nodes"
    )
)
def first_in_squares(spark, d):
    return ce.peaks_per_square(p.nodes(spark, d), 2, "node_id").select("image_id", "node_id")


@query(with_views("SELECT image_id, x, y, max(r) AS v, arg_min(m, (-r, m)) AS m, max(max(r)) OVER (PARTITION BY image_id) AS top FROM nodes GROUP BY image_id, x, y HAVING max(r) > 1e-10", "nodes"))
def response_maps(spark, d):
    return ce.response_maps(p.nodes(spark, d))


@query(
    with_views(
        f"""SELECT image_id, count(*) AS n, CAST(count_if(v >= 0.5) AS BIGINT) AS n_strong, min(v) AS low, max(v) AS high, arg_min(y * 64 + x, (-v, y * 64 + x)) AS at FROM ({CELLS}) GROUP BY image_id""", "nodes"
    )
)
def matrix_extrema(spark, d):
    at = F.col("y") * 64 + F.col("x")
    return _cells(spark, d).groupBy("image_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") >= 0.5).alias("n_strong"), F.min("v").alias("low"), F.max("v").alias("high"), F.min_by(at, F.struct((-F.col("v")).alias("k"), at.alias("a"))).alias("at")
    )


@query("SELECT round(min(l_extendedprice) - 1e-6, 6) AS threshold FROM (SELECT l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC LIMIT 500)")
def value_thresholds(spark, d):
    """The value that the 500 largest reach, less a millionth."""
    top = spark.read.parquet(f"{d}/lineitem.parquet").select("l_extendedprice").orderBy(F.desc("l_extendedprice")).limit(500)
    return top.agg(r6(F.min("l_extendedprice") - 1e-6).alias("threshold"))


@query(with_views("SELECT image_id, node_id, row_number() OVER (PARTITION BY image_id ORDER BY md5(node_id || '/7')) AS place FROM nodes", "nodes"))
def random_orders(spark, d):
    return ce.shuffled(p.nodes(spark, d), ["image_id"], "node_id", 7).select("image_id", "node_id", F.col("place").cast("long").alias("place"))


@query(with_views("SELECT image_id, node_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY md5(node_id || '/11')) AS place FROM nodes) WHERE place <= 10", "nodes"))
def random_subsets(spark, d):
    """Ten random nodes of each image."""
    return ce.shuffled(p.nodes(spark, d), ["image_id"], "node_id", 11).where("place <= 10").select("image_id", "node_id")


def _typed_cells(t):
    return f"SELECT image_id, x, y, max(r) AS v FROM nodes WHERE m {t} GROUP BY image_id, x, y"


@query(
    with_views(
        f"""WITH a AS ({_typed_cells('<= 3')}), b AS ({_typed_cells('>= 3')}), met AS (SELECT image_id, sum(a.v * b.v) / sum(a.v * a.v + b.v * b.v) AS overlap FROM a JOIN b USING (image_id, x, y) GROUP BY image_id)
        SELECT image_id, round(overlap, 6) AS overlap FROM (SELECT image_id FROM a UNION SELECT image_id FROM b) LEFT JOIN met USING (image_id)""",
        "nodes",
    )
)
def weighted_overlaps(spark, d):
    return rounded(ce.weighted_overlap(_cells(spark, d, "m <= 3"), _cells(spark, d, "m >= 3"), ["image_id"]), "overlap")


@query(
    with_views(
        f"""WITH b AS (SELECT image_id, x, y, max(v) AS most, sum(v) AS total FROM ({_typed_cells('<= 3')} UNION ALL {_typed_cells('>= 3')}) GROUP BY 1, 2, 3)
        SELECT image_id, CAST(count_if(most >= 0.6) AS BIGINT) AS n_max, CAST(count_if(total >= 0.6) AS BIGINT) AS n_sum FROM b GROUP BY image_id""",
        "nodes",
    )
)
def pasted_cells(spark, d):
    both = ce.pasted(_cells(spark, d, "m <= 3"), _cells(spark, d, "m >= 3"), ("max", "sum"))
    return both.groupBy("image_id").agg(F.count_if(F.col("max") >= 0.6).alias("n_max"), F.count_if(F.col("sum") >= 0.6).alias("n_sum"))


@query(
    with_views(
        """WITH c AS (SELECT DISTINCT gt_id, image_id, x, y FROM (
          SELECT gt_id, image_id, unnest(range(llx, urx)) AS x, lly AS y FROM gt UNION ALL SELECT gt_id, image_id, unnest(range(llx, urx)), ury - 1 FROM gt
          UNION ALL SELECT gt_id, image_id, llx, unnest(range(lly, ury)) FROM gt UNION ALL SELECT gt_id, image_id, urx - 1, unnest(range(lly, ury)) FROM gt))
        SELECT image_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, count(*) AS n FROM c GROUP BY image_id, x, y""",
        "gt",
    )
)
def box_outlines(spark, d):
    return ce.outlines(p.ground_truth(spark, d))


@query(
    with_views(
        f"""WITH o AS (SELECT unnest(range(-3, 4)) AS i), k AS (SELECT a.i, b.i AS j FROM o a, o b WHERE a.i * a.i + b.i * b.i <= 9)
        SELECT image_id, c.x + CAST(i AS INT) AS x, c.y + CAST(j AS INT) AS y, max(v) AS v FROM ({CELLS}) c, k GROUP BY 1, 2, 3""",
        "nodes",
    )
)
def disc_cells(spark, d):
    return ce.disc_cells(_cells(spark, d), 3)


@query(
    with_views(
        f"""WITH c AS ({CELLS}) SELECT c.image_id, c.x, c.y, round(0.5 * (coalesce(e.v, 0) - coalesce(w.v, 0)), 6) AS dx, round(0.5 * (coalesce(s.v, 0) - coalesce(n.v, 0)), 6) AS dy FROM c
        LEFT JOIN c e ON e.image_id = c.image_id AND e.x = c.x + 1 AND e.y = c.y LEFT JOIN c w ON w.image_id = c.image_id AND w.x = c.x - 1 AND w.y = c.y
        LEFT JOIN c s ON s.image_id = c.image_id AND s.x = c.x AND s.y = c.y + 1 LEFT JOIN c n ON n.image_id = c.image_id AND n.x = c.x AND n.y = c.y - 1""",
        "nodes",
    )
)
def cell_derivatives(spark, d):
    return rounded(ce.derivatives(_cells(spark, d)), "dx", "dy")


DOG = "SELECT i, j, exp(-(i * i + j * j) / 2.0) / 2.0 - exp(-(i * i + j * j) / 8.0) / 8.0 AS w FROM (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j)"


@query(with_views(f"SELECT c.image_id, c.x + CAST(k.i AS INT) AS x, c.y + CAST(k.j AS INT) AS y, round(sum(c.v * k.w), 6) AS v FROM ({CELLS}) c, ({DOG}) k GROUP BY 1, 2, 3", "nodes"))
def difference_of_gaussians(spark, d):
    """Sigmas 1 and 2."""
    wide = F.exp(-(F.col("i") * F.col("i") + F.col("j") * F.col("j")) / 8.0) / 8.0
    narrow = F.exp(-(F.col("i") * F.col("i") + F.col("j") * F.col("j")) / 2.0) / 2.0
    return rounded(im.convolved_cells(_cells(spark, d), p.kernel(spark).withColumn("w", narrow - wide)), "v")


@query(
    with_views(
        "SELECT image_id, CAST(l AS INT) AS level, CAST(floor(y * pow(2, l) / 64) * pow(2, l) + floor(x * pow(2, l) / 64) AS INT) AS bin, m, count(*) AS n FROM nodes, range(3) AS r(l) GROUP BY ALL", "nodes"
    )
)
def spatial_pyramids(spark, d):
    return ce.spatial_pyramid(p.nodes(spark, d), 64, 3)


@query(
    with_views(
        """WITH b AS (SELECT *, CAST(floor(x / 16.0) + 4 * floor(y / 16.0) AS INT) AS bin FROM nodes), s AS (SELECT image_id, bin, count(*) AS n, avg(x) AS cx, avg(y) AS cy FROM b GROUP BY 1, 2)
        SELECT image_id, bin, n, round(cx, 6) AS cx, round(cy, 6) AS cy, round(max((x - cx) * (x - cx) + (y - cy) * (y - cy)), 4) AS far2 FROM b JOIN s USING (image_id, bin) GROUP BY ALL""",
        "nodes",
    )
)
def bin_centroids(spark, d):
    bin_ = (F.floor(F.col("x") / 16) + 4 * F.floor(F.col("y") / 16)).cast("int")
    return rounded(ce.bins_of(p.nodes(spark, d), bin_), "cx", "cy").withColumn("far2", F.round("far2", 4))


@query(
    """SELECT p_partkey, p_size % 256 AS r, round(greatest(0, least(1, 1.5 - abs(4 * (p_size / 50.0) - 3))), 6) AS jet_r, round(greatest(0, least(1, 1.5 - abs(4 * (p_size / 50.0) - 2))), 6) AS jet_g,
    round(greatest(0, least(1, 1.5 - abs(4 * (p_size / 50.0) - 1))), 6) AS jet_b, p_size * 3 % 256 - p_size * 5 % 256 AS red_green, round(p_size * 7 % 256 - (p_size * 3 % 256 + p_size * 5 % 256) / 2.0, 6) AS blue_yellow FROM part"""
)
def colour_functions(spark, d):
    """The jet colours of a value, and opponent channels of red, green, blue."""
    t = F.col("p_size") / 50.0
    jet = lambda k: r6(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.5 - F.abs(4 * t - k))))
    red, green, blue = (F.col("p_size") * k % 256 for k in (3, 5, 7))
    return spark.read.parquet(f"{d}/part.parquet").select(
        "p_partkey", (F.col("p_size") % 256).alias("r"), jet(3).alias("jet_r"), jet(2).alias("jet_g"), jet(1).alias("jet_b"),
        (red - green).alias("red_green"), r6(blue - (red + green) / 2.0).alias("blue_yellow"),
    )


@query(with_views("SELECT z, CAST(sum(count(*)) OVER (ORDER BY z) AS BIGINT) AS upto FROM edges WHERE z < 4 GROUP BY z", "edges"))
def layers_below(spark, d):
    """Edges of the layers below 4, summed up from the lowest."""
    counts = p.edges(spark, d).where("z < 4").groupBy("z").agg(F.count(F.lit(1)).alias("n"))
    return running_sum(counts, [], ["z"], F.col("n"), "upto").select("z", "upto")


@query(
    with_views(
        """WITH s AS (SELECT z, count(DISTINCT dst) AS size FROM edges GROUP BY z) SELECT a.z, round(b.size * 1.0 / a.size, 6) AS contraction,
        round(exp(sum(ln(b.size * 1.0 / a.size)) OVER (ORDER BY a.z)), 4) AS upto FROM s a JOIN s b ON b.z = a.z - 1""",
        "edges",
    )
)
def layer_contractions(spark, d):
    """How much smaller a layer is than the one below, and than the lowest."""
    sizes = p.edges(spark, d).groupBy("z").agg(F.countDistinct("dst").alias("size"))
    below = sizes.select((F.col("z") + 1).alias("z"), F.col("size").alias("below"))
    each = sizes.join(below, "z").select("z", (F.col("below") / F.col("size")).alias("contraction"))
    ran = running_sum(each, [], ["z"], F.ln("contraction"), "upto")
    return rounded(ran, "contraction").withColumn("upto", F.round(F.exp("upto"), 4))
