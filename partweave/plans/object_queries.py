"""Object learning: covers, growing models, shape models, combinations, alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from partweave.operators import alignment as al
from partweave.operators import covers as cv
from partweave.operators import evaluation as ev
from partweave.operators import graphs as gr
from partweave.operators import growth as gw
from partweave.operators import mining as mi
from partweave.operators import paths as pt
from partweave.operators import shapes as sh
from partweave.operators import structure as st
from partweave.operators.ranges import window_join
from partweave.plans.registry import query, rounded
from partweave.sources import projections as p
from partweave.sources.projections import with_views
from partweave.sources.scratch import stored

#: The 3x3 region of a node's pixels, of an image with a border of one.
REGION = "transform(sequence(0, 8), k -> CAST((y + k DIV 3) * 66 + x + k % 3 AS BIGINT))"


def layered_supports(spark, d):
    """(image_id, z, node_id, x, y, m, value, points): orders (1) and groups of eight orders
    (2) with the cells of eight pixels that their lines fall into."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr(
        f"l_orderkey DIV {p.IMAGE_ORDERS} AS image_id", "l_orderkey", "l_quantity / 50.0 AS value", "CAST(l_partkey % 64 AS INT) AS x", "CAST((l_orderkey * 7 + l_linenumber * 13) % 64 AS INT) AS y"
    )
    layers = []
    for z, group in ((1, "l_orderkey"), (2, "l_orderkey DIV 8")):
        rows = lines.withColumn("node_id", F.expr(f"({group}) * 10 + {z}"))
        cells = F.array_sort(F.collect_set(F.expr("CAST(y DIV 8 * 8 + x DIV 8 AS BIGINT)")))
        layers.append(rows.groupBy("image_id", "node_id").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.expr("CAST(min(l_orderkey) % 7 AS INT)").alias("m"), F.avg("value").alias("value"), cells.alias("points")).withColumn("z", F.lit(z)))
    return layers[0].unionByName(layers[1])


@query()
def covering_objects(spark, d):
    """Covers by groups of orders that go on at orders; tests compare with a plain recursion."""
    supports = stored(layered_supports(spark, d), "supports")
    points = supports.where("z = 1").select("image_id", F.explode("points").alias("c")).groupBy("image_id").agg(F.array_sort(F.collect_set("c")).alias("points"))
    found = cv.covering_objects(supports, points, top=2, depths=2)
    return rounded(found.select("image_id", "object", "value", "n_parts", F.array_join(F.transform("parts", lambda t: t["node_id"].cast("string")), ",").alias("nodes")), "value")


def region_nodes(spark, d):
    return p.nodes(spark, d).select("image_id", "node_id", "x", "y", "m", "r", F.expr(REGION).alias("points"))


def peaks(spark, d):
    return gw.offset_peaks(p.nodes(spark, d), reach=6, radius=2, most=2)


@query()
def offset_peaks(spark, d):
    """Blurred maps of offsets and their peaks; tests compare with a plain loop."""
    return rounded(peaks(spark, d), "v")


def _models(spark, d):
    return gw.object_models(region_nodes(spark, d), peaks(spark, d).drop("v"), tolerance=1, longest=3, most_types=3, most_models=32)


@query()
def grown_models(spark, d):
    """Models of two and three nodes; tests compare with a plain recursion."""
    return _models(spark, d).select("image_id", F.array_join(F.transform("model", lambda n: n.cast("string")), ",").alias("model"), F.size("points").alias("n_points"))


@query()
def validated_models(spark, d):
    """Kinds of grown models (the types of their nodes) that find enough truths; the hits
    and misses are compared with a plain loop in the tests."""
    nodes = region_nodes(spark, d)
    models = stored(_models(spark, d), "models")  # read twice
    named = models.select("image_id", "model", F.posexplode("model").alias("k", "node_id")).join(nodes.select("image_id", "node_id", "m"), ["image_id", "node_id"])
    names = named.groupBy("image_id", "model").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "m"))), lambda t: t["m"].cast("string")), ",").alias("kind"))
    boxes = gw.model_boxes(models, nodes).drop("m").join(names, ["image_id", "model"])
    boxes = boxes.withColumn("box_id", F.concat_ws(":", "image_id", F.array_join(F.transform("model", lambda n: n.cast("string")), ",")))
    truth = p.ground_truth(spark, d)
    hits = ev.best_iou(boxes.drop("model"), truth, ["image_id"]).groupBy(F.col("kind").alias("m")).agg(F.count_if(F.col("best_iou") >= 0.2).alias("n_hits"), F.count_if(F.col("best_iou") < 0.2).alias("n_misses"))
    sizes = truth.agg(F.count(F.lit(1)).alias("n_boxes"))  # one row
    return rounded(st.kept_models(hits.crossJoin(sizes), 0.05, 0.0), "ratio")


def line_shapes(spark, d):
    """(key, id, shape): the places of an order's first four lines about their mean, by the
    order's number of lines."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").selectExpr("l_orderkey AS id", "l_linenumber AS k", "l_partkey % 64 AS x", "(l_orderkey * 7 + l_linenumber * 13) % 64 AS y")
    # One line a number.
    once = lines.groupBy("id", "k").agg(F.min("x").alias("x"), F.min("y").alias("y"))
    shapes = once.groupBy("id").agg(F.max("k").cast("int").alias("key"), F.array_sort(F.collect_list(F.when(F.col("k") <= 4, F.struct("k", "x", "y")))).alias("s")).where(F.size("s") == 4)
    mean = lambda c: F.aggregate("s", F.lit(0.0), lambda a, t: a + t[c]) / 4
    return shapes.withColumns({"mx": mean("x"), "my": mean("y")}).select("key", "id", F.concat(F.transform("s", lambda t: t["x"] - F.col("mx")), F.transform("s", lambda t: t["y"] - F.col("my"))).alias("shape"))


SHAPES = """once AS (SELECT l_orderkey AS id, l_linenumber AS k, min(l_partkey % 64) AS x, min((l_orderkey * 7 + l_linenumber * 13) % 64) AS y FROM lineitem GROUP BY 1, 2),
    four AS (SELECT id, max(k) AS key, list(x ORDER BY k) FILTER (k <= 4) AS xs, list(y ORDER BY k) FILTER (k <= 4) AS ys FROM once GROUP BY id HAVING count(*) FILTER (k <= 4) = 4),
    shapes AS (SELECT key, id, list_concat(list_transform(xs, lambda v: v - list_avg(xs)), list_transform(ys, lambda v: v - list_avg(ys))) AS shape FROM four)"""


def _states(spark, d):
    return sh.merged_states(sh.covariance_states(line_shapes(spark, d), "key", "shape"), "key")


@query(
    f"""WITH {SHAPES}, pairs AS (SELECT key, i, j, shape[i + 1] AS a, shape[j + 1] AS b FROM shapes, range(8) AS r(i), range(8) AS s(j) WHERE i <= j)
    SELECT key, i, j, round(avg(a * b) - avg(a) * avg(b), 4) AS cov FROM pairs GROUP BY key, i, j"""
)
def shape_covariances(spark, d):
    return sh.covariances(_states(spark, d), "key").withColumn("cov", F.round(F.col("cov") + 0.0, 4))


@query()
def shape_axes(spark, d):
    """Eigenvalues by key; tests compare with numpy."""
    models = sh.shape_models(_states(spark, d), "key", share=0.95)
    return models.select("key", "n", F.posexplode("eigenvalues").alias("axis", "eigenvalue")).withColumn("eigenvalue", F.round("eigenvalue", 4))


@query()
def masked_reconstructions(spark, d):
    """Shapes of which every third place is unknown, rebuilt from their key's axes; tests
    compare with numpy."""
    shapes = line_shapes(spark, d).withColumn("mask", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.when((F.col("id") + k) % 3 == 0, 0.0).otherwise(1.0)))
    models = sh.shape_models(_states(spark, d), "key", share=0.95)
    found = sh.projected(shapes, models, "key", "shape", "mask")
    return found.select("id", F.round("distance", 4).alias("distance"), F.round("density", 4).alias("density"))


#: The commonest offset between each two types, in windows of nine pixels.
COMMON = """common AS (SELECT m, o_m, dx, dy FROM (SELECT *, row_number() OVER (PARTITION BY m, o_m ORDER BY n DESC, dx, dy) AS rn FROM (
      SELECT a.m, b.m AS o_m, b.x - a.x AS dx, b.y - a.y AS dy, count(*) AS n FROM nodes a JOIN nodes b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 4
        AND a.node_id <> b.node_id GROUP BY 1, 2, 3, 4)) WHERE rn = 1),
    aims AS (SELECT a.image_id, a.node_id AS centre, a.m AS centre_m, a.r AS centre_r, o_m * 1000 AS sub, o_m, a.x + dx AS x, a.y + dy AS y FROM nodes a JOIN common USING (m)),
    near AS (SELECT aims.*, b.node_id, b.r, b.x AS qx, b.y AS qy, row_number() OVER (PARTITION BY centre, sub ORDER BY b.r DESC, b.node_id) AS rn FROM aims JOIN nodes b ON aims.image_id = b.image_id
      AND b.m = aims.o_m AND abs(b.x - aims.x) <= 2 AND abs(b.y - aims.y) <= 2 AND b.node_id <> centre AND b.r > 0.5 * centre_r),
    supports AS (SELECT image_id, centre, centre_m, sub, node_id, r, list_transform(range(9), lambda k: (qy + k // 3) * 66 + qx + k % 3) AS points FROM near WHERE rn = 1)"""


def _supports(spark, d):
    nodes = region_nodes(spark, d)
    met = window_join(nodes.select("image_id", "x", "y", "m", "node_id"), nodes.select("image_id", "x", "y", "m", "node_id"), ["image_id"], 4, 4).where("node_id <> o_node_id")
    offsets = met.groupBy("m", "o_m", (F.col("o_x") - F.col("x")).alias("dx"), (F.col("o_y") - F.col("y")).alias("dy")).agg(F.count(F.lit(1)).alias("n"))
    common = offsets.groupBy("m", "o_m").agg(F.min(F.struct(-F.col("n"), "dx", "dy")).alias("b")).select("m", "o_m", F.lit(0).alias("peak"), F.col("b.dx").alias("dx"), F.col("b.dy").alias("dy"))
    return mi.supported_subparts(nodes, common, tolerance=2, least=0.5)


@query(
    with_views(
        f"""WITH {COMMON}, two AS (SELECT a.image_id, a.centre, a.centre_m, a.sub AS s1, b.sub AS s2, a.r + b.r AS value, a.node_id AS n1, b.node_id AS n2, list_distinct(list_concat(a.points, b.points)) AS points
      FROM supports a JOIN supports b ON a.centre = b.centre AND b.sub > a.sub AND b.node_id <> a.node_id AND len(list_intersect(a.points, b.points)) <= 3),
    three AS (SELECT t.image_id, t.centre_m, s1 || ',' || s2 || ',' || c.sub AS subs, t.value + c.r AS value
      FROM two t JOIN supports c ON t.centre = c.centre AND c.sub > t.s2 AND c.node_id <> n1 AND c.node_id <> n2 AND len(list_intersect(t.points, c.points)) <= 3),
    every AS (SELECT image_id, centre_m, CAST(sub AS VARCHAR) AS subs, r AS value FROM supports UNION ALL SELECT image_id, centre_m, s1 || ',' || s2, value FROM two UNION ALL SELECT * FROM three)
    SELECT centre_m, subs, count(*) AS n, count(DISTINCT image_id) AS n_images, round(avg(value), 6) AS mean_value FROM every GROUP BY centre_m, subs""",
        "nodes",
    )
)
def subpart_combinations(spark, d):
    found = mi.combinations(_supports(spark, d), longest=3, most_shared=3)
    return rounded(mi.combination_statistics(found), "mean_value")


@query(
    with_views(
        f"""WITH {COMMON}, ranked AS (SELECT *, row_number() OVER (PARTITION BY centre ORDER BY r DESC, sub) AS n, max(r) OVER (PARTITION BY centre) AS top FROM supports)
    SELECT centre, sub, node_id FROM ranked WHERE n <= 2 AND r > 0.9 * top""",
        "nodes",
    )
)
def strongest_subparts(spark, d):
    return mi.strongest(_supports(spark, d), 2, 0.9).select("centre", "sub", "node_id")


@query()
def aligned_trees(spark, d):
    """Each type's spanning tree of an image aligned with the next image's, with its cost;
    tests compare with a plain loop."""
    nodes = p.nodes(spark, d)
    edges = gr.spanning_trees(nodes, ["image_id", "m"]).withColumn("tree", F.concat_ws(":", "image_id", "m"))
    paths = pt.longest_paths(edges.select("tree", "a", "b"), ["tree"])
    trees = edges.select("image_id", "m").distinct()
    pairs = trees.join(trees.select((F.col("image_id") - 1).alias("image_id"), "m"), ["image_id", "m"]).select(
        F.concat_ws(":", "image_id", "m").alias("pair"), F.concat_ws(":", "image_id", "m").alias("tree_a"), F.concat_ws(":", F.col("image_id") + 1, "m").alias("tree_b")
    )
    found = al.aligned_trees(pairs, paths, edges.select("tree", "a", "b"))
    return al.alignment_cost(found, nodes.select(F.col("node_id").alias("node"), "x", "y"))


@query(
    with_views(
        """WITH s AS (SELECT DISTINCT image_id, m, x, y FROM nodes),
    v AS (SELECT DISTINCT a.image_id AS pair, a.m, a.x, a.y, b.x - a.x + i AS dx, b.y - a.y + j AS dy FROM s a JOIN s b ON b.image_id = a.image_id + 1 AND a.m = b.m
      AND abs(a.x - b.x) <= 5 AND abs(a.y - b.y) <= 5, range(-1, 2) AS r(i), range(-1, 2) AS t(j)),
    n AS (SELECT pair, dx, dy, count(*) AS n FROM v WHERE abs(dx) <= 4 AND abs(dy) <= 4 GROUP BY pair, dx, dy)
    SELECT pair, dx, dy, n FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY n DESC, dx * dx + dy * dy, dx, dy) AS rn FROM n) WHERE rn = 1""",
        "nodes",
    )
)
def best_translations(spark, d):
    nodes = p.nodes(spark, d)
    images = nodes.select("image_id").distinct()
    pairs = images.join(images.select((F.col("image_id") - 1).alias("image_id")), "image_id").select(F.col("image_id").alias("pair"), F.col("image_id").alias("set_a"), (F.col("image_id") + 1).alias("set_b"))
    return al.best_translations(nodes.select(F.col("image_id").alias("set"), F.col("m").alias("label"), "x", "y"), pairs, tolerance=1, reach=4)
