"""Neighbours, sub-trees, supports, library merges and similarities, small algebra."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from partweave.operators import clustering as cl
from partweave.operators import evaluation as ev
from partweave.operators import graphs as gr
from partweave.operators import learning as ln
from partweave.operators import library as lb
from partweave.operators import merging as mg
from partweave.operators import structure as st
from partweave.operators import suppression as su
from partweave.plans.graph_queries import LEAVES
from partweave.plans.registry import query, r6, rounded
from partweave.sources import projections as p
from partweave.sources.projections import with_library, with_views
from partweave.sources.scratch import stored



@query(
    with_views(
        "SELECT src AS node, bool_or(dst IN (SELECT leaf FROM leaf_points WHERE m = 5)) AS hit FROM edges WHERE z = 1 GROUP BY src", "edges", "leaf_points"
    )
)
def nodes_by_neighbour(spark, d):
    edges = p.edges(spark, d).where("z = 1")
    wanted = p.leaf_points(spark, d).where("m = 5").select(F.col("leaf").alias("node"))
    return st.split_by_neighbour(edges.select(F.col("src").alias("node")).distinct(), edges, wanted)


@query(with_views('SELECT CAST(src % 4 AS INT) AS "group", count(DISTINCT dst) AS n FROM edges WHERE z <= 2 GROUP BY 1', "edges"))
def neighbour_unions(spark, d):
    edges = p.edges(spark, d).where("z <= 2")
    groups = edges.select(F.col("src").alias("node")).distinct().withColumn("group", (F.col("node") % 4).cast("int"))
    return st.neighbour_union(edges, groups).groupBy("group").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("SELECT DISTINCT src AS node FROM edges WHERE src NOT IN (SELECT dst FROM edges)", "edges"))
def nodes_without_incoming(spark, d):
    edges = p.edges(spark, d)
    return st.without_incoming(edges, edges.select(F.col("src").alias("node")).distinct())


@query(
    with_views(
        """WITH first AS (SELECT src, min(dst) AS child FROM edges GROUP BY src) SELECT a.src AS node, coalesce(c.child, b.child, a.child) AS leaf FROM (SELECT DISTINCT src, z FROM edges WHERE z = 3) s
        JOIN first a ON a.src = s.src LEFT JOIN first b ON b.src = a.child LEFT JOIN first c ON c.src = b.child""",
        "edges",
    )
)
def first_child_leaves(spark, d):
    edges = p.edges(spark, d)
    return st.first_children(edges, edges.where("z = 3").select(F.col("src").alias("node")).distinct())


@query(
    with_views(
        """WITH reach AS (SELECT DISTINCT src AS node, src AS reached, 0 AS dist FROM edges WHERE z = 4 UNION SELECT r.node, e.dst, r.dist + 1 FROM reach r JOIN edges e ON e.src = r.reached)
        SELECT node, min(dist) AS dist, count(*) AS n FROM reach WHERE reached % 10 = 2 OR reached % 30 = 3 GROUP BY node""",
        "edges",
        recursive=True,
    )
)
def nearest_in_set(spark, d):
    """Steps to the nearest node of a set, by shortest distances."""
    edges = p.edges(spark, d)
    found = gr.shortest_distances(edges, edges.where("z = 4").select(F.col("src").alias("node")).distinct())
    return found.where("reached % 10 = 2 OR reached % 30 = 3").groupBy("node").agg(F.min("dist").alias("dist"), F.count(F.lit(1)).alias("n"))


@query(with_views(LEAVES + " SELECT e.src AS node, e.dst AS child, count(*) AS n_leaves FROM edges e JOIN found f ON f.node = e.dst WHERE e.z = 2 GROUP BY 1, 2", "edges", recursive=True))
def child_supports(spark, d):
    """Leaves by direct child."""
    edges = p.edges(spark, d)
    below = gr.layered_leaves(edges, 1).select(F.col("node").alias("dst"), "leaf")
    return edges.where("z = 2").join(below, "dst").groupBy(F.col("src").alias("node"), F.col("dst").alias("child")).agg(F.count(F.lit(1)).alias("n_leaves"))


@query(
    with_views(
        LEAVES + """ SELECT node, m, count(*) AS n, CAST(sum(x) AS BIGINT) AS v, min(x) AS llx, min(y) AS lly, max(x) AS urx, max(y) AS ury FROM found JOIN leaf_points USING (leaf) WHERE z = 2 GROUP BY node, m""",
        "edges",
        "leaf_points",
        recursive=True,
    )
)
def subtree_sums(spark, d):
    support = gr.layered_leaves(p.edges(spark, d), 2).where("z = 2").select("node", "leaf")
    return st.subtree_sums(support, p.leaf_points(spark, d).withColumn("v", F.col("x").cast("long")), ["m"])


@query(
    with_views(
        """SELECT a.src AS node, b.k AS path, count(*) AS n, round(avg(l.x), 6) AS mean_x FROM (SELECT * FROM edges WHERE z = 2) a JOIN (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM edges WHERE z = 1) b ON b.src = a.dst
        JOIN leaf_points l ON l.leaf = b.dst GROUP BY 1, 2""",
        "edges",
        "leaf_points",
    )
)
def path_bin_sums(spark, d):
    """Leaves below each node by the last step of their path."""
    edges = p.edges(spark, d)
    last = gr.dense_ids(edges.where("z = 1"), ["src"], ["dst"]).select(F.col("src").alias("mid"), F.col("dst").alias("leaf"), (F.col("dense_id") + 1).alias("path"))
    met = edges.where("z = 2").select(F.col("src").alias("node"), F.col("dst").alias("mid")).join(last, "mid").join(p.leaf_points(spark, d), "leaf")
    return met.groupBy("node", "path").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("x")).alias("mean_x"))


@query(with_views("SELECT e.src AS node, string_agg(DISTINCT y * 64 + x, ',' ORDER BY y * 64 + x) AS pixels FROM edges e JOIN leaf_points l ON l.leaf = e.dst WHERE z = 1 GROUP BY e.src", "edges", "leaf_points"))
def pixel_sets(spark, d):
    met = p.edges(spark, d).where("z = 1").join(p.leaf_points(spark, d), F.col("dst") == F.col("leaf"))
    ids = F.array_sort(F.collect_set(F.col("y") * 64 + F.col("x")))
    return met.groupBy(F.col("src").alias("node")).agg(F.array_join(ids.cast("array<string>"), ",").alias("pixels"))


@query(with_views(LEAVES + " SELECT node, CAST(floor(x / 8.0) AS INT) AS cx, CAST(floor(y / 8.0) AS INT) AS cy, count(*) AS n FROM found JOIN leaf_points USING (leaf) WHERE z = 2 GROUP BY 1, 2, 3", "edges", "leaf_points", recursive=True))
def projected_supports(spark, d):
    """Supports on a matrix an eighth as wide."""
    support = gr.layered_leaves(p.edges(spark, d), 2).where("z = 2").join(p.leaf_points(spark, d), "leaf")
    cell = lambda c: F.floor(F.col(c) / 8).cast("int")
    return support.groupBy("node", cell("x").alias("cx"), cell("y").alias("cy")).agg(F.count(F.lit(1)).alias("n"))


@query(
    with_views(
        "SELECT e.src AS node, CAST(max((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS INT) AS far2 FROM edges e JOIN leaf_points a ON a.leaf = e.dst JOIN edges f ON f.src = e.src JOIN leaf_points b ON b.leaf = f.dst WHERE e.z = 1 GROUP BY e.src",
        "edges",
        "leaf_points",
    )
)
def farthest_children(spark, d):
    """The largest squared distance between two children."""
    points = p.edges(spark, d).where("z = 1").join(p.leaf_points(spark, d), F.col("dst") == F.col("leaf")).select(F.col("src").alias("node"), "x", "y")
    sets = points.groupBy("node").agg(F.collect_list(F.struct("x", "y")).alias("p"))
    d2 = lambda a, b: (a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])
    far = F.array_max(F.transform("p", lambda a: F.array_max(F.transform("p", lambda b: d2(a, b)))))
    return sets.select("node", far.alias("far2"))


@query(with_views("SELECT src AS node, string_agg(dst, ',' ORDER BY dst) AS children FROM edges WHERE z >= 2 GROUP BY src", "edges"))
def child_lists(spark, d):
    children = F.array_sort(F.collect_list("dst")).cast("array<string>")
    return p.edges(spark, d).where("z >= 2").groupBy(F.col("src").alias("node")).agg(F.array_join(children, ",").alias("children"))


CELLS_OF = "own AS (SELECT e.src AS node, (y // 8) * 8 + x // 8 AS leaf, e.src // 640 AS grp FROM edges e JOIN leaf_points l ON l.leaf = e.dst WHERE e.z = 1 GROUP BY ALL)"


@query(
    with_views(
        f"""WITH {CELLS_OF}, size AS (SELECT node, count(*) AS n FROM own GROUP BY node)
        SELECT a.node, b.node AS other, round(count(*) * 1.0 / any_value(n), 6) AS overlap FROM own a JOIN own b ON a.grp = b.grp AND a.leaf = b.leaf AND a.node <> b.node JOIN size s ON s.node = a.node GROUP BY 1, 2""",
        "edges",
        "leaf_points",
    )
)
def overlapping_neighbours(spark, d):
    """Orders of an image whose lines share cells of eight."""
    met = p.edges(spark, d).where("z = 1").join(p.leaf_points(spark, d), F.col("dst") == F.col("leaf"))
    cell = F.expr("y DIV 8 * 8 + x DIV 8").alias("leaf")
    support = met.select(F.col("src").alias("node"), cell).distinct()
    groups = support.select("node").distinct().withColumn("group", F.expr("node DIV 640"))
    return rounded(st.overlapping_neighbours(support, groups), "overlap")


@query(
    with_views(
        """WITH share AS (SELECT e.src AS node, avg(CASE WHEN l.x < 32 THEN 1.0 ELSE 0.0 END) AS share FROM edges e JOIN leaf_points l ON l.leaf = e.dst WHERE e.z = 1 GROUP BY e.src)
        SELECT CAST(node // 10 % 7 AS INT) AS m, count(*) AS n FROM share WHERE share < 0.4 GROUP BY 1""",
        "edges",
        "leaf_points",
    )
)
def uncovered_types(spark, d):
    edges, points = p.edges(spark, d).where("z = 1"), p.leaf_points(spark, d)
    support = edges.select(F.col("src").alias("node"), F.col("dst").alias("leaf"))
    types = support.select("node").distinct().withColumn("m", F.expr("CAST(node DIV 10 % 7 AS INT)"))
    return st.uncovered_types(support, types, points.where("x < 32"), 0.4)


# --- libraries ---------------------------------------------------------------


@query(
    with_library(
        """WITH map AS (SELECT part, part // 2 AS "to" FROM lib_center), first AS (SELECT "to", min(part) AS part FROM map GROUP BY "to")
        SELECT f."to" AS part, idx, coalesce(t."to", sub_m) AS sub_m, dx, dy FROM lib_sub s JOIN first f ON s.part = f.part LEFT JOIN map t ON t.part = s.sub_m"""
    )
)
def merged_libraries(spark, d):
    center = p.part_center(spark, d)
    into = center.select("part", F.expr("CAST(part DIV 2 AS INT)").alias("to"))
    return st.merged_libraries(center, p.part_sub(spark, d), into)[1].select("part", "idx", "sub_m", "dx", "dy")


#: Types are as similar as their masks correlate; parts by the best matching of their subparts.
SIMILAR = """WITH types AS (SELECT a.m, b.m AS t, sum(a.v * b.v) / sqrt(sum(a.v * a.v) * sum(b.v * b.v)) AS s FROM masks a JOIN masks b USING (x, y) GROUP BY 1, 2),
n AS (SELECT part, count(*) AS n FROM lib_sub GROUP BY part), sized AS (SELECT s.*, n FROM lib_sub s JOIN n USING (part)),
placed AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY idx) AS k FROM sized),
orders AS (SELECT * FROM (VALUES (1, 0, 1, 1), (2, 0, 1, 1), (2, 0, 2, 2), (2, 1, 1, 2), (2, 1, 2, 1), (3, 0, 1, 1), (3, 0, 2, 2), (3, 0, 3, 3), (3, 1, 1, 1), (3, 1, 2, 3), (3, 1, 3, 2), (3, 2, 1, 2), (3, 2, 2, 1), (3, 2, 3, 3),
  (3, 3, 1, 2), (3, 3, 2, 3), (3, 3, 3, 1), (3, 4, 1, 3), (3, 4, 2, 1), (3, 4, 3, 2), (3, 5, 1, 3), (3, 5, 2, 2), (3, 5, 3, 1)) AS v(n, o, k, l)),
each AS (SELECT a.part, b.part AS other, o, avg(y.s * exp(-((a.dx - b.dx) * (a.dx - b.dx) + (a.dy - b.dy) * (a.dy - b.dy)) / 8.0)) AS mean FROM placed a JOIN orders USING (n, k)
  JOIN placed b ON b.n = a.n AND b.k = l JOIN types y ON y.m = a.sub_m AND y.t = b.sub_m GROUP BY 1, 2, 3),
alike AS (SELECT part, other, max(mean) AS similarity FROM each GROUP BY 1, 2 HAVING max(mean) >= 0.8)"""


@query(with_library(SIMILAR + " SELECT part, other, round(similarity, 6) AS similarity FROM alike"))
def part_similarities(spark, d):
    return st.similarities(p.part_sub(spark, d), st.mask_similarities(p.type_masks(spark, d)), 2.0, 0.8, digits=6)


@query(with_library(SIMILAR + " SELECT part, min(other) AS root FROM alike GROUP BY part"))
def similarity_roots(spark, d):
    sub, types = p.part_sub(spark, d), stored(st.mask_similarities(p.type_masks(spark, d)), "types")
    found = st.place_classes(sub, types, 2.0, 0.8)
    if found is None:
        members, alike = st.alike_classes(sub, types, 2.0, 0.8)
    else:
        members, places, one = found
        alike = st.class_similarities(places, one, 2.0, 0.8 - 1e-9, first=True)
    # A class has the name of its smallest part, so the smallest similar class holds the root.
    roots = st.similarity_roots(alike.withColumnRenamed("class", "part"), 0.8).withColumnRenamed("part", "class")
    return members.join(roots, "class").select("part", "root")


@query(with_library("SELECT part, CAST((SELECT max(part) FROM lib_center) + dense_rank() OVER (ORDER BY name) AS INT) AS category FROM (SELECT part, CASE WHEN bp = 3 THEN 'large' ELSE 'small' END AS name FROM lib_center)"))
def category_parts(spark, d):
    center = p.part_center(spark, d)
    members = center.select("part", F.when(F.col("bp") == 3, "large").otherwise("small").alias("name"))
    return st.with_categories(center, members)


@query("SELECT p_partkey AS part, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS kept FROM part")
def redundant_parts(spark, d):
    named = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("part"), F.concat_ws("|", "p_brand", "p_size").alias("structure"))
    return st.redundant(named)


@query(with_library("SELECT part, min(x0) AS llx, max(x0) AS urx, min(y0) AS lly, max(y0) AS ury FROM (SELECT part, 0 AS x0, 0 AS y0 FROM lib_center UNION ALL SELECT part, dx, dy FROM lib_sub) GROUP BY part"))
def part_extents(spark, d):
    """Bounding boxes of the library's geometry around its centres."""
    points = p.part_center(spark, d).select("part", F.lit(0).alias("x"), F.lit(0).alias("y")).unionByName(p.part_sub(spark, d).select("part", F.col("dx").alias("x"), F.col("dy").alias("y")))
    return points.groupBy("part").agg(F.min("x").alias("llx"), F.max("x").alias("urx"), F.min("y").alias("lly"), F.max("y").alias("ury"))


@query(with_library("SELECT a.sub_m AS a, b.sub_m AS b, count(*) AS n FROM lib_sub a JOIN lib_sub b ON a.part = b.part AND a.idx < b.idx GROUP BY 1, 2"))
def subpart_pairs(spark, d):
    sub = p.part_sub(spark, d)
    other = sub.select("part", F.col("idx").alias("o"), F.col("sub_m").alias("b"))
    return sub.join(other, "part").where("idx < o").groupBy(F.col("sub_m").alias("a"), "b").agg(F.count(F.lit(1)).alias("n"))


@query(
    with_views(
        "SELECT n.node_id, n.x + min(least(0, s.dx)) AS llx, n.y + min(least(0, s.dy)) AS lly, n.x + max(greatest(0, s.dx)) AS urx, n.y + max(greatest(0, s.dy)) AS ury FROM nodes n JOIN lib_sub s ON s.part = n.m GROUP BY n.node_id, n.x, n.y",
        "nodes",
        "lib_sub",
    )
)
def predicted_boxes(spark, d):
    """A part's rectangle, moved to each node of its type."""
    side = lambda f, g, c: f(g(F.lit(0), F.col(c)))
    boxes = p.lib_sub(spark).groupBy(F.col("part").alias("m")).agg(
        side(F.min, F.least, "dx").alias("l"), side(F.min, F.least, "dy").alias("b"), side(F.max, F.greatest, "dx").alias("r"), side(F.max, F.greatest, "dy").alias("t")
    )
    at = lambda c, o, n: (F.col(c) + F.col(o)).alias(n)
    return p.nodes(spark, d).select("node_id", "m", "x", "y").join(boxes, "m").select("node_id", at("x", "l", "llx"), at("y", "b", "lly"), at("x", "r", "urx"), at("y", "t", "ury"))


BEST_IOU = """WITH best AS (SELECT b.box_id, b.m, max(coalesce(greatest(0, least(b.urx, g.urx) - greatest(b.llx, g.llx)) * greatest(0, least(b.ury, g.ury) - greatest(b.lly, g.lly)) * 1.0
  / ((b.urx - b.llx) * (b.ury - b.lly) + (g.urx - g.llx) * (g.ury - g.lly) - greatest(0, least(b.urx, g.urx) - greatest(b.llx, g.llx)) * greatest(0, least(b.ury, g.ury) - greatest(b.lly, g.lly))), 0)) AS iou
  FROM boxes b LEFT JOIN gt g ON g.image_id = b.image_id AND g.m = b.m GROUP BY 1, 2)"""


@query(
    with_views(
        BEST_IOU + """, hits AS (SELECT m, count_if(iou >= 0.3) AS n_hits, count_if(iou < 0.3) AS n_misses FROM best GROUP BY m), sizes AS (SELECT m, count(*) AS n_boxes FROM gt GROUP BY m)
        SELECT m, CAST(n_hits AS BIGINT) AS n_hits, CAST(n_misses AS BIGINT) AS n_misses, n_boxes, round(n_hits * 1.0 / (n_hits + n_misses), 6) AS ratio FROM hits JOIN sizes USING (m)
        WHERE n_hits > 0 AND n_hits * 1.0 / (n_hits + n_misses) >= 0.05 AND n_hits > 0.2 * n_boxes""",
        "boxes",
        "gt",
    )
)
def kept_models(spark, d):
    truth = p.ground_truth(spark, d)
    found = ev.best_iou(p.boxes(spark, d), truth, ["image_id", "m"])
    hits = found.groupBy("m").agg(F.count_if(F.col("best_iou") >= 0.3).alias("n_hits"), F.count_if(F.col("best_iou") < 0.3).alias("n_misses"))
    sizes = truth.groupBy("m").agg(F.count(F.lit(1)).alias("n_boxes"))
    return rounded(st.kept_models(hits.join(sizes, "m"), 0.05, 0.2), "ratio")


@query(with_views("SELECT m, count(*) AS n, round(avg(g), 6) AS mean_g, round(stddev_samp(g), 6) AS sd_g FROM nodes GROUP BY m", "nodes"))
def response_distributions(spark, d):
    return rounded(p.nodes(spark, d).groupBy("m").agg(F.count(F.lit(1)).alias("n"), F.avg("g").alias("mean_g"), F.stddev_samp("g").alias("sd_g")), "mean_g", "sd_g")


@query(
    with_views(
        """WITH d AS (SELECT v.vec_id, c.vec_id AS near_id, c.label, list_sum(list_transform(list_zip(v.h, c.h), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d2 FROM hist v, (SELECT * FROM hist WHERE vec_id < 32) c)
        SELECT vec_id, near_id, label, round(sqrt(d2), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d2, near_id) AS rn FROM d) WHERE rn = 1""",
        "hist",
    )
)
def nearest_labels(spark, d):
    """The label of the nearest of 32 labelled histograms, a model."""
    hist = p.histograms(spark, d)
    model = hist.where("vec_id < 32").select(F.col("vec_id").alias("code"), F.col("h").alias("centre"), "label")
    near = cl.quantise(hist, model, id_col="vec_id", kind="l2")
    return near.join(model.select("code", "label"), "code").select("vec_id", F.col("code").alias("near_id"), "label", r6(F.sqrt("distance")).alias("distance"))


# --- algebra -----------------------------------------------------------------


@query(
    with_views(
        """WITH s AS (SELECT image_id, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM nodes GROUP BY image_id)
        SELECT image_id, round((a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b), 4) AS l1, round((a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b), 4) AS l2, round(a * c - b * b, 2) AS det,
        round(c / (a * c - b * b), 6) AS i11, round(-b / (a * c - b * b), 6) AS i12, round(a / (a * c - b * b), 6) AS i22 FROM s""",
        "nodes",
    )
)
def matrix_functions(spark, d):
    """Eigenvalues, determinant and inverse of 2x2 matrices."""
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    s = p.nodes(spark, d).groupBy("image_id").agg(F.var_pop("x").alias("a"), F.covar_pop("x", "y").alias("b"), F.var_pop("y").alias("c"))
    half, root, det = (a + c) / 2, F.sqrt((a - c) * (a - c) / 4 + b * b), a * c - b * b
    return s.select("image_id", F.round(half + root, 4).alias("l1"), F.round(half - root, 4).alias("l2"), F.round(det, 2).alias("det"), r6(c / det).alias("i11"), r6(-b / det).alias("i12"), r6(a / det).alias("i22"))


@query(
    with_views(
        """WITH c AS (SELECT gt_id, unnest([llx, urx, llx, urx]) AS x, unnest([lly, lly, ury, ury]) AS y FROM gt)
        SELECT gt_id, round(min(x * cos(0.5) - y * sin(0.5)), 6) AS llx, round(max(x * cos(0.5) - y * sin(0.5)), 6) AS urx, round(min(x * sin(0.5) + y * cos(0.5)), 6) AS lly, round(max(x * sin(0.5) + y * cos(0.5)), 6) AS ury FROM c GROUP BY gt_id""",
        "gt",
    )
)
def rotated_boxes(spark, d):
    """The box of a box's corners, turned by half a radian."""
    from partweave.functions import geometry as geo

    corners = [geo.rotate(F.col(x), F.col(y), F.lit(0.5)) for x in ("llx", "urx") for y in ("lly", "ury")]
    xs, ys = zip(*corners, strict=True)
    return p.ground_truth(spark, d).select("gt_id", r6(F.least(*xs)).alias("llx"), r6(F.greatest(*xs)).alias("urx"), r6(F.least(*ys)).alias("lly"), r6(F.greatest(*ys)).alias("ury"))


@query(
    """SELECT p_partkey, CAST(floor(log2(p_size)) AS INT) AS log2, split_part(p_type, ' ', 1) || ' ' || split_part(p_type, ' ', 2) AS two_tokens, replace(p_brand, '#', '_') || p_size AS named,
    (p_size * 2) || ',' || p_size || ',' || (p_size + 1) AS permuted, round(exp(-(p_size * p_size / 800.0)) / (2 * pi() * 400), 9) AS normal2 FROM part"""
)
def token_functions(spark, d):
    """Whole logarithms, first tokens, names with numbers, permutations, 2-D normals."""
    part = spark.read.parquet(f"{d}/part.parquet")
    three = F.array(F.col("p_size"), F.col("p_size") + 1, F.col("p_size") * 2)
    return part.select(
        "p_partkey", F.floor(F.log2("p_size")).cast("int").alias("log2"),
        F.concat_ws(" ", F.coalesce(F.try_element_at(F.split("p_type", " "), F.lit(1)), F.lit("")), F.coalesce(F.try_element_at(F.split("p_type", " "), F.lit(2)), F.lit(""))).alias("two_tokens"),
        F.concat(F.translate("p_brand", "#", "_"), F.col("p_size").cast("string")).alias("named"),
        F.array_join(F.transform(F.array(F.lit(2), F.lit(0), F.lit(1)), lambda i: three[i].cast("string")), ",").alias("permuted"),
        F.round(F.exp(-(F.col("p_size") * F.col("p_size") / 800.0)) / (2 * 3.141592653589793 * 400), 9).alias("normal2"),
    )


@query(
    with_views(
        """WITH t AS (SELECT image_id, list_distinct(list(m) FILTER (WHERE x < 20)) AS a, list_distinct(list(m) FILTER (WHERE y < 8)) AS b FROM nodes GROUP BY image_id)
        SELECT image_id, array_to_string(list_sort(list_filter(a, lambda v: NOT list_contains(b, v))), ',') AS a_b, array_to_string(list_sort(list_filter(b, lambda v: NOT list_contains(a, v))), ',') AS b_a FROM t WHERE a IS NOT NULL AND b IS NOT NULL""",
        "nodes",
    )
)
def set_differences(spark, d):
    nodes = p.nodes(spark, d)
    sets = nodes.groupBy("image_id").agg(F.collect_set(F.when(F.col("x") < 20, F.col("m"))).alias("a"), F.collect_set(F.when(F.col("y") < 8, F.col("m"))).alias("b"))
    text = lambda s: F.array_join(F.array_sort(s).cast("array<string>"), ",")
    return sets.where("size(a) > 0 AND size(b) > 0").select("image_id", text(F.array_except("a", "b")).alias("a_b"), text(F.array_except("b", "a")).alias("b_a"))


@query(
    with_views(
        """SELECT image_id, m, count(*) AS n, round(avg(x), 6) AS mx, round(avg(y), 6) AS my, round(sqrt(var_pop(x) + var_pop(y)), 6) AS scale FROM nodes GROUP BY image_id, m""",
        "nodes",
    )
)
def point_spreads(spark, d):
    """Mean and scale of point sets."""
    spread = F.sqrt(F.var_pop("x") + F.var_pop("y"))
    return rounded(p.nodes(spark, d).groupBy("image_id", "m").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), spread.alias("scale")), "mx", "my", "scale")


# --- operators that tests only reached before --------------------------------


@query(
    with_views(
        """WITH moved AS (SELECT image_id, z, x + 8 * CAST(node_id % 3 AS INT) AS x, y, m, g, node_id FROM nodes)
        SELECT image_id, x, y, m, node_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, z, x, y, m ORDER BY g DESC, node_id) AS rn FROM moved) WHERE rn = 1""",
        "nodes",
    )
)
def merged_tiles(spark, d):
    tiles = spark.range(3).select(F.col("id").alias("tile_id"), (F.col("id") * 8).cast("int").alias("ox"), F.lit(0).alias("oy"))
    return mg.merge_tiles(p.nodes(spark, d).withColumn("tile_id", F.col("node_id") % 3), tiles).select("image_id", "x", "y", "m", "node_id")


@query(
    with_views(
        """WITH w AS (SELECT src, dst // 10 % 3 AS idx, dst, 1.0 + dst // 10 % 7 AS r FROM edges WHERE z <= 2),
        u AS (SELECT *, (CAST('0x' || substr(md5(src || ':' || idx || ':' || dst || ':5'), 1, 12) AS BIGINT) + 1) / CAST(281474976710657 AS DOUBLE) AS u FROM w)
        SELECT src, CAST(idx AS INT) AS idx, arg_min(dst, {'race': -ln(u) / r, 'dst': dst}) AS dst FROM u GROUP BY src, idx""",
        "edges",
    )
)
def sampled_children(spark, d):
    """Children in three classes of a node, each drawn by a weight of 1 to 7."""
    edges = p.edges(spark, d).where("z <= 2").withColumns({"idx": F.expr("CAST(dst DIV 10 % 3 AS INT)"), "r": F.expr("CAST(1 + dst DIV 10 % 7 AS DOUBLE)")})
    return gr.sampled_children(edges, 5).select("src", "idx", "dst")


@query()
def islands_of_cells(spark, d):
    """8-neighbour islands; tests compare with a plain flood."""
    cells = p.nodes(spark, d).groupBy("image_id", "x", "y").agg(F.max("r").alias("v"))
    return gr.flood(cells, ["image_id"], 0.3)


@query()
def suppressed_points(spark, d):
    """Greedy discs; tests compare with a plain loop."""
    return su.suppress_points(p.nodes(spark, d).select("image_id", "m", "x", "y", "node_id", "r"), ["image_id", "m"], 6.0, "r", "node_id").select("image_id", "m", "node_id")


def _supports(spark, d):
    """(image, node, val, leaves) of orders over cells of eight."""
    met = p.edges(spark, d).where("z = 1").join(p.leaf_points(spark, d), F.col("dst") == F.col("leaf"))
    cells = F.array_sort(F.collect_set(F.expr("CAST(y DIV 8 * 8 + x DIV 8 AS BIGINT)")))
    return met.groupBy(F.expr("src DIV 640").alias("image_id"), F.col("src").alias("node_id")).agg(F.max("x").cast("double").alias("val"), cells.alias("leaves"))


@query()
def suppressed_by_leaves(spark, d):
    """Best first, by share of leaves already covered; tests compare with a plain loop."""
    return su.suppress_by_leaves(_supports(spark, d), ["image_id"], 0.5).select("image_id", "node_id")


@query()
def greedy_covers(spark, d):
    """Largest supports first until enough is covered; tests compare with a plain loop."""
    return su.greedy_cover(_supports(spark, d), ["image_id"], 0.5, 0.9).select("image_id", "node_id")


@query()
def greedy_types(spark, d):
    """Greedy set cover of cells by types; tests compare with a plain loop."""
    nodes = p.nodes(spark, d)
    covers = nodes.select("m", F.expr("image_id * 4096 + y * 64 + x").alias("leaf"))
    chosen = ln.greedy_types(covers, 4)
    return spark.createDataFrame([(k, m, n) for k, (m, n) in enumerate(chosen)], "step int, m int, n long")


@query()
def matched_distances(spark, d):
    """Least-cost matching of the points of two types; tests compare with all permutations."""
    point = F.struct("x", "y")
    sets = p.nodes(spark, d).groupBy("image_id").agg(F.collect_list(F.when(F.col("m") == 5, point)).alias("a"), F.collect_list(F.when(F.col("m") == 6, point)).alias("b"))
    return rounded(cl.matched_distance(sets, "a", "b").select("image_id", "cost"), "cost")


@query()
def farthest_histograms(spark, d):
    """Eight histograms by farthest-point sampling; tests compare with a plain loop."""
    chosen = cl.farthest_points(p.histograms(spark, d), 8, id_col="vec_id")
    return spark.createDataFrame(list(enumerate(chosen)), "step int, vec_id long")


@query()
def principal_axes(spark, d):
    """The largest eigenvalues of the histograms' covariance; tests compare with numpy."""
    _, values, _ = cl.principal_axes(p.histograms(spark, d), "h", 4)
    return spark.createDataFrame([(k, round(float(v), 9)) for k, v in enumerate(values)], "axis int, eigenvalue double")


@query(
    with_views(
        "SELECT m, strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M:%S') AS t, count(*) AS n FROM frames GROUP BY 1, 2", "frames"
    )
)
def streamed_timed_counts(spark, d):
    """Counts by event-time windows of an hour; complete, since the stream stops."""
    from partweave.streaming import frames, runs

    found = runs.run_available(frames.timed_counts(runs.event_stream(spark, d), "1 hour", "100 days"), "complete")
    return found.select("m", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("t"), "n")


@query()
def thin_plate_energies(spark, d):
    """Bending energies from each image's points of a type to where their responses move
    them; tests compare with a direct solution."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    place = F.struct("node_id", at(F.col("x"), F.col("y")).alias("a"), at(F.col("x") + 4 * F.col("r"), F.col("y") - 4 * F.col("g")).alias("b"))
    sets = p.nodes(spark, d).groupBy("image_id", "m").agg(F.array_sort(F.collect_list(place)).alias("s"))
    pairs = sets.select("image_id", "m", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    return cl.bending_energies(pairs, "a", "b").select("image_id", "m", F.round("energy", 3).alias("energy"))


@query()
def hull_areas(spark, d):
    """Convex hulls of each image's nodes by type; tests compare with half planes."""
    return cl.hull_areas(p.nodes(spark, d), ["image_id", "m"])


@query(with_views("SELECT mc, mn, count(*) AS n, round(sum(v), 6) AS v FROM (SELECT a.m AS mc, b.m AS mn, b.r AS v FROM nodes a JOIN nodes b ON a.image_id = b.image_id AND a.x = b.x AND a.y = b.y AND a.m <> b.m) GROUP BY 1, 2", "nodes"))
def types_at_cells(spark, d):
    """Counts of pairs of types at one cell."""
    nodes = p.nodes(spark, d)
    other = nodes.select("image_id", "x", "y", F.col("m").alias("mn"), F.col("r").alias("v"))
    return rounded(nodes.select("image_id", "x", "y", F.col("m").alias("mc")).join(other, ["image_id", "x", "y"]).where("mc <> mn").groupBy("mc", "mn").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v")), "v")


@query(with_views("SELECT n.m, category, count(*) AS n FROM nodes n JOIN (SELECT part, part // 3 AS category FROM lib_center) c ON c.part = n.m GROUP BY 1, 2", "nodes", "lib_center"))
def types_by_category(spark, d):
    upper = lb.category_names(p.lib_center(spark), p.lib_center(spark).select(F.col("part").alias("m"), F.expr("CAST(part DIV 3 AS STRING)").alias("name")))
    met = p.nodes(spark, d).join(upper.select(F.col("part").alias("m"), F.col("name").cast("int").alias("category")), "m")
    return met.groupBy("m", "category").agg(F.count(F.lit(1)).alias("n"))


@query(
    with_views(
        """WITH b AS (SELECT image_id, y // 16 * 4 + x // 16 AS bin, avg(x) AS cx, avg(y) AS cy FROM nodes GROUP BY 1, 2)
        SELECT a.image_id, CAST(a.bin AS INT) AS bin, CAST(b.bin AS INT) AS other, round(exp(-((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) / 512.0), 6) AS w
        FROM b a JOIN b USING (image_id) WHERE (a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy) <= 576""",
        "nodes",
    )
)
def bin_weights(spark, d):
    """Gaussian weights between the bins of an image whose centroids lie within 24 pixels."""
    bins = p.nodes(spark, d).groupBy("image_id", F.expr("CAST(y DIV 16 * 4 + x DIV 16 AS INT)").alias("bin")).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    other = bins.select("image_id", F.col("bin").alias("other"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
    d2 = (F.col("cx") - F.col("ox")) * (F.col("cx") - F.col("ox")) + (F.col("cy") - F.col("oy")) * (F.col("cy") - F.col("oy"))
    return bins.join(other, "image_id").where(d2 <= 576).select("image_id", "bin", "other", r6(F.exp(-d2 / 512.0)).alias("w"))
