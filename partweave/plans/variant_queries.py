"""Inference variants, validation, path maps, library edits, vectors of features."""

from __future__ import annotations

from pyspark.sql import functions as F

from partweave.operators import clustering as cl
from partweave.operators import graphs as gr
from partweave.operators import inference as inf
from partweave.operators import variants as va
from partweave.operators.ranges import window_join
from partweave.plans.inference_queries import ALL, CAND, RESP
from partweave.plans.library_queries import PATHS, _path_maps
from partweave.plans.registry import query, r6, rounded
from partweave.sources import projections as p
from partweave.sources.projections import with_library, with_views

SLID = (
    CAND
    + """, slid AS (SELECT DISTINCT part, idx, sub_m, CAST(round(dx * f) AS INT) AS dx, CAST(round(dy * f) AS INT) AS dy FROM lib_sub, (SELECT unnest([0.75, 1.0, 1.25]) AS f)),
  found AS (SELECT c.image_id, c.cand_id, c.part, s.idx, n.node_id AS sub_id, n.r * k.w AS v FROM cand c JOIN slid s ON c.part = s.part CROSS JOIN kernel k
  JOIN nodes n ON n.image_id = c.image_id AND n.x = c.x + s.dx + k.i AND n.y = c.y + s.dy + k.j AND n.m = s.sub_m WHERE n.r * k.w > 0.1)"""
)


def _cand(spark, d):
    nodes = p.nodes(spark, d)
    return nodes, inf.candidates(nodes, p.lib_center(spark), 0.2, 0.2)


@query(with_views(SLID + " SELECT cand_id, part, idx, sub_id, round(v, 6) AS v FROM (SELECT *, row_number() OVER (PARTITION BY cand_id, part, idx ORDER BY v DESC, sub_id) AS rn FROM found) WHERE rn = 1", *ALL))
def sliding_subparts(spark, d):
    nodes, cand = _cand(spark, d)
    found = va.sliding_matches(cand, nodes, p.lib_sub(spark), p.kernel(spark), 0.1, [0.75, 1.0, 1.25])
    return rounded(found.select("cand_id", "part", "idx", "sub_id", "v"), "v")


@query(
    with_views(
        CAND + """ SELECT c.cand_id, c.part, s.idx, count(*) AS n, round(max(n.r * k.w), 6) AS best FROM cand c JOIN lib_sub s ON c.part = s.part CROSS JOIN kernel k
        JOIN nodes n ON n.image_id = c.image_id AND n.x = c.x + k.i AND n.y = c.y + k.j AND n.m = s.sub_m WHERE n.r * k.w > 0.1 GROUP BY 1, 2, 3""",
        *ALL,
    )
)
def centred_subparts(spark, d):
    nodes, cand = _cand(spark, d)
    found = va.centred_matches(cand, nodes, p.lib_sub(spark), p.kernel(spark), 0.1)
    return found.groupBy("image_id", "cand_id", "part", "idx").agg(F.count(F.lit(1)).alias("n"), r6(F.max("v")).alias("best")).drop("image_id")


@query(with_views(RESP + " SELECT m, count(*) AS n, round(avg(r), 6) AS mean_r, round(avg(g), 6) AS mean_g FROM resp WHERE m = 0 GROUP BY m", *ALL))
def one_part_responses(spark, d):
    """Inference of a single part, of the candidates on."""
    nodes = p.nodes(spark, d)
    cand = inf.candidates(nodes, p.lib_center(spark), 0.2, 0.2, allowed=[0])
    found = inf.best_matches(inf.matches(cand, nodes, p.lib_sub(spark), p.kernel(spark), 0.1))
    return inf.responses(cand, found).groupBy("m").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r")).alias("mean_r"), r6(F.avg("g")).alias("mean_g"))


@query(with_views("SELECT u.z AS z, count(*) AS n, CAST(count_if(e.node_id * 16 + 1 = u.id) AS BIGINT) AS n_same FROM (SELECT node_id * 16 + 1 AS id, 1 AS z FROM nodes) u JOIN nodes e ON e.node_id * 16 + 1 = u.id GROUP BY u.z", "nodes"))
def copied_layers(spark, d):
    up, edges = va.copied_layer(p.nodes(spark, d))
    met = up.join(edges, up["node_id"] == edges["src"])
    return met.groupBy(up["z"]).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("dst") * 16 + 1 == F.col("src")).alias("n_same"))


@query(with_views("SELECT DISTINCT dst AS node FROM edges WHERE z = 2 AND dst NOT IN (SELECT src FROM edges WHERE z = 1)", "edges"))
def nodes_without_links(spark, d):
    """Orders without lines."""
    edges = p.edges(spark, d)
    return va.without_link(edges.where("z = 2").select(F.col("dst").alias("node")).distinct(), edges.where("z = 1"), "toPrev")


@query(with_views("SELECT DISTINCT dst AS leaf, z - 1 AS z FROM edges WHERE z > 1 AND dst NOT IN (SELECT src FROM edges)", "edges"))
def leaves_above_the_lowest_layer(spark, d):
    return va.leaves_off_layer(p.edges(spark, d))


@query(
    with_views(
        """WITH c AS (SELECT a.node_id, max(b.r) AS most FROM nodes a JOIN nodes b ON a.image_id = b.image_id AND a.m = b.m AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2 AND a.node_id <> b.node_id AND b.g > a.g GROUP BY 1)
        SELECT n.node_id, least(r, coalesce(most, r)) AS r FROM nodes n LEFT JOIN c USING (node_id)""",
        "nodes",
    )
)
def overridden_responses(spark, d):
    nodes = p.nodes(spark, d)
    met = window_join(nodes.select("image_id", "m", "x", "y", "g", "node_id"), nodes.select("image_id", "m", "x", "y", "g", "r", "node_id"), ["image_id", "m"], 2, 2)
    covers = met.where("node_id <> o_node_id AND o_g > g").select("node_id", F.col("o_r").alias("r"))
    return va.overridden(nodes, covers).select("node_id", "r")


@query(with_views(f"SELECT node, path, CAST((x + 1) * 0.5 AS DOUBLE) AS x, CAST((y - 2) * 0.5 AS DOUBLE) AS y FROM ({PATHS})", "edges", "leaf_points"))
def transformed_paths(spark, d):
    return rounded(va.transformed_paths(_path_maps(spark, d).select("node", "path", "x", "y"), 1, -2, 0.5), "x", "y")


@query(
    with_views(
        f"""WITH p AS ({PATHS}), s AS (SELECT node, r, first(path ORDER BY path) AS path, count(*) AS c FROM p, (SELECT unnest([2, 6, 12]) AS r) GROUP BY node, r, floor(x / (2.0 * r + 1)), floor(y / (2.0 * r + 1))),
        n AS (SELECT node, r, count(*) AS n FROM s GROUP BY node, r), chosen AS (SELECT node, coalesce(min(CASE WHEN n <= 4 THEN r END), 12) AS r FROM n GROUP BY node)
        SELECT s.node, s.path, CAST(s.r AS INT) AS radius FROM s JOIN chosen c ON c.node = s.node AND c.r = s.r""",
        "edges",
        "leaf_points",
    )
)
def thinned_paths(spark, d):
    maps = _path_maps(spark, d).select("node", "path", "x", "y")
    return va.thinned_paths(maps, ["node"], [2, 6, 12], 4).select("node", "path", "radius")


LIST = [(8, 8), (32, 40), (60, 12), (20, 60)]


@query(
    with_views(
        f"""WITH l AS (SELECT * FROM (VALUES {', '.join(str((k, x, y)) for k, (x, y) in enumerate(LIST))}) t(k, lx, ly))
        SELECT node_id, CAST(arg_min(k, ((x - lx) * (x - lx) + (y - ly) * (y - ly), k)) AS INT) AS nearest FROM nodes, l GROUP BY node_id""",
        "nodes",
    )
)
def nearest_listed_points(spark, d):
    nodes = p.nodes(spark, d)
    return nodes.select("node_id", va.nearest_listed(nodes, LIST).alias("nearest"))


@query(with_views("SELECT node_id, CASE WHEN a >= 90 THEN 'up' WHEN a >= 0 THEN 'right' WHEN a >= -90 THEN 'down' ELSE 'left' END AS side FROM (SELECT node_id, degrees(atan2(y - 31.5, x - 31.5)) AS a FROM nodes)", "nodes"))
def angle_classes(spark, d):
    angle = F.degrees(F.atan2(F.col("y") - 31.5, F.col("x") - 31.5))
    return p.nodes(spark, d).select("node_id", va.angle_classes(angle, [(-180.0, "left"), (-90.0, "down"), (0.0, "right"), (90.0, "up")]).alias("side"))


@query(
    with_library(
        """WITH more AS (SELECT part, sub_m, -dx AS dx, -dy AS dy FROM lib_sub WHERE idx = 1), last AS (SELECT part, max(idx) AS last FROM lib_sub GROUP BY part)
        SELECT part, idx, sub_m, dx, dy FROM lib_sub UNION ALL SELECT m.part, CAST(last + row_number() OVER (PARTITION BY m.part ORDER BY sub_m, dx, dy) AS INT), sub_m, dx, dy FROM more m JOIN last l ON l.part = m.part"""
    )
)
def extended_parts(spark, d):
    sub = p.part_sub(spark, d)
    more = sub.where("idx = 1").select("part", "sub_m", (-F.col("dx")).alias("dx"), (-F.col("dy")).alias("dy"))
    return va.extended_parts(sub, more)


@query(
    with_views(
        """WITH s AS (SELECT image_id, m, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM nodes GROUP BY image_id, m),
        t AS (SELECT *, (a + c) / 2 AS half, sqrt((a - c) * (a - c) / 4 + b * b) AS root FROM s)
        SELECT image_id, m, CAST(n AS DOUBLE) AS n, round(mx, 4) AS mx, round(CASE WHEN half + root > 0 THEN (half - root) / (half + root) ELSE 1 END, 4) AS ratio FROM t""",
        "nodes",
    )
)
def ellipse_vectors(spark, d):
    v = va.feature_vectors(p.nodes(spark, d), ["image_id", "m"])
    return v.select("image_id", "m", F.col("v")[0].alias("n"), F.round(F.col("v")[1], 4).alias("mx"), F.round(F.col("v")[3], 4).alias("ratio"))


@query()
def subspace_distances(spark, d):
    """Squared distances to the plane of the two main axes; tests compare with numpy."""
    hist = p.histograms(spark, d)
    mean, _, axes = cl.principal_axes(hist, "h", 2)
    found = va.subspace_distances(hist.select("vec_id", "h"), mean.tolist(), axes.T.tolist())
    return found.select("vec_id", F.round("d2", 9).alias("d2"))


@query(
    with_views(
        """WITH gone AS (SELECT DISTINCT dst AS node FROM edges WHERE z = 3 AND src % 4 = 1), below AS (SELECT DISTINCT e.dst AS node FROM edges e JOIN gone g ON g.node = e.src WHERE e.z = 2),
        last AS (SELECT DISTINCT e.dst AS node FROM edges e JOIN below b ON b.node = e.src WHERE e.z = 1)
        SELECT z, count(*) AS n FROM edges WHERE dst NOT IN (SELECT node FROM gone UNION SELECT node FROM below UNION SELECT node FROM last)
        AND src NOT IN (SELECT node FROM gone UNION SELECT node FROM below) GROUP BY z""",
        "edges",
    )
)
def cascading_deletes(spark, d):
    """Deleted nodes take everything below them along."""
    edges = p.edges(spark, d)
    roots = edges.where("z = 3 AND src % 4 = 1").select(F.col("dst").alias("node")).distinct()
    gone = gr.closure(edges, roots).select(F.col("reached").alias("node")).distinct()
    return gr.without_nodes(edges, gone).groupBy("z").agg(F.count(F.lit(1)).alias("n"))


@query(
    with_views(
        """WITH reach AS (SELECT DISTINCT src AS node, src AS reached FROM edges WHERE z = 3 UNION SELECT r.node, e.dst FROM reach r JOIN edges e ON e.src = r.reached AND e.dst % 20 < 10)
        SELECT node, count(*) AS n FROM reach GROUP BY node""",
        "edges",
        recursive=True,
    )
)
def selected_closures(spark, d):
    """Closures over the neighbours that a condition selects."""
    edges = p.edges(spark, d)
    start = edges.where("z = 3").select(F.col("src").alias("node")).distinct()
    return gr.closure(edges, start, expand=F.col("dst") % 20 < 10).groupBy("node").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("SELECT DISTINCT image_id, m, y * 64 + x AS position FROM nodes WHERE g >= 0.97", "nodes"))
def positions_of_types(spark, d):
    return p.nodes(spark, d).where("g >= 0.97").select("image_id", "m", (F.col("y") * 64 + F.col("x")).alias("position")).distinct()


@query(
    with_views(
        """WITH s AS (SELECT image_id, m, list_distinct(list(y // 8 * 8 + x // 8)) AS cells FROM nodes GROUP BY image_id, m)
        SELECT a.image_id, a.m, round(max(len(list_intersect(a.cells, b.cells)) * 1.0 / len(b.cells)), 6) AS overlap FROM s a JOIN s b ON a.image_id = b.image_id AND a.m <> b.m GROUP BY 1, 2""",
        "nodes",
    )
)
def largest_overlaps(spark, d):
    """Per image and type the largest share of another type's cells that it holds."""
    sets = p.nodes(spark, d).groupBy("image_id", "m").agg(F.collect_set(F.expr("y DIV 8 * 8 + x DIV 8")).alias("a"))
    other = sets.select("image_id", F.col("m").alias("o"), F.col("a").alias("b"))
    share = F.size(F.array_intersect("a", "b")) / F.size("b")
    return sets.join(other, "image_id").where("m <> o").groupBy("image_id", "m").agg(r6(F.max(share)).alias("overlap"))


@query(
    with_views(
        """SELECT image_id, m, CAST(round(x * cos(1.0) - y * sin(1.0)) AS INT) AS x, CAST(round(x * sin(1.0) + y * cos(1.0)) AS INT) AS y, count(*) AS n FROM (
        SELECT image_id, m, x - 32 AS x, y - 32 AS y FROM nodes) GROUP BY ALL""",
        "nodes",
    )
)
def rotated_cells(spark, d):
    """Cells turned by a radian around the middle; some fall together."""
    from partweave.functions import geometry as geo

    x, y = geo.rotate(F.col("x") - 32, F.col("y") - 32, F.lit(1.0))
    turned = p.nodes(spark, d).select("image_id", "m", F.round(x).cast("int").alias("x"), F.round(y).cast("int").alias("y"))
    return turned.groupBy("image_id", "m", "x", "y").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("SELECT node_id, CAST(m AS INT) AS m, r FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY r DESC, node_id) AS rn FROM nodes) WHERE rn <= 5", "nodes"))
def top_nodes(spark, d):
    """Each image's five best nodes."""
    from partweave.operators.suppression import top_k

    return top_k(p.nodes(spark, d), ["image_id"], 5, "r", "node_id").select("node_id", "m", "r")


@query(with_views("SELECT DISTINCT m AS part, 'type' || m AS name, CAST(count(*) AS BIGINT) AS n FROM nodes GROUP BY m", "nodes"))
def layer_vocabulary(spark, d):
    """One row a feature type of layer 0."""
    return p.nodes(spark, d).groupBy(F.col("m").alias("part")).agg(F.concat(F.lit("type"), F.first("m").cast("string")).alias("name"), F.count(F.lit(1)).alias("n"))


@query(
    with_views(
        "SELECT b.box_id FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM nodes n WHERE n.image_id = b.image_id AND n.m = 3 AND n.x >= b.llx AND n.x < b.urx AND n.y >= b.lly AND n.y < b.ury)", "boxes", "nodes"
    )
)
def boxes_without_type(spark, d):
    """Boxes that hold no node of a forbidden type."""
    from partweave.operators.cells import cropped

    boxes = p.boxes(spark, d)
    hit = cropped(p.nodes(spark, d).where("m = 3").select("image_id", "node_id", "x", "y"), boxes, "box_id").select("box_id").distinct()
    return boxes.join(hit, "box_id", "left_anti").select("box_id")
