"""Library tables, object layers, path maps and further geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from partweave.functions import geometry as geo
from partweave.operators import graphs as gr
from partweave.operators import inference as inf
from partweave.operators import library as lb
from partweave.operators import objects as ob
from partweave.operators import paths as pt
from partweave.plans.inference_queries import ALL, BEST, CAND
from partweave.plans.registry import query, r6, rounded
from partweave.sources import projections as p
from partweave.sources.projections import with_library, with_views

LIB = ("lib_center", "lib_sub")


@query(with_library("SELECT c.part, c.center_m || coalesce('|' || (SELECT string_agg(sub_m || ':' || dx || ':' || dy, '|' ORDER BY idx) FROM lib_sub s WHERE s.part = c.part), '') AS structure FROM lib_center c"))
def part_structures(spark, d):
    return lb.structures(p.part_center(spark, d), p.part_sub(spark, d))


@query(with_library("SELECT DISTINCT part, dx, dy, unnest([sub_m, (sub_m + 3) % 6]) AS m FROM lib_sub"))
def similar_offsets(spark, d):
    sub = p.part_sub(spark, d)
    similar = sub.select(F.col("sub_m").alias("m"), ((F.col("sub_m") + 3) % 6).alias("other")).distinct()
    return lb.similar_offsets(sub, similar)


@query("SELECT n_nationkey AS m, n_nationkey // 4 * 4 AS root, CAST(CASE WHEN n_nationkey % 4 = 0 THEN n_nationkey // 4 ELSE -1 END AS INT) AS number FROM nation")
def dense_roots(spark, d):
    roots = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("m"), F.expr("CAST(n_nationkey DIV 4 * 4 AS INT)").alias("root"))
    return lb.dense_roots(roots)


USES = "uses AS (SELECT part, center_m AS m FROM lib_center UNION ALL SELECT part, sub_m FROM lib_sub)"


@query(
    with_library(
        f"""WITH {USES}, one AS (SELECT part AS m, count(*) AS n FROM uses GROUP BY part), two AS (SELECT u.part AS m, sum(coalesce(o.n, 1)) AS n FROM uses u LEFT JOIN one o USING (m) GROUP BY u.part)
        SELECT CAST(m AS INT) AS part, CAST(n AS BIGINT) AS n FROM two"""
    )
)
def part_leaf_counts(spark, d):
    return lb.part_leaves(p.part_center(spark, d), p.part_sub(spark, d), 2)


MASKS = """WITH uses AS (SELECT part, center_m AS m, 0 AS dx, 0 AS dy FROM lib_center UNION ALL SELECT part, sub_m, dx, dy FROM lib_sub),
one AS (SELECT part AS m, f.x + dx AS x, f.y + dy AS y, max(v) AS v FROM uses u JOIN masks f USING (m) GROUP BY 1, 2, 3),
two AS (SELECT part, o.x + 2 * dx AS x, o.y + 2 * dy AS y, max(v) AS v FROM uses u JOIN one o USING (m) GROUP BY 1, 2, 3)"""


def _masks(spark, d):
    return lb.masks(p.part_center(spark, d), p.part_sub(spark, d), p.type_masks(spark, d), 2, contraction=2)


@query(with_library(MASKS + " SELECT part, CAST(x AS INT) AS x, CAST(y AS INT) AS y, round(v, 6) AS v FROM two"))
def part_masks(spark, d):
    return rounded(_masks(spark, d), "v")


@query(with_library(MASKS + " SELECT part, count(*) AS n_cells, round(avg(x), 6) AS mx, round(avg(y), 6) AS my FROM two WHERE v >= 0.5 GROUP BY part"))
def part_regions(spark, d):
    return rounded(lb.regions(_masks(spark, d), 0.5), "mx", "my")


@query(
    with_library(
        MASKS + """, c AS (SELECT part, list(DISTINCT x * 1000 + y ORDER BY x * 1000 + y) AS cells FROM two WHERE v >= 0.5 GROUP BY part)
        SELECT part, min(part) OVER (PARTITION BY cells) AS same_as FROM c"""
    )
)
def equal_part_regions(spark, d):
    return lb.equal_regions(_masks(spark, d), 0.5)


@query(with_library("SELECT c.part, CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END AS name FROM lib_center c JOIN part ON c.part = p_partkey"))
def category_names(spark, d):
    names = spark.read.parquet(f"{d}/part.parquet").where("p_size % 2 = 0").select(F.col("p_partkey").cast("int").alias("m"), F.col("p_brand").alias("name"))
    return lb.category_names(p.part_center(spark, d), names)


VARIANTS = "(VALUES (0.8), (1.0), (1.2)) AS f(f), (VALUES (0, 0), (1, 0), (0, 1)) AS s(sx, sy)"
OBJECTS = (
    CAND
    + f""", found AS (SELECT c.image_id, c.cand_id, c.part, CAST(f.f AS DOUBLE) AS f, s.sx, s.sy, l.idx, n.r FROM cand c JOIN lib_sub l ON c.part = l.part, {VARIANTS}, nodes n
  WHERE n.image_id = c.image_id AND n.m = l.sub_m AND n.x = c.x + CAST(round(l.dx * CAST(f.f AS DOUBLE)) AS INT) + s.sx AND n.y = c.y + CAST(round(l.dy * CAST(f.f AS DOUBLE)) AS INT) + s.sy),
per AS (SELECT cand_id, part, f, sx, sy, count(*) AS n, sum(r) AS sum_r FROM found GROUP BY ALL),
scored AS (SELECT c.image_id, c.cand_id, c.part, c.x, c.y, p.f, p.sx, p.sy, p.n, p.n + 1 AS part_count, (p.sum_r + c.r_c) / (p.n + 1) AS r FROM cand c JOIN per p USING (cand_id, part)
  JOIN (SELECT part, count(*) AS n_sub FROM lib_sub GROUP BY part) k USING (part) WHERE p.n * 1.0 / n_sub >= 0.5),
obj AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cand_id, part ORDER BY n DESC, round(r, 9) DESC, f, sx, sy) AS k FROM scored) WHERE k = 1)"""
)


def _objects(spark, d):
    nodes, sub = p.nodes(spark, d), p.lib_sub(spark)
    cand = inf.candidates(nodes, p.lib_center(spark), 0.2, 0.2)
    found = ob.scaled_matches(cand, nodes, sub, [0.8, 1.0, 1.2], [(0, 0), (1, 0), (0, 1)])
    return ob.infer_objects(cand, found, 0.5, sub.groupBy("part").agg(F.count(F.lit(1)).alias("n_sub")))


@query(with_views(OBJECTS + " SELECT image_id, cand_id, part, x, y, f, sx, sy, part_count, round(r, 6) AS r FROM obj", "nodes", *LIB))
def object_layer(spark, d):
    return rounded(_objects(spark, d), "r")


@query(
    with_views(
        OBJECTS + """ SELECT cand_id, part FROM obj a WHERE NOT EXISTS (SELECT 1 FROM obj b WHERE a.image_id = b.image_id AND a.part = b.part AND abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 4
        AND (round(b.r, 9) > round(a.r, 9) OR (round(b.r, 9) = round(a.r, 9) AND b.cand_id < a.cand_id)))""",
        "nodes",
        *LIB,
    )
)
def separate_objects(spark, d):
    return ob.apart(_objects(spark, d), 4).select("cand_id", "part")


@query(
    with_views(
        BEST + """, asked AS (SELECT c.image_id, c.cand_id, c.part, l.idx, l.sub_m, c.x + l.dx AS x, c.y + l.dy AS y FROM cand c JOIN lib_sub l ON c.part = l.part),
        gone AS (SELECT * FROM asked a WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.cand_id = a.cand_id AND b.part = a.part AND b.idx = a.idx)),
        few AS (SELECT g.cand_id, g.part FROM (SELECT cand_id, part, count(*) AS g FROM gone GROUP BY 1, 2) g JOIN (SELECT cand_id, part, count(*) AS n FROM asked GROUP BY 1, 2) t
          ON g.cand_id = t.cand_id AND g.part = t.part WHERE g.g * 1.0 / t.n <= 0.5)
        SELECT image_id, x, y, sub_m AS m, count(*) AS votes FROM gone JOIN few USING (cand_id, part) GROUP BY 1, 2, 3, 4""",
        *ALL,
    )
)
def hypothetical_nodes(spark, d):
    nodes, sub = p.nodes(spark, d), p.lib_sub(spark)
    cand = inf.candidates(nodes, p.lib_center(spark), 0.2, 0.2)
    best = inf.best_matches(inf.matches(cand, nodes, sub, p.kernel(spark), 0.1))
    return ob.missing_subparts(cand, best, sub, 0.5)


@query(
    with_views(
        """WITH met AS (SELECT a.node_id, b.node_id AS near_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM nodes a JOIN nodes b
          ON a.image_id = b.image_id AND a.m = b.m AND abs(a.x - b.x) <= 8 AND abs(a.y - b.y) <= 8)
        SELECT node_id, near_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY d2, near_id) AS rn FROM met WHERE d2 >= 9 AND d2 <= 64) WHERE rn = 1""",
        "nodes",
    )
)
def nearest_in_annulus(spark, d):
    return ob.nearest_in_annulus(p.nodes(spark, d), 3, 8)


@query(
    with_views(
        """SELECT a.node_id FROM nodes a WHERE NOT EXISTS (SELECT 1 FROM nodes b WHERE a.image_id = b.image_id AND a.m = b.m AND b.r > a.r
        AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 AND NOT (a.x = b.x AND a.y = b.y)
        AND CASE a.m % 4 WHEN 0 THEN b.y = a.y WHEN 1 THEN b.x - a.x = b.y - a.y WHEN 2 THEN b.x = a.x ELSE b.x - a.x = a.y - b.y END)""",
        "nodes",
    )
)
def directional_maxima(spark, d):
    nodes = p.nodes(spark, d)
    kept = ob.directional_maxima(nodes.select("image_id", "m", "x", "y", F.col("r").alias("v")))
    return kept.join(nodes.select("image_id", "m", "x", "y", "node_id"), ["image_id", "m", "x", "y"]).select("node_id")


PATHS = "SELECT e.src AS node, CAST(row_number() OVER (PARTITION BY e.src ORDER BY e.dst) AS VARCHAR) AS path, l.x, l.y FROM edges e JOIN leaf_points l ON e.dst = l.leaf WHERE e.z = 1"


def _path_maps(spark, d):
    edges = gr.dense_ids(p.edges(spark, d).where("z = 1"), ["src"], ["dst"])
    return edges.join(p.leaf_points(spark, d), F.col("dst") == F.col("leaf")).select(
        F.col("src").alias("node"), (F.col("dense_id") + 1).cast("string").alias("path"), "x", "y"
    )


@query(with_views(f"SELECT '3.' || path AS path, round(avg(x), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM ({PATHS}) GROUP BY path", "edges", "leaf_points"))
def mean_path_maps(spark, d):
    return rounded(pt.under(pt.mean_paths(_path_maps(spark, d), []), 3), "x", "y")


@query(
    with_views(
        f"""WITH p AS ({PATHS}) SELECT a.node, count(b.path) AS n_matched, CAST(count_if(b.path IS NULL) AS BIGINT) AS n_unmatched, round(avg(b.x - a.x), 6) AS mean_dx, round(avg(b.y - a.y), 6) AS mean_dy,
        round(sum(CASE WHEN b.path IS NULL THEN NULL WHEN a.x + b.x + a.y + b.y = 0 THEN 0.0 ELSE
          (coalesce((a.x - b.x) * (a.x - b.x) * 1.0 / nullif(a.x + b.x, 0), 0) + coalesce((a.y - b.y) * (a.y - b.y) * 1.0 / nullif(a.y + b.y, 0), 0)) / 2 END), 6) AS chi
        FROM p a LEFT JOIN p b ON b.node = a.node AND a.path = CAST(CAST(b.path AS INT) - 1 AS VARCHAR) GROUP BY a.node""",
        "edges",
        "leaf_points",
    )
)
def matched_path_maps(spark, d):
    h = F.array(F.col("x").cast("double"), F.col("y").cast("double"))
    maps = _path_maps(spark, d).withColumn("h", h)
    moved = maps.withColumn("path", (F.col("path").cast("int") - 1).cast("string"))
    return rounded(pt.matched(maps, moved, "node"), "mean_dx", "mean_dy", "chi")


@query()
def longest_tree_paths(spark, d):
    """Longest paths of the spanning trees; tests compare with all pairs."""
    trees = gr.spanning_trees(p.nodes(spark, d), ["image_id", "m"])
    return pt.longest_paths(trees.select("image_id", "m", "a", "b"), ["image_id", "m"])


@query(
    with_views(
        """SELECT gt_id, CAST(i * 2 + j AS INT) AS k, llx + CAST(floor(i * (urx - llx) / 2.0) AS INT) AS t_llx, lly + CAST(floor((j + 1) * (ury - lly) / 2.0) AS INT) AS t_ury
        FROM gt, range(2) AS a(i), range(2) AS b(j)""",
        "gt",
    )
)
def rectangle_tiles(spark, d):
    rows = p.ground_truth(spark, d).select("gt_id", F.posexplode(geo.tiles(geo.columns_box(), 2, 2)).alias("k", "t"))
    return rows.select("gt_id", "k", F.col("t.llx").alias("t_llx"), F.col("t.ury").alias("t_ury"))


@query(
    with_views(
        """WITH s AS (SELECT image_id, m, avg(x) AS mx, avg(y) AS my, sqrt(var_pop(x) + var_pop(y)) AS norm FROM nodes GROUP BY image_id, m HAVING count(*) > 1)
        SELECT n.image_id, n.m, round(sum(abs(n.x - mx) / norm), 6) AS sum_x, round(sum(abs(n.y - my) / norm), 6) AS sum_y,
          round(atan2(sum((n.x - mx) * (n.x - mx) + (n.y - my) * (n.y - my)), sum(0.0)), 6) AS turn FROM nodes n JOIN s ON n.image_id = s.image_id AND n.m = s.m WHERE norm > 0 GROUP BY n.image_id, n.m""",
        "nodes",
    )
)
def normalised_point_sets(spark, d):
    """A set turned by a right angle is found at that angle."""
    sets = p.nodes(spark, d).groupBy("image_id", "m").agg(F.collect_list(F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))).alias("pts"))
    n = sets.where("size(pts) > 1").select("image_id", "m", geo.normalised_points(F.col("pts")).alias("n"))
    pairs = F.transform("n", lambda q: F.struct(q["x"].alias("x"), q["y"].alias("y"), (-q["y"]).alias("u"), q["x"].alias("v")))
    side = lambda c: F.aggregate("n", F.lit(0.0), lambda a, q: a + F.abs(q[c]))
    return n.select("image_id", "m", r6(side("x")).alias("sum_x"), r6(side("y")).alias("sum_y"), r6(geo.best_rotation(pairs)).alias("turn"))


@query(
    with_views(
        BEST + """, seen AS (SELECT b.part, b.idx, avg(n.x - c.x) AS mx, avg(n.y - c.y) AS my FROM best b JOIN cand c ON b.cand_id = c.cand_id AND b.part = c.part JOIN nodes n ON n.node_id = b.sub_id GROUP BY 1, 2)
        SELECT l.part, l.idx, l.sub_m, CAST(coalesce(round(mx), l.dx) AS INT) AS dx, CAST(coalesce(round(my), l.dy) AS INT) AS dy FROM lib_sub l LEFT JOIN seen s ON l.part = s.part AND l.idx = s.idx""",
        *ALL,
    )
)
def reestimated_library(spark, d):
    from partweave.operators import training

    nodes, sub = p.nodes(spark, d), p.lib_sub(spark)
    cand = inf.candidates(nodes, p.lib_center(spark), 0.2, 0.2)
    best = inf.best_matches(inf.matches(cand, nodes, sub, p.kernel(spark), 0.1))
    return training.reestimated(sub, best, cand, nodes)


@query()
def learned_layer(spark, d):
    """A learned library and its inference; tests plant a pattern and find it."""
    from partweave.operators import training

    center, sub, above = training.learn_layer(p.nodes(spark, d), p.kernel(spark), training.Settings())
    return above.groupBy("m").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("r")).alias("mean_r"))
