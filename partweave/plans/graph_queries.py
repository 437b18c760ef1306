"""Part graphs, supports, coverage, library graph edits, exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from partweave.operators import graphs as gr
from partweave.operators.ordering import numbered
from partweave.plans.registry import query, r6, rounded
from partweave.sources import projections as p
from partweave.sources import sinks
from partweave.sources.projections import with_views

LEAVES = """WITH found AS (SELECT z, src AS node, dst AS leaf FROM edges WHERE z = 1
  UNION SELECT e.z, e.src, f.leaf FROM found f JOIN edges e ON e.dst = f.node)"""


def _leaves(spark, d, layers=4):
    return gr.layered_leaves(p.edges(spark, d), layers)


@query(with_views(LEAVES + " SELECT z, node, count(*) AS n_leaves FROM found GROUP BY z, node", "edges", recursive=True))
def support_sizes(spark, d):
    return _leaves(spark, d).groupBy("z", "node").agg(F.count(F.lit(1)).alias("n_leaves"))


@query(
    with_views(
        LEAVES + """ SELECT node, min(x) AS llx, min(y) AS lly, max(x) AS urx, max(y) AS ury, count(*) AS n_leaves FROM found JOIN leaf_points USING (leaf) WHERE z <= 2 GROUP BY node""",
        "edges",
        "leaf_points",
        recursive=True,
    )
)
def support_boxes(spark, d):
    return gr.support_boxes(_leaves(spark, d, 2).select("node", "leaf"), p.leaf_points(spark, d))


@query(
    with_views(
        """WITH reach AS (SELECT DISTINCT src AS node, src AS reached, 0 AS dist FROM edges WHERE z = 4
          UNION SELECT r.node, e.dst, r.dist + 1 FROM reach r JOIN edges e ON e.src = r.reached)
        SELECT node, dist, count(*) AS n FROM reach GROUP BY node, dist""",
        "edges",
        recursive=True,
    )
)
def closure_levels(spark, d):
    edges = p.edges(spark, d)
    start = edges.where("z = 4").select(F.col("src").alias("node")).distinct()
    return gr.closure(edges, start, depth=4).groupBy("node", "dist").agg(F.count(F.lit(1)).alias("n"))


@query(
    with_views(
        """WITH reach AS (SELECT DISTINCT src AS node, src AS reached FROM edges WHERE z = 3
          UNION SELECT r.node, e.dst FROM reach r JOIN edges e ON e.src = r.reached)
        SELECT node, count(*) AS n_ends FROM reach WHERE reached NOT IN (SELECT src FROM edges) GROUP BY node""",
        "edges",
        recursive=True,
    )
)
def closure_ends(spark, d):
    edges = p.edges(spark, d)
    start = edges.where("z = 3").select(F.col("src").alias("node")).distinct()
    return gr.leaves(edges, gr.closure(edges, start, depth=3)).groupBy("node").agg(F.count(F.lit(1)).alias("n_ends"))


@query(
    with_views(
        "SELECT round(avg(CASE WHEN e.dst IS NULL THEN 0 ELSE 1 END), 6) AS covered_share, count(*) AS n_nodes FROM leaf_points l LEFT JOIN (SELECT DISTINCT dst FROM edges) e ON e.dst = l.leaf",
        "edges",
        "leaf_points",
    )
)
def layer_coverage(spark, d):
    nodes = p.leaf_points(spark, d).select(F.col("leaf").alias("node"))
    return rounded(gr.coverage(p.edges(spark, d), nodes), "covered_share")


@query(
    with_views(
        LEAVES + """, ranks AS (SELECT node, row_number() OVER (ORDER BY count(*) DESC, node) AS rank FROM found WHERE z = 3 GROUP BY node),
        first AS (SELECT leaf, min(rank) AS rank FROM found JOIN ranks USING (node) GROUP BY leaf)
        SELECT rank, CAST(sum(count(*)) OVER (ORDER BY rank) AS BIGINT) AS covered FROM first GROUP BY rank""",
        "edges",
        recursive=True,
    )
)
def cumulative_coverage(spark, d):
    support = _leaves(spark, d, 3).where("z = 3").select("node", "leaf")
    sizes = support.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    ranks = numbered(sizes, [], [F.desc("n"), "node"]).select("node", "rank")
    return gr.cumulative_coverage(support, ranks)


@query(with_views("SELECT coalesce(o.node, i.node) AS node, coalesce(n_out, 0) AS n_out, coalesce(n_in, 0) AS n_in FROM (SELECT src AS node, count(*) AS n_out FROM edges GROUP BY src) o FULL JOIN (SELECT dst AS node, count(*) AS n_in FROM edges GROUP BY dst) i ON o.node = i.node", "edges"))
def node_degrees(spark, d):
    return gr.degrees(p.edges(spark, d))


@query(with_views("SELECT name, z, count(*) AS n FROM (SELECT src, dst, name, z FROM edges UNION ALL SELECT dst, src, 'toNext', z FROM edges) GROUP BY name, z", "edges"))
def inverse_edges(spark, d):
    return gr.inverse(p.edges(spark, d), "toNext").groupBy("name", "z").agg(F.count(F.lit(1)).alias("n"))


@query(with_views("SELECT src, dst, CASE WHEN name = 'toPrev' THEN 'subpart' ELSE name END AS name, z FROM edges WHERE z >= 2", "edges"))
def renamed_edges(spark, d):
    return gr.renamed(p.edges(spark, d).where("z >= 2"), "toPrev", "subpart")


@query(with_views("SELECT src, dst, z FROM edges WHERE src NOT IN (SELECT leaf FROM leaf_points WHERE m = 6) AND dst NOT IN (SELECT leaf FROM leaf_points WHERE m = 6)", "edges", "leaf_points"))
def edges_without_nodes(spark, d):
    gone = p.leaf_points(spark, d).where("m = 6").select(F.col("leaf").alias("node"))
    return gr.without_nodes(p.edges(spark, d), gone).select("src", "dst", "z")


@query(with_views("SELECT src, dst, z FROM edges WHERE src % 2 = 1 AND dst IN (SELECT leaf FROM leaf_points WHERE x < 32)", "edges", "leaf_points"))
def induced_edges(spark, d):
    edges = p.edges(spark, d)
    kept = p.leaf_points(spark, d).where("x < 32").select(F.col("leaf").alias("node")).unionByName(edges.where("src % 2 = 1").select(F.col("src").alias("node")))
    ends = gr.induced(edges.where("z = 1"), kept)
    return ends.select("src", "dst", "z")


@query(with_views("SELECT z, src, dst, CAST(row_number() OVER (PARTITION BY z ORDER BY src, dst) - 1 AS INT) AS dense_id FROM edges WHERE z >= 2", "edges"))
def dense_edge_ids(spark, d):
    return gr.dense_ids(p.edges(spark, d).where("z >= 2"), ["z"], ["src", "dst"]).select("z", "src", "dst", F.col("dense_id").cast("int").alias("dense_id"))


@query(with_views("SELECT DISTINCT z AS z_src, name, z - 1 AS z_dst FROM edges", "edges"))
def edge_triples(spark, d):
    edges = p.edges(spark, d)
    layers = edges.select(F.col("src").alias("node"), "z").unionByName(edges.select(F.col("dst").alias("node"), (F.col("z") - 1).alias("z"))).distinct()
    return sinks.edge_triples(edges, layers)


@query(
    with_views(
        """SELECT image_id, string_agg(llx || ' ' || lly || ' ' || urx || ' ' || ury || ' ' || label, chr(10) ORDER BY gt_id) AS text FROM gt GROUP BY image_id""",
        "gt",
    )
)
def truth_text(spark, d):
    return sinks.truth_lines(p.ground_truth(spark, d))


@query(
    with_views(
        """SELECT e.src AS node, string_agg(l.x || ',' || l.y, ',' ORDER BY l.x, l.y) AS line FROM edges e JOIN leaf_points l ON e.dst = l.leaf WHERE e.z = 1 GROUP BY e.src""",
        "edges",
        "leaf_points",
    )
)
def support_lines(spark, d):
    support = _leaves(spark, d, 1).select("node", "leaf")
    nodes = support.select("node").distinct().withColumns({c: F.lit(None).cast("double") for c in ("m", "r", "rr", "g")})
    return sinks.node_lines(nodes, support, p.leaf_points(spark, d))


@query(
    with_views(
        LEAVES + """ SELECT z, round(avg(n), 6) AS mean_leaves, max(n) AS max_leaves FROM (SELECT z, node, count(*) AS n FROM found GROUP BY z, node) GROUP BY z""",
        "edges",
        recursive=True,
    )
)
def layer_support_statistics(spark, d):
    sizes = _leaves(spark, d).groupBy("z", "node").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("z").agg(r6(F.avg("n")).alias("mean_leaves"), F.max("n").alias("max_leaves"))


@query(
    with_views(
        """SELECT a.src AS node, b.dst AS leaf, 'path' || a.k || '.' || b.k AS path FROM
        (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM edges WHERE z = 2) a JOIN (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst) AS k FROM edges WHERE z = 1) b ON b.src = a.dst""",
        "edges",
    )
)
def leaf_paths(spark, d):
    edges = gr.dense_ids(p.edges(spark, d), ["src"], ["dst"]).withColumn("idx", (F.col("dense_id") + 1).cast("int"))
    start = edges.where("z = 2").select(F.col("src").alias("node")).distinct()
    found = gr.edge_paths(edges.where("z <= 2"), start, 2).where("size(path) = 2")
    return found.select("node", F.col("reached").alias("leaf"), F.concat(F.lit("path"), F.array_join(F.col("path").cast("array<string>"), ".")).alias("path"))


@query()
def spanning_trees(spark, d):
    """Prim's rule has no SQL form; tests compare with Kruskal's."""
    return gr.spanning_trees(p.nodes(spark, d), ["image_id", "m"])


@query()
def neighbour_cliques(spark, d):
    """Maximal cliques have no SQL form; tests compare with all subsets."""
    from partweave.operators.ranges import window_join

    nodes = p.nodes(spark, d).select("image_id", "m", "x", "y", "node_id")
    met = window_join(nodes, nodes, ["image_id", "m"], 4, 4).where("node_id < o_node_id")
    return gr.cliques(met.select("image_id", "m", F.col("node_id").alias("a"), F.col("o_node_id").alias("b")), ["image_id", "m"])
