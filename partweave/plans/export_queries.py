"""Text exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from partweave.operators import evaluation as ev
from partweave.operators.ranges import window_join
from partweave.plans.registry import query
from partweave.plans.spatial_queries import _BEST
from partweave.sources import exports as ex
from partweave.sources import projections as p
from partweave.sources import text as tx
from partweave.sources.projections import with_library, with_views
from partweave.sources.scratch import new_path


@query(with_views("SELECT image_id, string_agg(z || ' ' || x || ' ' || y || ' ' || m || ' ' || printf('%.4f', r), chr(10) ORDER BY z, x, y, m) AS text FROM nodes GROUP BY image_id", "nodes"))
def node_dumps(spark, d):
    return ex.node_dump(p.nodes(spark, d))


@query(
    with_views(
        "SELECT image_id, string_agg('- {x: ' || x || ', y: ' || y || ', type: ' || m || ', r: ' || printf('%.4f', r) || '}', chr(10) ORDER BY z, x, y, m) AS text FROM nodes GROUP BY image_id",
        "nodes",
    )
)
def yaml_dumps(spark, d):
    return ex.yaml_nodes(p.nodes(spark, d))


NEAR = """WITH e AS (SELECT a.image_id, a.node_id AS a, b.node_id AS b FROM nodes a JOIN nodes b ON a.image_id = b.image_id AND a.m = b.m AND a.node_id < b.node_id
  AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3)"""


def _near_edges(spark, d):
    nodes = p.nodes(spark, d).select("image_id", "m", "x", "y", "node_id")
    met = window_join(nodes, nodes, ["image_id", "m"], 3, 3).where("node_id < o_node_id")
    return met.select("image_id", F.col("node_id").alias("a"), F.col("o_node_id").alias("b"))


@query(with_views(NEAR + " SELECT image_id, '{' || string_agg('{' || a || ',' || b || '}', ',' ORDER BY a, b) || '}' AS text FROM e GROUP BY image_id", "nodes"))
def edge_list_dumps(spark, d):
    return ex.edge_lists(_near_edges(spark, d), "image_id")


@query(
    with_views(
        NEAR + """, v AS (SELECT image_id, v, row_number() OVER (PARTITION BY image_id ORDER BY v) AS k FROM (SELECT image_id, a AS v FROM e UNION SELECT image_id, b FROM e)),
        vs AS (SELECT image_id, count(*) AS n, string_agg(k || ' "' || v || '"', chr(10) ORDER BY k) AS head FROM v GROUP BY image_id),
        es AS (SELECT e.image_id, string_agg(i.k || ' ' || j.k, chr(10) ORDER BY i.k, j.k) AS arcs FROM e JOIN v i ON i.image_id = e.image_id AND i.v = e.a JOIN v j ON j.image_id = e.image_id AND j.v = e.b GROUP BY 1)
        SELECT image_id, '*Vertices ' || n || chr(10) || head || chr(10) || '*Edges' || chr(10) || arcs AS text FROM vs JOIN es USING (image_id)""",
        "nodes",
    )
)
def network_dumps(spark, d):
    return ex.networks(_near_edges(spark, d), "image_id")


@query(
    with_views(
        """SELECT image_id, '{' || string_agg('{' || (urx - llx) * (ury - lly) || ',' || m || '}', ',' ORDER BY (urx - llx) * (ury - lly) DESC, m) || '}' AS text FROM gt GROUP BY image_id""", "gt"
    )
)
def area_lists(spark, d):
    return ex.area_lists(p.ground_truth(spark, d), "image_id")


@query(
    with_views(
        _BEST + """ SELECT m, CAST(count_if(best_iou >= 0.4) AS BIGINT) AS n_true, CAST(count_if(best_iou < 0.4) AS BIGINT) AS n_false, min(val) FILTER (WHERE best_iou >= 0.4) AS low_true,
        max(val) FILTER (WHERE best_iou < 0.4) AS high_false FROM best GROUP BY m""",
        "boxes",
        "gt",
    )
)
def confidence_vectors(spark, d):
    found = ev.best_iou(p.boxes(spark, d), p.ground_truth(spark, d), ["image_id", "m"])
    return ex.confidence_vectors(found.select("m", "val", (F.col("best_iou") >= 0.4).alias("hit")), "m")


@query(
    with_views(
        """SELECT gt_id, CAST(s AS INT) AS scale, CAST(floor(llx * pow(0.8, s)) + 10 AS INT) AS llx, CAST(floor(lly * pow(0.8, s)) + 10 AS INT) AS lly,
        CAST(floor(urx * pow(0.8, s)) + 10 AS INT) AS urx, CAST(floor(ury * pow(0.8, s)) + 10 AS INT) AS ury FROM gt, range(4) AS r(s)""",
        "gt",
    )
)
def scaled_annotations(spark, d):
    truth = p.ground_truth(spark, d).select("gt_id", F.col("llx").alias("x"), F.col("lly").alias("y"), (F.col("urx") - F.col("llx")).alias("w"), (F.col("ury") - F.col("lly")).alias("h"))
    return ex.scaled_annotations(truth, 0.8, 4, 10)


@query(with_views("SELECT image_id, " + ", ".join(f"CAST(count_if(m = {t}) AS BIGINT) AS m{t}" for t in range(7)) + " FROM nodes GROUP BY image_id", "nodes"))
def type_table(spark, d):
    return ex.type_table(p.nodes(spark, d), list(range(7)))


@query(
    with_library(
        """SELECT c.part, '{"part":' || c.part || ',"center_m":' || center_m || ',"bp":' || bp || ',"subparts":[' || coalesce((SELECT string_agg('{"idx":' || idx || ',"sub_m":' || sub_m || ',"dx":' || dx || ',"dy":' || dy || '}', ',' ORDER BY idx)
        FROM lib_sub s WHERE s.part = c.part), '') || ']}' AS json FROM lib_center c"""
    )
)
def part_json(spark, d):
    return ex.part_json(p.part_center(spark, d), p.part_sub(spark, d))


def _written(rows, name):
    """A one-column table as text below the shared folder."""
    path = new_path(rows.sparkSession, name)
    rows.write.text(path)
    return path


@query(with_views("SELECT CAST(gt_id AS VARCHAR) AS name, llx, lly, urx, ury, gt_id / 4.0 AS value FROM gt", "gt"))
def written_rectangles(spark, d):
    """A rectangle list, written and read."""
    line = F.concat_ws(" ", "gt_id", "llx", "lly", "urx", "ury", (F.col("gt_id") / 4.0))
    return tx.read_rectangles(spark, _written(p.ground_truth(spark, d).select(line), "rectangles"))


@query(with_views("SELECT CAST(image_id AS VARCHAR) AS name, CAST(row_number() OVER (PARTITION BY image_id ORDER BY gt_id) - 1 AS INT) AS k, llx AS x, lly AS y, urx - llx AS w, ury - lly AS h FROM gt", "gt"))
def written_annotations(spark, d):
    """Boxes by image, written and read."""
    box = F.concat_ws(" ", "llx", "lly", F.col("urx") - F.col("llx"), F.col("ury") - F.col("lly"))
    boxes = F.transform(F.array_sort(F.collect_list(F.struct("gt_id", box.alias("b")))), lambda s: s["b"])
    lines = p.ground_truth(spark, d).groupBy("image_id").agg(F.array_join(boxes, "; ").alias("b")).select(F.concat_ws(": ", "image_id", "b"))
    return tx.read_annotations(spark, _written(lines, "annotations"))


@query(with_views("SELECT CAST(round(sum(len(h))) AS BIGINT) AS n, count(*) AS n_rows, round(sum(list_sum(h)), 4) AS total FROM hist", "hist"))
def written_vectors(spark, d):
    """Vectors as lines of numbers, written and read."""
    lines = p.histograms(spark, d).select(F.array_join(F.col("h").cast("array<string>"), " "))
    read = tx.read_vectors(spark, _written(lines, "vectors"))
    total = F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    return read.agg(F.sum(F.size("v")).alias("n"), F.count(F.lit(1)).alias("n_rows"), F.round(F.sum(total), 4).alias("total"))


@query("SELECT stem, count(*) AS n FROM (SELECT replace(p_brand, '#', '') || '_' || p_size % 10 || '.ly1' AS name, replace(p_brand, '#', '') || '' AS stem FROM part) GROUP BY stem")
def written_names(spark, d):
    """A list file's names by stem, written and read."""
    part = spark.read.parquet(f"{d}/part.parquet")
    names = part.select(F.concat(F.translate("p_brand", "#", ""), F.lit("_"), F.col("p_size") % 10, F.lit(".ly1")))
    return tx.read_names(spark, _written(names, "names")).groupBy("stem").agg(F.count(F.lit(1)).alias("n"))
