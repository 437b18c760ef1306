"""Spatial joins, evaluation against ground truth, suppression, merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from partweave.functions import geometry as geo
from partweave.operators import evaluation as ev
from partweave.operators import merging as mg
from partweave.operators import ranges as rg
from partweave.operators import suppression as sp
from partweave.plans.inference_queries import LAYER, layer_two
from partweave.plans.inference_queries import ALL as MODEL
from partweave.plans.registry import query, r6, rounded
from partweave.sources import projections as p
from partweave.sources.projections import with_views

KEYS = ["image_id", "m"]

PAIRS = """WITH pairs AS (SELECT b.box_id, g.gt_id, b.image_id, b.m, b.val, i.a AS inter,
    (b.urx - b.llx) * (b.ury - b.lly) AS area_b, (g.urx - g.llx) * (g.ury - g.lly) AS area_g
  FROM boxes b JOIN gt g ON b.image_id = g.image_id AND b.m = g.m,
  LATERAL (SELECT greatest(0, least(b.urx, g.urx) - greatest(b.llx, g.llx)) * greatest(0, least(b.ury, g.ury) - greatest(b.lly, g.lly)) AS a) i
  WHERE i.a > 0)"""
BEST_IOU = (
    PAIRS
    + """, best AS (SELECT b.*, coalesce(max(p.inter * 1.0 / (p.area_b + p.area_g - p.inter)), 0.0) AS best_iou
  FROM boxes b LEFT JOIN pairs p USING (box_id) GROUP BY ALL)"""
)


def _both(spark, d):
    return p.boxes(spark, d), p.ground_truth(spark, d)


@query(with_views(BEST_IOU.replace("GROUP BY ALL", "GROUP BY b.image_id, b.llx, b.lly, b.m, b.val, b.urx, b.ury, b.box_id") + " SELECT box_id, round(best_iou, 6) AS best_iou FROM best", "boxes", "gt"))
def best_overlap(spark, d):
    return ev.best_iou(*_both(spark, d), KEYS).select("box_id", r6("best_iou").alias("best_iou"))


_BEST = BEST_IOU.replace("GROUP BY ALL", "GROUP BY b.image_id, b.llx, b.lly, b.m, b.val, b.urx, b.ury, b.box_id")


@query(with_views(_BEST + " SELECT m, CAST(count_if(best_iou >= 0.4) AS BIGINT) AS hits, CAST(count_if(best_iou < 0.4) AS BIGINT) AS misses FROM best GROUP BY m", "boxes", "gt"))
def hits_and_misses(spark, d):
    return ev.hits_and_misses(*_both(spark, d), KEYS, 0.4, ["m"])


@query(
    with_views(
        PAIRS + """ SELECT g.gt_id, count(p.box_id) AS n_hits FROM gt g LEFT JOIN (SELECT * FROM pairs WHERE inter * 1.0 / (area_b + area_g - inter) >= 0.4) p
        USING (gt_id) GROUP BY g.gt_id""",
        "boxes",
        "gt",
    )
)
def truth_hits(spark, d):
    return ev.truth_hits(*_both(spark, d), KEYS, 0.4).select("gt_id", "n_hits")


@query(
    with_views(
        _BEST + """ SELECT box_id, CASE WHEN best_iou >= 0.4 THEN 'positive' ELSE 'negative' END AS role, round(best_iou, 6) AS best_iou
        FROM best WHERE best_iou >= 0.4 OR best_iou <= 0.1""",
        "boxes",
        "gt",
    )
)
def overlap_roles(spark, d):
    return ev.split_by_overlap(*_both(spark, d), KEYS, 0.1, 0.4).select("box_id", "role", r6("best_iou").alias("best_iou"))


@query(
    with_views(
        """SELECT box_id FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM gt g WHERE g.label = '1-URGENT' AND g.image_id = b.image_id
        AND least(b.urx, g.urx) > greatest(b.llx, g.llx) AND least(b.ury, g.ury) > greatest(b.lly, g.lly))""",
        "boxes",
        "gt",
    )
)
def outside_ignored_regions(spark, d):
    boxes, truth = _both(spark, d)
    return ev.outside_regions(boxes, truth.where("label = '1-URGENT'"), ["image_id"]).select("box_id")


@query(with_views(PAIRS + " SELECT image_id, m, count(*) AS n_pairs FROM pairs WHERE inter >= 0.5 * area_b AND inter >= 0.5 * area_g GROUP BY image_id, m", "boxes", "gt"))
def mutual_coverage(spark, d):
    return ev.mutual_coverage(*_both(spark, d), KEYS, 0.5)


@query(
    with_views(
        _BEST + """, totals AS (SELECT image_id, m, count(*) AS n_truth FROM gt GROUP BY 1, 2),
        run AS (SELECT image_id, m, box_id, val, CAST(sum(CASE WHEN best_iou >= 0.4 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS tp, count(*) OVER w AS n
          FROM best WINDOW w AS (PARTITION BY image_id, m ORDER BY val DESC, box_id ROWS UNBOUNDED PRECEDING))
        SELECT image_id, m, box_id, val, tp, n, round(tp / n, 6) AS precision, round(tp / n_truth, 6) AS recall FROM run JOIN totals USING (image_id, m)""",
        "boxes",
        "gt",
    )
)
def precision_recall(spark, d):
    return rounded(ev.precision_recall(*_both(spark, d), KEYS, 0.4, KEYS), "precision", "recall")


@query(with_views(_BEST + " SELECT m, round(avg(best_iou), 6) AS mean_iou, count(*) AS n FROM best GROUP BY m", "boxes", "gt"))
def mean_overlap_by_type(spark, d):
    return rounded(ev.mean_overlap_by_type(*_both(spark, d), KEYS), "mean_iou")


@query(
    with_views(
        _BEST + """ SELECT box_id FROM (SELECT box_id, row_number() OVER (PARTITION BY image_id ORDER BY val DESC, box_id) AS rn FROM best WHERE best_iou < 0.2)
        WHERE (rn - 1) % 4 = 0""",
        "boxes",
        "gt",
    )
)
def hard_negatives(spark, d):
    return ev.hard_negatives(*_both(spark, d), KEYS, 0.2, 4, ["image_id"]).select("box_id")


TILES = "SELECT image_id, CAST(tx * 4 + ty AS INT) AS tile_id, CAST(tx * 16 AS INT) AS llx, CAST(ty * 16 AS INT) AS lly, CAST(tx * 16 + 32 AS INT) AS urx, CAST(ty * 16 + 32 AS INT) AS ury FROM (SELECT DISTINCT image_id FROM gt), range(4) AS a(tx), range(4) AS b(ty)"


@query(
    with_views(
        f"""WITH tiles AS ({TILES}) SELECT t.image_id, t.tile_id, g.gt_id, g.llx - t.llx AS llx, g.lly - t.lly AS lly, g.urx - t.llx AS urx, g.ury - t.lly AS ury
        FROM tiles t JOIN gt g USING (image_id) WHERE greatest(0, least(t.urx, g.urx) - greatest(t.llx, g.llx)) * greatest(0, least(t.ury, g.ury) - greatest(t.lly, g.lly))
          >= 0.8 * (g.urx - g.llx) * (g.ury - g.lly)""",
        "gt",
    )
)
def tile_truths(spark, d):
    truth = p.ground_truth(spark, d)
    step = F.sequence(F.lit(0), F.lit(3))
    tiles = (
        truth.select("image_id").distinct().withColumn("tx", F.explode(step)).withColumn("ty", F.explode(step))
        .select("image_id", (F.col("tx") * 4 + F.col("ty")).alias("tile_id"), (F.col("tx") * 16).alias("llx"), (F.col("ty") * 16).alias("lly"), (F.col("tx") * 16 + 32).alias("urx"), (F.col("ty") * 16 + 32).alias("ury"))
    )
    return ev.tile_truths(tiles, truth, ["image_id"], 0.8)


@query(
    with_views(
        """WITH met AS (SELECT a.node_id, b.node_id AS near_id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) AS d2 FROM nodes a JOIN nodes b
          ON a.image_id = b.image_id AND a.m = 0 AND b.m = 1 AND abs(a.x - b.x) <= 6 AND abs(a.y - b.y) <= 6)
        SELECT node_id, near_id, d2 FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY d2, near_id) AS rn FROM met) WHERE rn = 1""",
        "nodes",
    )
)
def nearest_node(spark, d):
    nodes = p.nodes(spark, d)
    side = lambda m: nodes.where(F.col("m") == m).select("image_id", "x", "y", "node_id")
    return rg.nearest(side(0), side(1), ["image_id"], 6)


@query(
    with_views(
        """SELECT node_id FROM nodes b WHERE b.r < 0.5 AND NOT EXISTS (SELECT 1 FROM nodes a WHERE a.r >= 0.5 AND a.image_id = b.image_id AND a.m = b.m
        AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2)""",
        "nodes",
    )
)
def tolerant_difference(spark, d):
    nodes = p.nodes(spark, d)
    return rg.unmatched(nodes.where("r < 0.5"), nodes.where("r >= 0.5"), KEYS, 2).select("node_id")


@query(with_views("SELECT image_id, z, x, y, m, r, g, rr, node_id FROM nodes WHERE x >= 8 AND x < 40 AND y >= 4 AND y < 30", "nodes"))
def nodes_in_rectangle(spark, d):
    return rg.in_rectangle(p.nodes(spark, d), 8, 4, 40, 30)


@query(with_views("SELECT node_id FROM nodes WHERE (x - 32) * (x - 32) * 100 + (y - 30) * (y - 30) * 400 <= 40000", "nodes"))
def nodes_in_ellipse(spark, d):
    return p.nodes(spark, d).where(geo.in_ellipse(F.col("x") - 32, F.col("y") - 30, 20, 10)).select("node_id")


@query(with_views("SELECT image_id, m, box_id, val FROM (SELECT *, row_number() OVER (PARTITION BY image_id, m ORDER BY val DESC, box_id) AS n FROM boxes) WHERE n <= 5", "boxes"))
def top_boxes(spark, d):
    return sp.top_k(p.boxes(spark, d), KEYS, 5, "val", "box_id").select("image_id", "m", "box_id", "val")


def _nms_sql(measure: str, threshold: float) -> str:
    """Greedy suppression as recursion: each step takes the best box that no taken one overlaps."""
    return with_views(
        f"""WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY image_id, m ORDER BY val DESC, box_id) AS n FROM boxes),
        clash AS (SELECT a.image_id, a.m, a.n AS na, b.n AS nb, b.box_id FROM ranked a JOIN ranked b ON a.image_id = b.image_id AND a.m = b.m AND a.n < b.n,
          LATERAL (SELECT greatest(0, least(a.urx, b.urx) - greatest(a.llx, b.llx)) * greatest(0, least(a.ury, b.ury) - greatest(a.lly, b.lly)) AS i) x
          WHERE {measure} > {threshold}),
        step AS (SELECT r.image_id, r.m, 1 AS n, [CAST(1 AS BIGINT)] AS kept FROM ranked r WHERE r.n = 1
          UNION ALL SELECT s.image_id, s.m, s.n + 1, CASE WHEN EXISTS (SELECT 1 FROM clash c WHERE c.image_id = s.image_id AND c.m = s.m AND c.nb = s.n + 1 AND list_contains(s.kept, c.na))
            THEN s.kept ELSE list_append(s.kept, CAST(s.n + 1 AS BIGINT)) END
          FROM step s JOIN ranked r ON r.image_id = s.image_id AND r.m = s.m AND r.n = s.n + 1),
        last AS (SELECT image_id, m, kept FROM (SELECT *, row_number() OVER (PARTITION BY image_id, m ORDER BY n DESC) AS k FROM step) WHERE k = 1)
        SELECT r.box_id FROM ranked r JOIN last l ON r.image_id = l.image_id AND r.m = l.m WHERE list_contains(l.kept, r.n)""",
        "boxes",
        recursive=True,
    )


@query(_nms_sql("i * 1.0 / (200 - i)", 0.3))
def suppressed_by_iou(spark, d):
    return sp.suppress_boxes(p.boxes(spark, d), KEYS, 0.3).select("box_id")


@query(_nms_sql("i / 100.0", 0.5))
def suppressed_by_smaller(spark, d):
    return sp.suppress_boxes(p.boxes(spark, d), KEYS, 0.5, kind="min").select("box_id")


@query(
    with_views(
        """SELECT image_id, z, x, y, m, r, g, rr, node_id, scale FROM (SELECT *, row_number() OVER (PARTITION BY image_id, z, x, y, m ORDER BY scale, g DESC, node_id) AS n FROM (
          SELECT image_id, z, x, y, m, r, g, rr, node_id, 0 AS scale FROM nodes WHERE node_id % 2 = 0
          UNION ALL SELECT image_id, z, CAST(round(x * 0.8) AS INT), CAST(round(y * 0.8) AS INT), m, r, g, rr, node_id, 1 FROM nodes WHERE node_id % 2 = 1)) WHERE n = 1""",
        "nodes",
    )
)
def merged_scales(spark, d):
    nodes = p.nodes(spark, d)
    return mg.merge_scales(nodes.where("node_id % 2 = 0"), nodes.where("node_id % 2 = 1"), 0.8)


@query(
    with_views(
        "SELECT image_id, z, x, y, m, r, g, rr, node_id FROM (SELECT *, row_number() OVER (PARTITION BY image_id, z, x, y ORDER BY g DESC, m, node_id) AS n FROM nodes) WHERE n = 1",
        "nodes",
    )
)
def merged_results(spark, d):
    nodes = p.nodes(spark, d)
    return mg.merge_results(nodes.where("m < 3"), nodes.where("m >= 3"))


@query(
    with_views(
        """SELECT image_id, count(*) AS n_new FROM nodes b WHERE b.r < 0.5 AND NOT EXISTS (SELECT 1 FROM nodes a WHERE a.r >= 0.5 AND a.image_id = b.image_id AND a.m = b.m
        AND abs(a.x - b.x) <= 2 AND abs(a.y - b.y) <= 2) GROUP BY image_id""",
        "nodes",
    )
)
def layer_difference(spark, d):
    nodes = p.nodes(spark, d)
    return mg.layer_difference(nodes.where("r >= 0.5"), nodes.where("r < 0.5"))


@query(
    with_views(
        """SELECT user_id, frame, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS sum_value, max(value) OVER w AS max_value FROM frames
        WINDOW w AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
        "frames",
    )
)
def frame_windows(spark, d):
    return rounded(mg.sliding_windows(p.frames(spark, d), 5), "sum_value")


@query(
    with_views(
        """WITH marked AS (SELECT *, CASE WHEN lag(value) OVER w IS NULL OR abs(value - lag(value) OVER w) > 50 THEN 1 ELSE 0 END AS new FROM frames WINDOW w AS (PARTITION BY user_id ORDER BY frame)),
        numbered AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY frame) AS BIGINT) AS session FROM marked)
        SELECT user_id, session, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS n, round(avg(value), 6) AS mean_value FROM numbered GROUP BY user_id, session""",
        "frames",
    )
)
def frame_sessions(spark, d):
    return rounded(mg.change_sessions(p.frames(spark, d), 50.0), "mean_value")


@query(
    with_views(
        """SELECT user_id, event_id, group_type, group_id FROM (SELECT user_id, event_id, m AS group_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE frame END AS group_id,
        max(CASE WHEN event_id % 3 = 0 THEN NULL ELSE frame END) OVER (PARTITION BY m) AS top FROM frames) WHERE group_id IS NULL OR group_id = top""",
        "frames",
    )
)
def highest_groups(spark, d):
    rows = p.frames(spark, d).select(
        "user_id", "event_id", F.col("m").alias("group_type"), F.when(F.col("event_id") % 3 != 0, F.col("frame")).alias("group_id")
    )
    return mg.highest_group(rows)


@query(with_views(LAYER + " SELECT image_id, count(*) AS n_nodes, round(max(g), 6) AS max_g FROM top GROUP BY image_id", *MODEL))
def second_layer_summary(spark, d):
    return layer_two(spark, d).groupBy("image_id").agg(F.count(F.lit(1)).alias("n_nodes"), r6(F.max("g")).alias("max_g"))
