"""Scalar functions over rectangles, numbers, vectors, strings and configurations."""

from __future__ import annotations

from pyspark.sql import functions as F

from partweave.functions import arrays as ar
from partweave.functions import config as cf
from partweave.functions import geometry as geo
from partweave.functions import scalars as sc
from partweave.plans.registry import query, r6
from partweave.sources import projections as p
from partweave.sources import text as tx
from partweave.sources.projections import with_views

SIDE = "greatest(0, least(b.urx, g.urx) - greatest(b.llx, g.llx)) * greatest(0, least(b.ury, g.ury) - greatest(b.lly, g.lly))"


@query(
    with_views(
        f"""SELECT b.box_id, g.gt_id, {SIDE} AS inter, (b.urx - b.llx) * (b.ury - b.lly) + (g.urx - g.llx) * (g.ury - g.lly) - {SIDE} AS uni,
        round({SIDE} * 1.0 / ((b.urx - b.llx) * (b.ury - b.lly) + (g.urx - g.llx) * (g.ury - g.lly) - {SIDE}), 6) AS iou,
        round({SIDE} * 1.0 / least((b.urx - b.llx) * (b.ury - b.lly), (g.urx - g.llx) * (g.ury - g.lly)), 6) AS min_overlap,
        least(b.llx, g.llx) AS u_llx, greatest(b.ury, g.ury) AS u_ury, 63 - b.urx AS mirrored, CAST(round(b.llx * 0.75) AS INT) AS scaled, b.lly - 2 AS padded
        FROM boxes b JOIN gt g ON b.image_id = g.image_id AND b.m = g.m""",
        "boxes",
        "gt",
    )
)
def rectangle_functions(spark, d):
    boxes = p.boxes(spark, d).select("image_id", "m", "box_id", geo.columns_box().alias("b"))
    truth = p.ground_truth(spark, d).select("image_id", "m", "gt_id", geo.columns_box().alias("g"))
    a, b = F.col("b"), F.col("g")
    union = geo.union_box(a, b)
    return boxes.join(truth, ["image_id", "m"]).select(
        "box_id", "gt_id", geo.intersection_area(a, b).alias("inter"), geo.union_area(a, b).alias("uni"),
        r6(geo.iou(a, b)).alias("iou"), r6(geo.min_overlap(a, b)).alias("min_overlap"),
        union["llx"].alias("u_llx"), union["ury"].alias("u_ury"), geo.mirror(a, 64)["llx"].alias("mirrored"),
        geo.scale_box(a, 0.75)["llx"].alias("scaled"), geo.pad(a, 2)["lly"].alias("padded"),
    )


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(round(l_discount * 25 - 1) AS INT) AS half_away, CAST(trunc(l_quantity / 3 - 7) AS INT) AS to_zero,
    CASE WHEN l_suppkey - 5 >= 0 THEN (l_suppkey - 5) % 3 ELSE 3 * (1 - CAST(trunc((l_suppkey - 5) / 3.0) AS BIGINT)) + (l_suppkey - 5) END AS wrapped,
    round(exp(-(l_tax - 0.04) * (l_tax - 0.04) / (2 * 0.0004)) / (0.02 * sqrt(2 * pi())), 6) AS pdf, round(exp(-(l_tax - 0.04) * (l_tax - 0.04) / (2 * 0.0004)), 6) AS peak,
    round(1 - least(l_quantity / 10, 5.0) / 5.0, 6) AS score FROM lineitem"""
)
def number_functions(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    a = F.col("l_suppkey") - 5
    return lines.select(
        "l_orderkey", "l_linenumber", "l_partkey", sc.round_half_away(F.col("l_discount") * 25 - 1).alias("half_away"),
        sc.toward_zero(F.col("l_quantity") / 3 - 7).alias("to_zero"), sc.wrapped_mod(a, F.lit(3)).alias("wrapped"),
        r6(sc.normal_pdf(F.col("l_tax"), 0.04, 0.02)).alias("pdf"), r6(sc.normal_peak(F.col("l_tax"), 0.04, 0.02)).alias("peak"),
        r6(sc.similarity_score(F.col("l_quantity") / 10)).alias("score"),
    )


@query(
    with_views(
        """SELECT vec_id, round(list_sum(list_transform(list_zip(h, r), lambda p: CASE WHEN p[1] + p[2] = 0 THEN 0.0 ELSE (p[1] - p[2]) * (p[1] - p[2]) / (p[1] + p[2]) END)) / 2, 6) AS chi,
        round(list_sum(list_transform(list_zip(h, r), lambda p: p[1] * p[2])), 6) AS dot, round(list_sum(list_transform(list_zip(h, r), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6) AS d2,
        CAST(list_position(h, list_max(h)) - 1 AS INT) AS top FROM (SELECT *, list_reverse(h) AS r FROM hist)""",
        "hist",
    )
)
def vector_functions(spark, d):
    h, r = F.col("h"), F.reverse("h")
    return p.histograms(spark, d).select(
        "vec_id", r6(ar.chi_square(h, r)).alias("chi"), r6(ar.dot(h, r)).alias("dot"), r6(ar.euclidean2(h, r)).alias("d2"),
        ar.argsort(h, descending=True)[0].alias("top"),
    )


@query(
    with_views(
        """WITH t AS (SELECT image_id, list_distinct(list(m) FILTER (WHERE x < 32)) AS a, list_distinct(list(m) FILTER (WHERE y < 16 AND r > 0.5)) AS b FROM nodes GROUP BY image_id)
        SELECT image_id, CAST(len(list_intersect(a, b)) AS INT) AS n_both, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 6) AS jaccard,
          round(len(list_intersect(a, b)) / least(len(a), len(b)), 6) AS overlap,
          len(list_filter(b, lambda v: NOT list_contains(a, v))) = 0 AND len(b) < len(a) AS inside FROM t WHERE a IS NOT NULL AND b IS NOT NULL""",
        "nodes",
    )
)
def set_functions(spark, d):
    nodes = p.nodes(spark, d)
    sets = nodes.groupBy("image_id").agg(
        F.collect_set(F.when(F.col("x") < 32, F.col("m"))).alias("a"), F.collect_set(F.when((F.col("y") < 16) & (F.col("r") > 0.5), F.col("m"))).alias("b")
    )
    a, b = F.col("a"), F.col("b")
    return sets.where("size(a) > 0 AND size(b) > 0").select(
        "image_id", F.size(F.array_intersect(a, b)).alias("n_both"), r6(ar.jaccard(a, b)).alias("jaccard"), r6(ar.overlap_share(a, b)).alias("overlap"),
        ar.proper_subset(b, a).alias("inside"),
    )


@query(
    with_views(
        """WITH a AS (SELECT image_id, x, y FROM nodes WHERE m = 5), b AS (SELECT image_id, x, y FROM nodes WHERE m = 6),
        d AS (SELECT a.image_id, a.x, a.y, min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS near FROM a JOIN b USING (image_id) GROUP BY ALL)
        SELECT image_id, max(near) AS hausdorff2, min(near) AS linkage2 FROM d GROUP BY image_id""",
        "nodes",
    )
)
def point_set_distances(spark, d):
    nodes = p.nodes(spark, d).where("m IN (5, 6)")
    point = F.struct("x", "y")
    sets = nodes.groupBy("image_id").agg(F.collect_list(F.when(F.col("m") == 5, point)).alias("a"), F.collect_list(F.when(F.col("m") == 6, point)).alias("b"))
    a, b = F.col("a"), F.col("b")
    return sets.where("size(a) > 0 AND size(b) > 0").select("image_id", ar.directed_hausdorff2(a, b).alias("hausdorff2"), ar.single_linkage2(a, b).alias("linkage2"))


@query(
    """SELECT p_partkey, trim('  ' || p_name || ' ') AS trimmed, split_part(p_name, ' ', 1) AS first_token, lpad(CAST(p_size AS VARCHAR), 6, '0') AS padded,
    '^' || replace(replace(replace(p_brand, '#', '*'), '*', '.*'), '?', '.') || '$' AS pattern,
    CAST(regexp_extract('img_' || p_size || '.ly1', '_([0-9]+)\\.', 1) AS INT) AS scale FROM part"""
)
def string_functions(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    return part.select(
        "p_partkey", F.trim(F.concat(F.lit("  "), "p_name", F.lit(" "))).alias("trimmed"), F.substring_index("p_name", " ", 1).alias("first_token"),
        F.lpad(F.col("p_size").cast("string"), 6, "0").alias("padded"), tx.wildcard_pattern(F.translate("p_brand", "#", "*")).alias("pattern"),
        tx.scale_of(F.concat(F.lit("img_"), F.col("p_size"), F.lit(".ly1"))).alias("scale"),
    )


@query(
    """SELECT o_orderkey, CAST(o_orderkey % 9 AS INT) AS a, 'B' || o_orderpriority AS name, CAST(o_orderkey % 9 + 1 AS INT) AS nested,
    CAST(o_custkey AS DOUBLE) AS lent, CAST(7 AS INT) AS dflt, CAST(o_orderkey % 3 AS DOUBLE) AS at_loop FROM orders"""
)
def configuration_functions(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    text = F.concat(
        F.lit("a = 100 # first\n# only a comment\na = "), F.col("o_orderkey") % 9, F.lit("\nname = B"), F.col("o_orderpriority"),
        F.lit("\ninference.a = "), F.col("o_orderkey") % 9 + 1, F.lit("\nother.lent = "), F.col("o_custkey"),
        F.lit("\ninference.from_namespace = other\nother.a = 55\nlist = 0,1,2"),
    )
    conf = orders.select("o_orderkey", cf.parse(text).alias("c"))
    c = F.col("c")
    inner = cf.resolved(c, "inference")
    return conf.select(
        "o_orderkey", cf.get(c, "a", "int").alias("a"), cf.get(c, "name", "string").alias("name"), cf.get(inner, "a", "int").alias("nested"),
        cf.get(inner, "lent", "double").alias("lent"), cf.get(c, "missing", "int", 7).alias("dflt"),
        ar.loop_value(cf.get_vector(c, "list"), (F.col("o_orderkey") % 3).cast("int")).alias("at_loop"),
    )


@query(
    with_views("SELECT vec_id, string_agg((i - 1 + 1) || ':' || v, ' ' ORDER BY i) AS line FROM (SELECT vec_id, unnest(range(1, len(h) + 1)) AS i, unnest(list_transform(h, lambda v: CAST(floor(v * 100) AS INT))) AS v FROM hist) WHERE v <> 0 GROUP BY vec_id", "hist")
)
def sparse_vectors(spark, d):
    whole = F.transform("h", lambda v: F.floor(v * 100).cast("int"))
    return p.histograms(spark, d).select("vec_id", ar.sparse_text(whole).alias("line")).where("line <> ''")


@query(
    with_views(
        """SELECT node_id, round(degrees(atan2(y - 32, x - 32)), 4) AS angle, (x - 32) * (x - 32) + (y - 32) * (y - 32) AS d2,
        round((x - 32) * cos(0.5) - (y - 32) * sin(0.5), 6) AS rx, round((x - 32) * sin(0.5) + (y - 32) * cos(0.5), 6) AS ry FROM nodes""",
        "nodes",
    )
)
def point_functions(spark, d):
    x, y = F.col("x") - 32, F.col("y") - 32
    rx, ry = geo.rotate(x, y, F.lit(0.5))
    return p.nodes(spark, d).select(
        "node_id", F.round(F.degrees(F.atan2(y, x)), 4).alias("angle"), geo.distance2(F.col("x"), F.col("y"), F.lit(32), F.lit(32)).alias("d2"), r6(rx).alias("rx"), r6(ry).alias("ry")
    )
