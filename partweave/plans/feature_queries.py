"""Descriptors, learning statistics, clustering, pixels."""

from __future__ import annotations

from pyspark.sql import functions as F

from partweave.operators import clustering as cl
from partweave.operators import descriptors as ds
from partweave.operators import images as im
from partweave.operators import learning as ln
from partweave.operators.ordering import numbered
from partweave.plans.registry import query, r6, rounded
from partweave.sources import projections as p
from partweave.sources.projections import with_views

PI2 = "(2 * pi())"
BIN = f"""CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE 1 + (CASE WHEN sqrt(dx * dx + dy * dy) <= 2 THEN 0 WHEN sqrt(dx * dx + dy * dy) <= 5 THEN 1 END) * 8
  + CAST(floor((((atan2(dy, dx) + {PI2} / 16) % {PI2} + {PI2}) % {PI2}) / ({PI2} / 8)) AS INT) END"""
CONTEXT = f"""WITH met AS (SELECT a.image_id, a.node_id, b.x - a.x AS dx, b.y - a.y AS dy FROM nodes a JOIN (SELECT DISTINCT image_id, x, y FROM nodes) b
    ON a.image_id = b.image_id AND abs(a.x - b.x) <= 5 AND abs(a.y - b.y) <= 5),
  bins AS (SELECT image_id, node_id, {BIN} AS bin FROM met)"""


def _contexts(spark, d):
    return ds.shape_contexts(p.nodes(spark, d), angles=8, radii=[2.0, 5.0])


@query(with_views(CONTEXT + " SELECT image_id, node_id, bin, count(*) AS n FROM bins WHERE bin IS NOT NULL GROUP BY image_id, node_id, bin", "nodes"))
def shape_contexts(spark, d):
    return _contexts(spark, d)


@query(
    with_views(
        CONTEXT + """, counted AS (SELECT node_id, bin, count(*) AS n FROM bins WHERE bin IS NOT NULL GROUP BY node_id, bin)
        SELECT node_id, round(sum(n * (bin + 1)) / sum(n), 6) AS mean_bin, CAST(sum(n) AS DOUBLE) AS total FROM counted GROUP BY node_id""",
        "nodes",
    )
)
def dense_contexts(spark, d):
    h = ds.dense_histogram(_contexts(spark, d), ["image_id", "node_id"], 17)
    total = F.aggregate("h", F.lit(0.0), lambda a, v: a + v)
    weighted = F.aggregate(F.transform("h", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)
    return h.select("node_id", r6(weighted / total).alias("mean_bin"), total.alias("total"))


@query(
    with_views(
        """WITH spread AS (SELECT n.*, w.wx, v.wy FROM nodes n, LATERAL (SELECT unnest(range(CAST(floor((x - 16) / 8.0) AS INT) + 1, CAST(floor(x / 8.0) AS INT) + 1)) AS wx) w,
          LATERAL (SELECT unnest(range(CAST(floor((y - 16) / 8.0) AS INT) + 1, CAST(floor(y / 8.0) AS INT) + 1)) AS wy) v),
        sums AS (SELECT image_id, CAST(wx AS INT) AS wx, CAST(wy AS INT) AS wy, CAST(floor((y - wy * 8) / 8.0) * 2 + floor((x - wx * 8) / 8.0) AS INT) AS bin, m, sum(r) AS s FROM spread GROUP BY ALL)
        SELECT image_id, wx, wy, bin, m, round(s / sum(s) OVER (PARTITION BY image_id, wx, wy), 9) AS share FROM sums""",
        "nodes",
    )
)
def compositions(spark, d):
    return ds.compositions(p.nodes(spark, d), 16, 8, 2).withColumn("share", F.round("share", 9))


COOC = """SELECT a.m AS mc, b.m AS mn, b.x - a.x AS dx, b.y - a.y AS dy, sum(b.r) AS v, count(*) AS n FROM nodes a JOIN nodes b
  ON a.image_id = b.image_id AND abs(a.x - b.x) <= 4 AND abs(a.y - b.y) <= 4 AND greatest(abs(a.x - b.x), abs(a.y - b.y)) >= 1 GROUP BY 1, 2, 3, 4"""


@query(with_views(f"SELECT mc, mn, dx, dy, round(v, 6) AS v, n FROM ({COOC})", "nodes"))
def cooccurrence(spark, d):
    return rounded(ds.cooccurrence(p.nodes(spark, d), 4), "v")


@query(with_views(f"SELECT mc, mn, round(sum(v), 6) AS v FROM ({COOC}) GROUP BY mc, mn", "nodes"))
def merged_maps(spark, d):
    maps = ds.cooccurrence(p.nodes(spark, d), 4)
    return rounded(ln.merge_statistics(maps, ["mc", "mn"]), "v")


@query(
    with_views(
        """WITH s AS (SELECT image_id, m, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS sxx, var_pop(y) AS syy, covar_pop(x, y) AS sxy FROM nodes GROUP BY image_id, m)
        SELECT image_id, m, n, round(mx, 6) AS mx, round(my, 6) AS my,
          round(2 * sqrt((sxx + syy) / 2 + sqrt((sxx - syy) * (sxx - syy) / 4 + sxy * sxy)), 4) AS axis_a FROM s""",
        "nodes",
    )
)
def fitted_ellipses(spark, d):
    got = ds.moments(p.nodes(spark, d), ["image_id", "m"])
    return rounded(got, "mx", "my").withColumn("axis_a", F.round("axis_a", 4)).drop("axis_b", "angle")


@query(
    with_views(
        """SELECT a.m, b.m AS o_m, count(*) AS n, round(avg(b.x - a.x), 6) AS mean_dx, round(avg(b.y - a.y), 6) AS mean_dy FROM nodes a JOIN nodes b
        ON a.image_id = b.image_id AND abs(a.x - b.x) <= 3 AND abs(a.y - b.y) <= 3 AND a.node_id <> b.node_id GROUP BY 1, 2""",
        "nodes",
    )
)
def pair_offsets(spark, d):
    return rounded(ds.pair_offsets(p.nodes(spark, d), 3), "mean_dx", "mean_dy")


@query()
def duplet_peaks(spark, d):
    """Greedy peak picking per pair; tests compare with a plain loop."""
    return rounded(ln.duplets(p.nodes(spark, d), radius=4, peak_radius=2, share=0.5, most=3), "v")


@query()
def part_sequences(spark, d):
    """Sequences extended within a beam; tests compare with a plain loop."""
    nodes = p.nodes(spark, d)
    peaks = ln.duplets(nodes, radius=4, peak_radius=2, share=0.5, most=2)
    return ln.part_sequences(nodes, peaks, tolerance=1, least=0.4, longest=3)


@query(
    with_views(
        """WITH top AS (SELECT *, row_number() OVER (PARTITION BY image_id, z, x, y ORDER BY g DESC, m) AS rn FROM nodes),
        sets AS (SELECT string_agg(DISTINCT m, ',' ORDER BY m) AS types FROM top WHERE rn <= 2 GROUP BY image_id, z, x, y) SELECT types, count(*) AS n FROM sets GROUP BY types""",
        "nodes",
    )
)
def position_sets(spark, d):
    return ln.position_sets(p.nodes(spark, d), 2)


@query(
    with_views(
        """SELECT m, r AS threshold FROM (SELECT m, r, row_number() OVER (PARTITION BY m ORDER BY r, node_id) AS rn, count(*) OVER (PARTITION BY m) AS n FROM nodes WHERE g > 0.95)
        WHERE rn = CAST(floor(0.05 * n) AS BIGINT) + 1""",
        "nodes",
    )
)
def learned_thresholds(spark, d):
    return ln.learned_thresholds(p.nodes(spark, d).withColumn("positive", F.col("g") > 0.95))


@query(
    """WITH lib AS (SELECT CAST(row_number() OVER (ORDER BY p_type) - 1 AS INT) AS part, p_type AS structure FROM (SELECT DISTINCT p_type FROM part WHERE p_size <= 10)),
    fresh AS (SELECT DISTINCT p_type AS structure FROM part WHERE p_type NOT IN (SELECT structure FROM lib))
    SELECT part, structure FROM lib UNION ALL SELECT CAST((SELECT max(part) + 1 FROM lib) + row_number() OVER (ORDER BY structure) - 1 AS INT), structure FROM fresh"""
)
def inserted_parts(spark, d):
    part = spark.read.parquet(f"{d}/part.parquet")
    old = part.where("p_size <= 10").select(F.col("p_type").alias("structure")).distinct()
    library = numbered(old, [], ["structure"], "k").select((F.col("k") - 1).cast("int").alias("part"), "structure")
    return ln.inserted_parts(library, part.select(F.col("p_type").alias("structure")))


@query(
    with_views(
        "SELECT part, idx, count(*) AS n, round(avg(v), 6) AS mean_v, round(avg(s_r), 6) AS mean_r FROM (SELECT s.part, s.idx, n.r AS s_r, n.r * n.g AS v FROM nodes n JOIN lib_sub s ON n.m = s.sub_m) GROUP BY part, idx",
        "nodes",
        "lib_sub",
    )
)
def edge_statistics(spark, d):
    met = p.nodes(spark, d).join(p.lib_sub(spark), F.col("m") == F.col("sub_m")).withColumn("v", F.col("r") * F.col("g"))
    stats = ln.edge_statistics(met.select("part", "idx", "dx", "dy", "v"))
    more = met.groupBy("part", "idx").agg(r6(F.avg("r")).alias("mean_r"))
    return stats.join(more, ["part", "idx"]).select("part", "idx", "n", r6("mean_v").alias("mean_v"), "mean_r")


BOOK = "SELECT vec_id AS code, h AS centre FROM hist WHERE vec_id < 16"
CHI = "list_sum(list_transform(list_zip(v.h, c.centre), lambda p: CASE WHEN p[1] + p[2] = 0 THEN 0.0 ELSE (p[1] - p[2]) * (p[1] - p[2]) / (p[1] + p[2]) END)) / 2"


@query(
    with_views(
        f"""WITH d AS (SELECT v.vec_id, c.code, {CHI} AS distance FROM hist v, ({BOOK}) c)
        SELECT vec_id, code, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, code) AS rn FROM d) WHERE rn = 1""",
        "hist",
    )
)
def quantised_histograms(spark, d):
    hist = p.histograms(spark, d)
    book = hist.where("vec_id < 16").select(F.col("vec_id").alias("code"), F.col("h").alias("centre"))
    return rounded(cl.quantise(hist, book, id_col="vec_id", kind="chi"), "distance")


@query()
def mean_shift_clusters(spark, d):
    """Iterated means have no SQL form; tests use separated clouds."""
    return cl.mean_shift(p.nodes(spark, d).select("image_id", "m", "x", "y", "node_id"), ["image_id", "m"], sigma=3.0)


@query(
    with_views(
        """WITH pts AS (SELECT image_id, m, node_id, x, y FROM nodes),
        near AS (SELECT a.node_id AS a, b.node_id AS b FROM pts a JOIN pts b ON a.image_id = b.image_id AND a.m = b.m AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 25),
        reach AS (SELECT a AS node_id, a AS c FROM near UNION SELECT n.b, r.c FROM reach r JOIN near n ON n.a = r.node_id)
        SELECT p.image_id, p.m, p.node_id, min(r.c) AS cluster FROM pts p JOIN reach r USING (node_id) GROUP BY p.image_id, p.m, p.node_id""",
        "nodes",
        recursive=True,
    )
)
def agglomerated_nodes(spark, d):
    return cl.agglomerate(p.nodes(spark, d).select("image_id", "m", "x", "y", "node_id"), ["image_id", "m"], distance=5.0)


CELLS = "SELECT image_id, x, y, max(r) AS v FROM nodes GROUP BY image_id, x, y"


def _cells(spark, d):
    return p.nodes(spark, d).groupBy("image_id", "x", "y").agg(F.max("r").alias("v"))


@query(with_views(f"SELECT c.image_id, c.x + CAST(k.i AS INT) AS x, c.y + CAST(k.j AS INT) AS y, round(sum(c.v * k.w), 6) AS v FROM ({CELLS}) c, kernel k GROUP BY 1, 2, 3", "nodes", "kernel"))
def convolved_cells(spark, d):
    return rounded(im.convolved_cells(_cells(spark, d), p.kernel(spark)), "v")


@query(
    with_views(
        f"""SELECT image_id, x, y, round(sum(v) OVER (PARTITION BY image_id, x ORDER BY y ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING), 6) AS v FROM
        (SELECT image_id, x, y, sum(v) OVER (PARTITION BY image_id, y ORDER BY x ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS v FROM ({CELLS}))""",
        "nodes",
    )
)
def block_sums(spark, d):
    return rounded(im.block_sums(_cells(spark, d)), "v")


@query(
    with_views(
        f"""WITH c AS ({CELLS}) SELECT a.image_id, a.x, a.y, a.v, 8 - count(b.v) AS n FROM c a LEFT JOIN c b ON a.image_id = b.image_id AND abs(a.x - b.x) <= 1 AND abs(a.y - b.y) <= 1
        AND NOT (a.x = b.x AND a.y = b.y) AND b.v > a.v GROUP BY a.image_id, a.x, a.y, a.v HAVING 8 - count(b.v) >= 8""",
        "nodes",
    )
)
def rank_peaks(spark, d):
    return im.rank_peaks(_cells(spark, d), 8)


@query(
    with_views(
        """SELECT image_id, m, x, y, v FROM (SELECT image_id, m, x, y, r AS v, max(r) OVER (PARTITION BY image_id, x, y) AS p, max(r) OVER (PARTITION BY image_id) AS w FROM nodes)
        WHERE v >= 0.6 * p AND p >= 0.2 * w""",
        "nodes",
    )
)
def strong_features(spark, d):
    return im.strong_features(p.nodes(spark, d).select("image_id", "m", "x", "y", F.col("r").alias("v")), 0.6, 0.2)


def _pixel_images(spark, d):
    """64x64 images of the cells, as the pixels that are not 0."""
    place = F.struct((F.col("y") * 64 + F.col("x")).alias("at"), F.coalesce("v", F.lit(0.0)).alias("v"))
    maps = _cells(spark, d).groupBy("image_id").agg(F.collect_list(place).alias("p"))
    return maps.select("image_id", F.lit(0).alias("scale"), F.lit(64).alias("width"), F.lit(64).alias("height"), F.col("p.at").alias("at"), F.col("p.v").alias("v"))


@query()
def oriented_energy(spark, d):
    """Filter banks in tasks, with all activations; tests compare with direct sums."""
    return im.oriented_energy(_pixel_images(spark, d), 6, digits=6)


@query()
def image_pyramid(spark, d):
    """Bilinear scales; tests compare sizes and means."""
    scaled = im.pyramid(_pixel_images(spark, d), factor=0.8, limit=20, most=6)
    return scaled.select("image_id", "scale", "width", "height", r6(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v)).alias("total"))


@query()
def blurred_images(spark, d):
    """Gaussian blur in tasks; tests compare with direct sums."""
    out = im.blurred(_pixel_images(spark, d), 5, 1.2)
    return out.select("image_id", "width", "height", r6(F.aggregate("pixels", F.lit(0.0), lambda a, v: a + v)).alias("total"))
