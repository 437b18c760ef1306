"""The part library as tables: structures, roots, sizes, masks.

``lib_center`` is (part, center_m, cmx, cmy, bp), ``lib_sub`` is (part, idx, sub_m,
dx, dy); a type on layer k is a part of layer k - 1. Libraries are small beside
the images, but all of this is joins, so nothing depends on that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partweave.operators.ranges import with_model
from partweave.sources.scratch import stored


def structures(lib_center: DataFrame, lib_sub: DataFrame) -> DataFrame:
    """(part, structure): the centre type, then type and offset of each subpart in
    order; equal structures are equal parts."""
    row = F.struct("idx", F.concat_ws(":", "sub_m", "dx", "dy").alias("t"))
    subs = lib_sub.groupBy("part").agg(F.array_sort(F.collect_list(row)).alias("subs"))
    parts = F.transform(F.coalesce("subs", F.array().cast("array<struct<idx:int,t:string>>")), lambda s: s["t"])
    return lib_center.join(subs, "part", "left").select("part", F.array_join(F.concat(F.array(F.col("center_m").cast("string")), parts), "|").alias("structure"))


def similar_offsets(lib_sub: DataFrame, similar: DataFrame) -> DataFrame:
    """(part, dx, dy, m): subpart places with their type and every similar type;
    ``similar`` is (m, other)."""
    own = lib_sub.select("part", "dx", "dy", F.col("sub_m").alias("m"))
    more = lib_sub.join(similar, F.col("sub_m") == F.col("m")).select("part", "dx", "dy", F.col("other").alias("m"))
    return own.unionByName(more).distinct()


def dense_roots(roots: DataFrame) -> DataFrame:
    """(m, root, number): distinct similarity roots numbered from 0; a type that is
    not its own root has -1."""
    numbers = roots.select("root").distinct().withColumn("number", F.row_number().over(Window.orderBy("root")) - 1)
    met = roots.join(numbers, "root")
    return met.select("m", "root", F.when(F.col("m") == F.col("root"), F.col("number")).otherwise(-1).alias("number"))


def part_leaves(lib_center: DataFrame, lib_sub: DataFrame, layers: int) -> DataFrame:
    """(part, n): basic parts of each part when the library's types stack over
    ``layers`` layers: a layer-0 type is one leaf, a part has its centre's and
    subparts' leaves."""
    sizes = lib_center.select(F.col("center_m").alias("m")).unionByName(lib_sub.select(F.col("sub_m").alias("m"))).distinct().withColumn("n", F.lit(1).cast("long"))
    uses = lib_center.select("part", F.col("center_m").alias("m")).unionByName(lib_sub.select("part", F.col("sub_m").alias("m")))
    for _ in range(layers):
        grown = uses.join(sizes, "m").groupBy("part").agg(F.sum("n").alias("n"))
        # Types without a part of their number stay leaves.
        sizes = grown.select(F.col("part").alias("m"), "n").unionByName(sizes.join(grown.select(F.col("part").alias("m")), "m", "left_anti").select("m", "n"))
    return lib_center.select("part").distinct().join(sizes.withColumnRenamed("m", "part"), "part")


def masks(lib_center: DataFrame, lib_sub: DataFrame, first: DataFrame, layers: int, contraction: int = 1) -> DataFrame:
    """(part, x, y, v): the parts' masks over ``layers`` layers. ``first`` is (m, x, y,
    v), the masks of layer-0 types; a part takes the maximum of its centre's mask
    and its subparts' masks moved to their places."""
    use = lib_center.select("part", F.col("center_m").alias("m"), F.lit(0).alias("dx"), F.lit(0).alias("dy")).unionByName(
        lib_sub.select("part", F.col("sub_m").alias("m"), "dx", "dy")
    )
    # Dealt by part once, in a number of partitions that Spark does not bring down to the
    # size of these short rows: the cells that they grow to are merged where they are.
    use = use.repartition(int(use.sparkSession.conf.get("spark.sql.shuffle.partitions")), "part")
    now, scale = first, 1
    for layer in range(layers):
        if layer:
            # Of the parts below only those matter that are types above: a table of known size.
            now = stored(now.join(use.select("m").distinct(), "m", "left_semi"), "masks")
        cells = now.groupBy("m").agg(F.collect_list(F.struct("x", "y", "v")).alias("cells"))
        placed = with_model(use, "m", cells, "m").select("part", F.transform("_p.cells", lambda c: F.struct((c["x"] + F.col("dx") * F.lit(scale)).alias("x"), (c["y"] + F.col("dy") * F.lit(scale)).alias("y"), c["v"].alias("v"))).alias("cells"))
        every = F.array_sort(F.flatten(F.collect_list(F.transform("cells", lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), (-c["v"]).alias("low"))))))
        whole = placed.groupBy("part").agg(every.alias("cells"))
        # In this order the first of a place has the largest value.
        best = F.filter("cells", lambda c, i: (i == 0) | (F.get("cells", i - 1)["x"] != c["x"]) | (F.get("cells", i - 1)["y"] != c["y"]))
        now = whole.select(F.col("part").alias("m"), F.inline(best)).select("m", "x", "y", (-F.col("low")).alias("v"))
        scale *= contraction
    return now.withColumnRenamed("m", "part")


def regions(part_masks: DataFrame, least: float) -> DataFrame:
    """(part, n_cells, mx, my): cells of at least a value, and their centre."""
    return part_masks.where(F.col("v") >= least).groupBy("part").agg(F.count(F.lit(1)).alias("n_cells"), F.avg("x").alias("mx"), F.avg("y").alias("my"))


def equal_regions(part_masks: DataFrame, least: float) -> DataFrame:
    """(part, same_as): the smallest part with the same cells."""
    cells = part_masks.where(F.col("v") >= least).groupBy("part").agg(F.array_sort(F.collect_set(F.struct("x", "y"))).alias("cells"))
    return cells.select("part", F.min("part").over(Window.partitionBy("cells")).alias("same_as"))


def category_names(lib_center: DataFrame, names: DataFrame) -> DataFrame:
    """(part, name): the name of the category whose centre a part is, else empty;
    ``names`` is (m, name)."""
    return lib_center.join(names, F.col("part") == F.col("m"), "left").select("part", F.coalesce("name", F.lit("")).alias("name"))
