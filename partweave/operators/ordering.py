"""Running sums and numbers over a whole order, without a task that holds all rows.

Rows are range partitioned by key and order; each partition's sum is known before the
running sum within it begins. The only window over everything runs over the
partitions' sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partweave.sources.scratch import stored


def _column(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def running_sum(rows: DataFrame, keys: list[str], order: list[str | Column], value: Column, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` up to each row of its key, in ``order``."""
    by = [*map(F.col, keys), *map(_column, order)]
    dealt = stored(rows.withColumn("_value", value).repartitionByRange(*by).withColumn("_part", F.spark_partition_id()), "ordered")
    sums = dealt.groupBy(*keys, "_part").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_part").orderBy(*map(_column, order)).rowsBetween(Window.unboundedPreceding, 0)
    ran = dealt.withColumn("_within", F.sum("_value").over(within)).join(before, [*keys, "_part"])
    return ran.select(*rows.columns, (F.col("_before") + F.col("_within")).alias(name))


def numbered(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "rank") -> DataFrame:
    """``rows`` with their number in ``order`` within the key, from 1."""
    return running_sum(rows, keys, order, F.lit(1).cast("long"), name)
