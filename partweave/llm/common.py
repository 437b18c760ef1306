"""Shared helpers: table reading, the shared scratch folder, stored intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partweave.sources.scratch import shared_folder

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``)."""
    return shared_folder(spark)


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch_dir(spark)}/partweave/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete this application's intermediate tables. Call it when the results
    that were made from them are written: DataFrames read them lazily."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str, files: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and
    the rows outlive any executor. ``files`` bounds the files of a table whose
    size is known to be small."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    (df if files is None else df.coalesce(files)).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch; texts can be long, so a row count alone bounds no memory.
BATCH_BYTES = "4m"


#: What a Python worker remembers between tasks, by name, and how to drop it.
MEMORIES: dict[str, Callable[[], None]] = {}


def arrow_pass(df: DataFrame, function, schema: str, remembers: str = "") -> DataFrame:
    """``df.mapInArrow(function, schema)`` in batches of a few megabytes. Workers are
    reused, so a task first drops what passes other than ``remembers`` left."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)

    def run(batches):
        for name, drop in MEMORIES.items():
            if name != remembers:
                drop()
        return function(batches)

    return df.mapInArrow(run, schema)
