"""Bounded runs of streams: all that is there now, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from partweave.sources.scratch import new_path


def _run(stream: DataFrame, mode: str) -> str:
    """Process what the sources hold; the folder with the result and the log. A batch
    that is tried again replaces what it wrote; in complete mode the last one stays."""
    folder = new_path(stream.sparkSession, "stream")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/part" if mode == "complete" else f"{folder}/out/part-{number}")

    run = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return folder


def _result(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/out")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], stream.schema)  # no batch came
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """The result of all that the sources hold, as a table in the shared folder."""
    return _result(stream.sparkSession, stream, _run(stream, mode))


def run_with_state(stream: DataFrame, mode: str = "append") -> tuple[DataFrame, DataFrame]:
    """The result, and the state (key, value) that the stream's operator still holds,
    by Spark's state reader."""
    spark = stream.sparkSession
    folder = _run(stream, mode)
    return _result(spark, stream, folder), spark.read.format("statestore").load(f"{folder}/log")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of frames."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.selectExpr("user_id", "event_id", "ts", "CAST(value AS DOUBLE) AS value", "event_type AS m")
