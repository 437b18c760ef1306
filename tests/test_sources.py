"""Text sources, sinks and streams."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from partweave.functions import config
from partweave.operators import merging
from partweave.sources import sinks, text
from partweave.streaming import frames


def test_ground_truth_stops_at_the_first_bad_line(spark, tmp_path):
    (tmp_path / "a.groundtruth").write_text("  1 2 30.9 40 mug \n5 6 7 81\nbroken\n9 9 9 9 mug")
    (tmp_path / "b.groundtruth").write_text("")
    rows = text.read_ground_truth(spark, str(tmp_path)).orderBy("k").collect()
    assert [(r.llx, r.lly, r.urx, r.ury, r.label) for r in rows] == [(1, 2, 30, 40, "mug"), (5, 6, 7, 81, "")]
    assert text.read_ground_truth(spark, str(tmp_path), label="mug").count() == 1


def test_configuration(spark, tmp_path):
    (tmp_path / "c.cfg").write_text("a = 1 # x\nb.c = 2;b.from_namespace = d\nd.c = 9\nd.e = 7\na = 3\n")
    row = text.read_config(spark, str(tmp_path / "c.cfg")).select("conf", config.resolved(F.col("conf"), "b").alias("b"), config.with_namespaces(F.col("conf"), ["d"]).alias("w")).first()
    assert row.conf["a"] == "3" and row.b == {"c": "2", "e": "7"} and row.w == {"a": "3", "c": "9", "e": "7"}
    with pytest.raises(Exception, match="missing key zz"):
        text.read_config(spark, str(tmp_path / "c.cfg")).select(config.required(F.col("conf"), "zz", "int")).collect()


def test_literals_and_names(spark, tmp_path):
    row = spark.range(1).select(text.matrix_literal(F.lit("{{1,2},{3,4.5}}")).alias("m"), text.wildcard_pattern(F.lit("a*b?.ly")).alias("p")).first()
    assert row.m == [[1, 2], [3, 4.5]] and row.p == r"^a.*b.\.ly$"
    (tmp_path / "l").write_text("x_0.ly1\nx_1.ly1\n\ny.ly1\n")
    assert [(r.name, r.stem) for r in text.read_names(spark, str(tmp_path / "l")).collect()] == [("x_0.ly1", "x"), ("x_1.ly1", "x"), ("y.ly1", "y.ly1")]
    (tmp_path / "v").write_text("1 2,3\n4 x\n")
    assert [r.v for r in text.read_vectors(spark, str(tmp_path / "v")).collect()] == [[1, 2, 3], [4, None]]


def test_pyramids_round_trip(spark, tmp_path):
    nodes = spark.createDataFrame([(1, 0, 3, 4, 0, 0.5, 0.6, 0.7, 10), (1, 1, 3, 4, 2, 0.5, 0.6, 0.7, 11)], "image_id long, z int, x int, y int, m int, r double, g double, rr double, node_id long")
    edges = spark.createDataFrame([(11, 10, "toPrev")], "src long, dst long, name string")
    sinks.write_pyramids(nodes, edges, str(tmp_path / "p"))
    row = spark.read.parquet(str(tmp_path / "p")).first()
    assert [layer.z for layer in row.layer] == [0, 1] and row.layer[1].node[0].link == [10]


def _events(spark, path, n_files=3):
    rng = np.random.default_rng(3)
    rows = [(u, i, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}", float(rng.integers(0, 100)), "k") for i in range(60) for u in (1, 2)]
    df = spark.createDataFrame(rows, "user_id long, event_id long, ts string, value double, m string").withColumn("ts", F.to_timestamp("ts"))
    for k in range(n_files):
        df.where((F.col("event_id") >= 20 * k) & (F.col("event_id") < 20 * k + 20)).coalesce(1).write.mode("append").parquet(path)
    return df.withColumn("frame", F.expr("CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INT)"))


def _run(spark, out, tmp_path, name):
    q = out.writeStream.format("memory").queryName(name).outputMode("append" if name != "stats" else "complete").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_streams_agree_with_batch(spark, tmp_path):
    batch = _events(spark, str(tmp_path / "in"))
    read = lambda: spark.readStream.schema("user_id long, event_id long, ts timestamp, value double, m string").parquet(str(tmp_path / "in"))
    got = {(r.user_id, r.frame): (r.n, round(r.sum_value, 6), r.max_value) for r in _run(spark, frames.sliding_windows(read(), 5), tmp_path, "win").collect()}
    want = {(r.user_id, r.frame): (r.n, round(r.sum_value, 6), r.max_value) for r in merging.sliding_windows(batch, 5).collect()}
    assert got == want
    sessions = {(r.user_id, r.session): (r.n, round(r.mean_value, 6)) for r in _run(spark, frames.change_sessions(read(), 30.0), tmp_path, "ses").collect()}
    full = {(r.user_id, r.session - 1): (r.n, round(r.mean_value, 6)) for r in merging.change_sessions(batch, 30.0).collect()}
    last = {u: max(s for v, s in full if v == u) for u in (1, 2)}
    assert sessions == {k: v for k, v in full.items() if k[1] != last[k[0]]}
    stats = _run(spark, frames.running_statistics(read()), tmp_path, "stats").first()
    assert stats.n == 120 and stats.var_value == pytest.approx(batch.agg(F.var_samp("value")).first()[0])


def test_a_folder_without_a_scheme_lies_on_the_default_file_system(spark):
    from partweave.sources.scratch import qualified

    hadoop = spark._jsc.hadoopConfiguration()
    default = hadoop.get("fs.defaultFS")
    try:
        hadoop.set("fs.defaultFS", "viewfs://store/")
        hadoop.set("fs.viewfs.mounttable.store.link./ckpt", "file:///tmp/elsewhere")
        assert qualified(spark, "/ckpt") == "viewfs://store/ckpt"
        assert qualified(spark, "file:///tmp/here").startswith("file:/")
    finally:
        hadoop.set("fs.defaultFS", default)
    assert qualified(spark, "/ckpt").startswith("file:/")


def test_workers_import_the_package_from_another_working_folder(tmp_path):
    """A zip of the package, as executors get it by ``--py-files``."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = shutil.make_archive(str(tmp_path / "partweave"), "zip", root, "partweave")
    code = f"""
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
spark.sparkContext.addPyFile({archive!r})
from partweave.functions import arrays
def run(frames):
    from partweave.functions import arrays
    for f in frames:
        yield f
print("rows", spark.range(3).mapInPandas(run, "id long").count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert "rows 3" in out.stdout, out.stderr[-2000:]
