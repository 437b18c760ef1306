"""Text sources: ground truth, configuration, point and vector lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NUMBER = r"[+-]?[0-9]+(?:\.[0-9]*)?"


def truth_boxes(text: Column) -> Column:
    """array<struct<llx,lly,urx,ury,label>> of a ground-truth text: a line holds
    ``llx lly urx ury [label]``; reading stops at the first line that does not
    parse; decimals are cut toward zero."""
    lines = F.transform(F.split(text, "\r?\n"), lambda s: F.trim(s))
    pattern = rf"^{NUMBER}\s+{NUMBER}\s+{NUMBER}\s+{NUMBER}(\s+\S+)?"
    bad = F.array_position(F.transform(lines, lambda s: ~F.rlike(s, F.lit(pattern))), True)
    good = F.when(bad == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(bad - 1, F.lit(0)).cast("int")))
    parts = F.transform(good, lambda s: F.split(s, r"\s+"))
    number = lambda p, k: p[k].cast("double").cast("int")
    return F.transform(
        parts,
        lambda p: F.struct(
            number(p, 0).alias("llx"), number(p, 1).alias("lly"), number(p, 2).alias("urx"), number(p, 3).alias("ury"),
            F.when(F.size(p) > 4, F.element_at(p, 5)).otherwise("").alias("label"),
        ),
    )


def read_ground_truth(spark: SparkSession, path: str, label: str | None = None, pattern: str = "*.groundtruth") -> DataFrame:
    """(file, k, llx, lly, urx, ury, label) of all files below a path."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    rows = files.select(F.col("_metadata.file_path").alias("file"), F.posexplode(truth_boxes(F.col("value"))).alias("k", "b")).select("file", "k", "b.*")
    return rows if label is None else rows.where(F.col("label") == label)


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """(name, stem): a list file's names; names that differ in a last ``_k`` share a stem."""
    lines = spark.read.text(path).select(F.trim("value").alias("name")).where("name <> ''")
    return lines.withColumn("stem", F.regexp_replace("name", r"_\d+(\.[^.]*)?$", ""))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """A double array per line of numbers separated by white space or commas."""
    return spark.read.text(path).select(F.transform(F.split(F.trim("value"), r"[\s,]+"), lambda s: s.try_cast("double")).alias("v"))


def read_rectangles(spark: SparkSession, path: str) -> DataFrame:
    """(name, llx, lly, urx, ury, value) of lines ``name llx lly urx ury [value]``; lines of
    another form are left out, a missing value is null."""
    parts = F.split(F.trim("value"), r"\s+")
    number = lambda k: F.try_element_at(F.col("p"), F.lit(k)).try_cast("double")
    rows = spark.read.text(path).select(parts.alias("p")).select(
        F.col("p")[0].alias("name"), *[number(k).cast("int").alias(c) for k, c in enumerate(("llx", "lly", "urx", "ury"), 2)], number(6).alias("value")
    )
    return rows.where("llx IS NOT NULL AND lly IS NOT NULL AND urx IS NOT NULL AND ury IS NOT NULL")


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """(name, k, x, y, w, h) of lines ``name: x y w h; x y w h``: the boxes of each name."""
    line = F.split(F.col("value"), ":", 2)
    boxes = F.filter(F.transform(F.split(line[1], ";"), lambda b: F.trim(b)), lambda b: b != "")
    rows = spark.read.text(path).where(F.col("value").contains(":")).select(F.trim(line[0]).alias("name"), F.posexplode(boxes).alias("k", "b"))
    numbers = F.transform(F.split("b", r"\s+"), lambda v: v.try_cast("int"))
    return rows.withColumn("n", numbers).select("name", "k", *[F.try_element_at("n", F.lit(i)).alias(c) for i, c in enumerate("xywh", 1)])


def read_matchings(spark: SparkSession, path: str) -> DataFrame:
    """(file, permutation, source, target) of files with a permutation, then source and
    target points as ``x y`` pairs, a line each."""
    lines = F.split(F.trim("value"), "\r?\n")
    numbers = lambda k: F.transform(F.split(F.trim(F.col("l")[k]), r"[\s,]+"), lambda v: v.try_cast("double"))
    pairs = lambda v: F.transform(F.sequence(F.lit(0), (F.size(v) / 2 - 1).cast("int")), lambda i: F.struct(v[2 * i].alias("x"), v[2 * i + 1].alias("y")))
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), lines.alias("l")).where("size(l) >= 3")
    return files.select("file", numbers(0).cast("array<int>").alias("permutation"), pairs(numbers(1)).alias("source"), pairs(numbers(2)).alias("target"))


def read_raw_numbers(spark: SparkSession, path: str, kind: str = "<f8") -> DataFrame:
    """(file, at, v): raw binary numbers of files, in order."""
    import numpy as np
    import pandas as pd

    def parse(frames):
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                values = np.frombuffer(content, dtype=kind, count=len(content) // np.dtype(kind).itemsize).astype(float)
                for at in range(0, len(values), 1 << 16):
                    part = values[at : at + (1 << 16)]
                    yield pd.DataFrame({"file": file, "at": np.arange(at, at + len(part)), "v": part})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(parse, "file string, at long, v double")


def read_config(spark: SparkSession, path: str) -> DataFrame:
    from partweave.functions.config import parse

    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("file"), parse(F.col("value")).alias("conf"))


def wildcard_pattern(text: Column) -> Column:
    """The regular expression of a wildcard: ``*`` any run, ``?`` one character."""
    quoted = F.regexp_replace(text, r"([.+^$(){}|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def matrix_literal(text: Column) -> Column:
    """``{{1,2},{3,4}}`` as array<array<double>>."""
    return F.from_json(F.translate(text, "{}", "[]"), "array<array<double>>")


def scale_of(name: Column) -> Column:
    """The number k of a file name ``..._k.ext``."""
    return F.regexp_extract(name, r"_(\d+)\.[^.]*$", 1).try_cast("int")
