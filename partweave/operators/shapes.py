"""Shape models: principal axes of each key's vectors, and what they say of a vector.

States (number, sum, sum of products) are summed per task and key, travel as one row a
key and task, and add up; so they merge over jobs and hot keys alike. A key's axes come
from its own state, a matrix of the vectors' length, in a task of its own. Projections
join a vector to its key's model and stay in JVM-side array functions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE = "n long, sums array<double>, products array<double>"


def _kind(df: DataFrame, key: str) -> str:
    return df.schema[key].dataType.simpleString()


#: States that a task holds before those of equal keys are summed.
HELD = 100_000


def covariance_states(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, n, sums, products) of each key and task; null vectors do not count."""

    def summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of equal keys, added up."""
        number, names = pd.factorize(keys)
        order = np.argsort(number, kind="stable")
        return names, np.add.reduceat(rows[order], np.flatnonzero(np.diff(number[order], prepend=-1)), axis=0)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, most = [], HELD
        for frame in frames:
            if not len(frame):
                continue
            x = np.stack(frame[vector].to_list()).astype(float)
            rows = np.hstack([np.ones((len(x), 1)), x, (x[:, :, None] * x[:, None]).reshape(len(x), -1)])
            held.append(summed(frame[key].to_numpy(), rows))
            if sum(len(k) for k, _ in held) > most:
                held = [summed(np.concatenate([k for k, _ in held]), np.concatenate([r for _, r in held]))]
                most = max(HELD, 2 * len(held[0][0]))
        if held:
            keys, rows = summed(np.concatenate([k for k, _ in held]), np.concatenate([r for _, r in held]))
            d = int(np.sqrt(rows.shape[1]))  # 1 + d + d * d columns
            for i in range(0, len(keys), HELD):
                some = rows[i : i + HELD]
                yield pd.DataFrame({key: keys[i : i + HELD], "n": some[:, 0].astype(np.int64), "sums": list(some[:, 1 : d + 1]), "products": list(some[:, d + 1 :])})

    return vectors.where(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(key, vector).mapInPandas(run, f"{key} {_kind(vectors, key)}, {STATE}")


def merged_states(states: DataFrame, key: str) -> DataFrame:
    """One state a key. Places of the arrays are summed one by one, on the map side too."""
    n = states.groupBy(key).agg(F.sum("n").alias("n"))
    for name in ("sums", "products"):
        each = states.select(key, F.posexplode(name).alias("_at", "_v")).groupBy(key, "_at").agg(F.sum("_v").alias("_v"))
        whole = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda p: p["_v"]).alias(name))
        n = n.join(whole, key)
    return n


def covariances(states: DataFrame, key: str) -> DataFrame:
    """(key, i, j, cov) of merged states, i <= j, by the number of vectors."""
    d = F.size("sums")
    pairs = states.select(key, "n", "sums", F.posexplode("products").alias("at", "p")).withColumns({"i": F.floor(F.col("at") / d).cast("int"), "j": (F.col("at") % d).cast("int")})
    mean = lambda c: F.get("sums", F.col(c)) / F.col("n")
    return pairs.where("i <= j").select(key, "i", "j", (F.col("p") / F.col("n") - mean("i") * mean("j")).alias("cov"))


def shape_models(states: DataFrame, key: str, *, most: int | None = None, share: float = 1.0) -> DataFrame:
    """(key, n, mean, eigenvalues, eigenvectors) of merged states: the axes of largest
    variance first, as many as hold ``share`` of it, ``most`` at most. An axis's largest
    component (the first of equals) is positive. A key of one vector has no axes."""
    schema = f"{key} {_kind(states, key)}, n long, mean array<double>, eigenvalues array<double>, eigenvectors array<array<double>>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, n, sums, products in frame[[key, "n", "sums", "products"]].itertuples(index=False):
                mean = np.asarray(sums) / n
                cov = np.asarray(products).reshape(len(mean), -1) / n - np.outer(mean, mean)
                values, axes = np.linalg.eigh((cov + cov.T) / 2)
                values, axes = np.maximum(values[::-1], 0), axes.T[::-1]
                held = np.cumsum(values)
                count = 0 if held[-1] <= 1e-12 else int(np.searchsorted(held, share * held[-1] * (1 - 1e-12))) + 1
                count = min(count, most or count)
                lead = np.abs(np.round(axes, 9)).argmax(axis=1)
                axes = axes * np.sign(axes[np.arange(len(axes)), lead])[:, None]
                rows.append((k, n, list(mean), list(values[:count]), [list(a) for a in axes[:count]]))
            yield pd.DataFrame(rows, columns=[key, "n", "mean", "eigenvalues", "eigenvectors"])

    return states.select(key, "n", "sums", "products").mapInPandas(run, schema)


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def projected(vectors: DataFrame, models: DataFrame, key: str, vector: str, mask: str | None = None) -> DataFrame:
    """``vectors`` with, by their key's model, coefficients on its axes, the reconstruction,
    the distance to it, and the density exp(-1/2 sum c**2 / eigenvalue) over axes of some
    variance. ``mask`` names an array of 0 and 1: only places of 1 take part in the
    coefficients and in the distance, all are reconstructed."""
    met = vectors.join(models.select(key, "mean", "eigenvalues", "eigenvectors"), key)
    own = F.col(mask) if mask else F.transform("mean", lambda _: F.lit(1.0))
    gap = F.zip_with(F.zip_with(F.col(vector), F.col("mean"), lambda x, m: x - m), own, lambda g, w: g * w)
    met = met.withColumn("_gap", gap).withColumn("coefficients", F.transform("eigenvectors", lambda a: _dot(a, F.col("_gap"))))
    terms = F.zip_with("eigenvectors", "coefficients", lambda a, c: F.transform(a, lambda x: x * c))
    back = F.aggregate(terms, F.col("mean"), lambda s, t: F.zip_with(s, t, lambda x, y: x + y))
    met = met.withColumn("reconstruction", back)
    off = F.zip_with(F.zip_with(F.col(vector), F.col("reconstruction"), lambda x, y: (x - y) * (x - y)), own, lambda d, w: d * w)
    scaled = F.zip_with("coefficients", "eigenvalues", lambda c, v: F.when(v > 0.01, c * c / v).otherwise(0.0))
    return met.withColumns({
        "distance": F.sqrt(F.aggregate(off, F.lit(0.0), lambda s, x: s + x)),
        "density": F.exp(-F.aggregate(scaled, F.lit(0.0), lambda s, x: s + x) / 2),
    }).drop("_gap", "mean", "eigenvalues", "eigenvectors")
