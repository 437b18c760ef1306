"""Kernel classifiers: support vector machines on an explicit map of the kernel.

Components are scaled to 0..1 by the training rows. A radial kernel is mapped by landmarks:
the map's inner products are the kernel's own among the landmarks, and its best
approximation from them elsewhere; with every training row a landmark it is exact. The
machine is then linear in the map and trained by Spark's solver, which passes over the
rows and sums gradients; landmarks and weights are a model of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.sources.scratch import stored


@dataclass
class KernelMachine:
    """low, span: of each component; landmarks, root: of the map; weights, bias."""

    low: np.ndarray
    span: np.ndarray
    landmarks: np.ndarray
    root: np.ndarray
    gamma: float
    weights: np.ndarray
    bias: float

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low) / self.span

    def mapped(self, x: np.ndarray) -> np.ndarray:
        return kernel(self.scaled(x), self.landmarks, self.gamma) @ self.root

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.weights + self.bias


def kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    d2 = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(d2, 0))


def component_ranges(rows: DataFrame, vector: str) -> tuple[np.ndarray, np.ndarray]:
    """(least, span) of each component; a component that never varies has the span 1."""
    each = rows.select(F.posexplode(vector).alias("at", "v")).groupBy("at").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    found = each.orderBy("at").collect()  # a row a component
    low = np.array([r["low"] for r in found], dtype=float)
    span = np.array([r["high"] for r in found], dtype=float) - low
    return low, np.where(span > 0, span, 1.0)


def train(rows: DataFrame, *, vector: str, label: str, gamma: float, landmarks: int = 128, penalty: float = 0.01, rounds: int = 100) -> KernelMachine:
    """``label`` is 0 or 1. Landmarks are the different vectors of the smallest hashes, so the
    same rows give the same machine however they lie; null vectors or labels do not train."""
    train_rows = rows.where(F.col(vector).isNotNull() & F.col(label).isNotNull()).select(F.col(vector).cast("array<double>").alias("v"), F.col(label).cast("double").alias("label"))
    low, span = component_ranges(train_rows, "v")
    if not len(low):
        raise ValueError("no rows to train on")
    chosen = train_rows.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(landmarks).collect()
    machine = KernelMachine(low, span, np.zeros((0, len(low))), np.zeros((0, 0)), gamma, np.zeros(0), 0.0)
    machine.landmarks = machine.scaled(np.array([r["v"] for r in chosen]))
    values, axes = np.linalg.eigh(kernel(machine.landmarks, machine.landmarks, gamma))
    held = values > 1e-10 * values.max()
    machine.root = axes[:, held] / np.sqrt(values[held])

    def mapped(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                yield pd.DataFrame({"label": frame["label"], "phi": list(machine.mapped(np.stack(frame["v"].to_list())))})

    # Each pass of the solver reads the map's rows again.
    phi = stored(train_rows.mapInPandas(mapped, "label double, phi array<double>"), "phi").select("label", array_to_vector("phi").alias("features"))
    fitted = LinearSVC(maxIter=rounds, regParam=penalty, standardization=False, tol=1e-8).fit(phi)
    machine.weights, machine.bias = np.asarray(fitted.coefficients.toArray()), float(fitted.intercept)
    return machine


def margins(rows: DataFrame, machine: KernelMachine, *, vector: str) -> DataFrame:
    """``rows`` with the machine's margin (null for a null vector) in one pass."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", margin double"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            held = frame[vector].notna().to_numpy()
            out = np.full(len(frame), np.nan)
            if held.any():
                out[held] = machine.margin(np.stack([np.asarray(v, dtype=float) for v in frame.loc[held, vector]]))
            yield frame.assign(margin=pd.Series(out, index=frame.index, dtype=object).where(held, None))

    return rows.mapInPandas(run, schema)
