"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Document frequencies of the hashed 1- to 3-grams are counted over all training
rows (per-task partial counts, then a sum). The classifier is fitted on a
bounded sample of different texts: per language those with the smallest hashes, at most
``sample_rows`` in all (but one a language at least), a fifth of it for calibration.
Texts are told apart by a hash, so however many copies a text has, it is in the sample
once or not at all, and no language goes without. Training is
follow-the-regularised-leader (per-coordinate step sizes) with elastic-net
penalties, so most weights are exactly zero; a temperature fitted on the
calibration part then scales the logits. Prediction is one Arrow pass over whole
texts.

Cases: a text that is null or has no letter gives ``und`` with score 0; without
training rows every document does. Rows without lang, text or id do not train.
A null id is not held out. Repeated rows count in the document frequencies and once in
the sample; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partweave.llm.common import arrow_pass, stored
from partweave.llm.hashing import text_batches

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SPACE = 32
CHUNK = 1 << 20
#: Multipliers of an n-gram's code points.
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@cache
def _letters() -> np.ndarray:
    """Which code points are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def ngram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed n-grams of the lower-cased letters, runs of anything else
    as one space; None without letters."""
    if not text:
        return None
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    # Keep letters, and the first of each run of other characters.
    first = letter.copy()
    first[1:] |= letter[:-1]
    points = np.where(letter, points, SPACE)[first].astype(np.uint64)
    total = np.zeros(BUCKETS, dtype=np.int64)
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    for at in range(0, len(points), CHUNK):
        for n in ORDERS:
            own = points[at : at + CHUNK + n - 1]
            if len(own) < n:
                continue
            key = np.full(len(own) - n + 1, n, dtype=np.uint64)
            for k in range(n):
                key = (key ^ own[k : len(own) - n + 1 + k]) * FACTORS[k]
                key ^= key >> np.uint64(29)
            total += np.bincount(((key * FACTORS[0]) >> shift).astype(np.int64), minlength=BUCKETS)
    return total


def _vector(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    value = np.where(counts > 0, 1 + np.log(np.maximum(counts, 1)), 0) * idf
    return value / max(np.linalg.norm(value), 1e-12)


# --- training ----------------------------------------------------------------


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of this task's texts."""
    total, docs = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for text in batch.column("text"):
            counts = ngram_counts(text.as_py())
            if counts is not None:
                total += counts > 0
                docs += 1
    held = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(held, -1)), pa.array(np.append(total[held], docs))], ["bucket", "n"])


def _features(idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, where, value = [], [], []
            for name, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                counts = ngram_counts(text.as_py())
                if counts is None:
                    continue
                vector = _vector(counts, idf)
                held = np.flatnonzero(vector)
                lang.append(name)
                where.append(held.astype(np.int32).tobytes())
                value.append(vector[held].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(where, pa.binary()), pa.array(value, pa.binary())], ["lang", "at", "value"])

    return run


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(
    rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, *, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.5, epochs: int = 3
) -> np.ndarray:
    """Weights (BUCKETS, classes) of multinomial logistic regression by FTRL-proximal."""
    z = np.zeros((BUCKETS, classes))
    n = np.zeros((BUCKETS, classes))

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))

    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            label, at, value = rows[k]
            zi, ni = z[at], n[at]
            w = weights(zi, ni)
            p = _softmax(value @ w)
            p[label] -= 1
            g = value[:, None] * p[None, :]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[at] = zi + g - sigma * w
            n[at] = ni + g * g
    return weights(z, n)


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The scale of lowest log loss, by golden-section search on its logarithm."""

    def loss(log_t: float) -> float:
        p = _softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels]
        return -np.log(np.maximum(p, 1e-12)).mean()

    low, high, ratio = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) < loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def sample(train: DataFrame, sample_rows: int) -> DataFrame:
    """(lang, key) of the texts with the smallest hashes of each language, ``sample_rows``
    in all at most (one a language at least)."""
    keys = train.select("lang", "key").distinct()
    # Ranks are cut off on the map side, so a frequent language is no large group.
    ranked = keys.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("key"))).where(F.col("n") <= sample_rows)
    languages = ranked.agg(F.count_distinct("lang")).first()[0]
    return ranked.where(F.col("n") <= max(1, sample_rows // max(1, languages))).select("lang", "key")


def fit(train: DataFrame, sample_rows: int = 3000) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """(languages, idf, weights, temperature) from rows (key, lang, text)."""
    counted = {
        r["bucket"]: r["n"]
        for r in arrow_pass(train.select("text"), _frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    }
    docs = counted.pop(-1, 0)
    df = np.zeros(BUCKETS)
    for bucket, n in counted.items():
        df[bucket] = n
    idf = np.where(df > 0, np.log((1 + docs) / (1 + df)) + 1, 0)
    # Stored, so that Spark knows how small it is and need not shuffle the texts to meet it.
    chosen = stored(sample(train, sample_rows), "sample", files=1)
    # One row of each chosen text: whatever copies a text has, they are equal.
    texts = train.join(chosen, ["lang", "key"]).groupBy("lang", "key").agg(F.min("text").alias("text"))
    rows = arrow_pass(texts, _features(idf), "lang string, at binary, value binary").collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages or not docs:
        return [], idf, np.zeros((BUCKETS, 0)), 1.0
    number = {name: k for k, name in enumerate(languages)}
    rows = sorted((number[r["lang"]], bytes(r["at"]), bytes(r["value"])) for r in rows)
    rows = [(y, np.frombuffer(a, dtype=np.int32), np.frombuffer(v, dtype=np.float32).astype(float)) for y, a, v in rows]
    calibration, training = rows[::5], [r for k, r in enumerate(rows) if k % 5]
    weights = ftrl(training or rows, len(languages))
    logits = np.stack([v @ weights[a] for _, a, v in calibration])
    return languages, idf, weights, temperature(logits, np.array([y for y, _, _ in calibration]))


def _predictions(languages: list[str], idf: np.ndarray, weights: np.ndarray, scale: float, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole, "text"):
                names, scores = [], []
                for text in batch.column("text"):
                    counts = ngram_counts(text.as_py()) if languages else None
                    if counts is None:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    vector = _vector(counts, idf)
                    held = np.flatnonzero(vector)
                    p = _softmax(vector[held] @ weights[held] / scale)
                    names.append(languages[int(p.argmax())])
                    scores.append(float(p.max()))
                kept = [c for c in batch.schema.names if c != "text" or with_text]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in kept), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*kept, "lang_pred", "score"]
                )

    return run


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    keep: tuple[str, ...] = (),
    sample_rows: int = 3000,
) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document; rows that are held
    out do not train. With ``keep`` also text and those columns in a struct ``kept``."""
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        held_out(F.col(id_col)).alias("held_out"),
        F.col(text_col).alias("text"),
        F.col(lang_col).alias("lang"),
        *([F.struct(*keep).alias("kept")] if keep else []),
    )
    train = rows.where("doc_id IS NOT NULL AND NOT held_out AND lang IS NOT NULL AND text IS NOT NULL").select(
        F.xxhash64("text").alias("key"), "lang", "text"
    )
    model = fit(train, sample_rows)
    kept = f"text string, kept {rows.schema['kept'].dataType.simpleString()}, " if keep else ""
    return arrow_pass(
        rows.select("doc_id", "held_out", "text", *(["kept"] if keep else [])),
        _predictions(*model, with_text=bool(keep)),
        f"doc_id long, held_out boolean, {kept}lang_pred string, score double",
    )
