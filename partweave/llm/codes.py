"""Vector code compression: product codes whose nearest entries are found by norm.

Components become integers floor(scale * x); a vector is cut into equal parts, each with
a codebook of its own. The codebooks begin as the parts of the vectors with the smallest
ids; each round assigns every part to its nearest entry and moves the entries to the
floors of their parts' means. All arithmetic is on integers, so the result does not
depend on how the rows lie.

The nearest entry is searched by annular pruning. By the triangle inequality an entry at
distance d from a vector has a norm within d of the vector's norm. Entries are sorted by
norm; a vector first looks at the entry of the nearest norm, then binary searches the
interval of norms that its best distance allows, inclusively, and evaluates that annulus
exactly. It does so in two steps, first among the closest norms, so that the second
annulus is narrow. Vectors of a batch take each step together.

A round is one pass over the rows: a task sums its parts by entry before anything is
shuffled, and the sums that meet are bounded by the codebooks' size. Sums travel in
limbs of 32 bits, so that no number of rows overflows them. The codebooks alone pass
through the driver.

Cases: rows whose vector is null, or holds a null or non-finite component, are dropped,
and so are those whose length is not that of the first vector (smallest id, null ids
last). A length that the parts do not divide is filled up with zeros. Fewer vectors than
entries give a smaller codebook. Repeated rows count each; repeated ids at the border of
the first codebook are ordered by their components. Components beyond 2**23 after scaling
are computed with unbounded integers; an error beyond a long is given as the largest
long. Equal distances go to the lower index. Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import arrow_pass, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Norms looked at before the annulus is cut a second time.
NEAR = 8
#: Vectors searched together.
BLOCK = 2048
#: Up to here squared distances and their sums stay exact in 64 bits.
SMALL = 1 << 23
LONG = (1 << 63) - 1
LIMB = 32


def integers(vectors: np.ndarray, scale: int, parts: int) -> np.ndarray:
    """floor(scale * x) of each component, filled up to a multiple of ``parts``: 64-bit
    integers, or Python's where those would not do."""
    scaled = np.floor(vectors.astype(np.float64) * scale)
    if not len(scaled) or np.abs(scaled).max(initial=0) <= SMALL:
        out = scaled.astype(np.int64)
    else:
        out = np.array([[int(x) for x in row] for row in scaled], dtype=object)
    extra = -out.shape[1] % parts
    return np.concatenate([out, np.zeros((len(out), extra), out.dtype)], axis=1) if extra else out


@dataclass
class Tally:
    """Entries evaluated, of those that a full search would have evaluated."""

    looked: int = 0
    all: int = 0


class Annuli:
    """A codebook sorted by norm."""

    def __init__(self, entries: np.ndarray):
        squares = (entries * entries).sum(axis=1)
        self.order = np.lexsort((np.arange(len(entries)), squares.astype(float)))
        self.entries = entries[self.order]
        self.norms = np.sqrt(squares[self.order].astype(float))

    def _least(self, rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The least (distance, index) among the entries low..high - 1 of each row."""
        count = high - low
        begin = np.cumsum(count) - count
        row = np.repeat(np.arange(len(rows)), count)
        at = np.arange(int(count.sum())) - np.repeat(begin - low, count)
        gap = rows[row] - self.entries[at]
        square = np.einsum("ij,ij->i", gap, gap) if gap.dtype != object else (gap * gap).sum(axis=1)
        # Distance and index in one number: ties go to the lower index.
        key = square * len(self.entries) + self.order[at]
        best = np.minimum.reduceat(key, begin)
        return best // len(self.entries), (best % len(self.entries)).astype(np.int64)

    def nearest(self, rows: np.ndarray, tally: Tally | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each row's nearest entry."""
        n = len(self.entries)
        norm = np.sqrt((rows * rows).sum(axis=1).astype(float))
        place = np.searchsorted(self.norms, norm)
        low = np.maximum(0, np.minimum(place - NEAR // 2, n - NEAR))
        high = np.minimum(n, low + NEAR)
        best, index = self._least(rows, low, high)
        # Inclusive, and a little wider than rounding can err.
        reach = np.sqrt(best.astype(float)) * (1 + 1e-9) + 1e-6 * (1 + norm)
        ring_low, ring_high = np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")
        for lo, hi in ((ring_low, np.minimum(low, ring_high)), (np.maximum(high, ring_low), ring_high)):
            open_ = np.flatnonzero(hi > lo)
            if len(open_):
                other, own = self._least(rows[open_], lo[open_], hi[open_])
                closer = (other < best[open_]) | ((other == best[open_]) & (own < index[open_]))
                best[open_[closer]], index[open_[closer]] = other[closer], own[closer]
        if tally is not None:
            tally.looked += int((high - low + np.maximum(0, np.minimum(low, ring_high) - ring_low) + np.maximum(0, ring_high - np.maximum(high, ring_low))).sum())
            tally.all += n * len(rows)
        return index, best


def _blocks(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            own = batch.slice(at, BLOCK)
            vectors = own.column("vector")
            yield own, vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), length)


def _limbs(value: int) -> list[int]:
    """value = sum of limb k * 2**(32 k); only the last may be negative."""
    out = []
    while not -(1 << 31) <= value < 1 << 31:
        out.append(value & ((1 << LIMB) - 1))
        value >>= LIMB
    return [*out, value]


def _sums(books: list[np.ndarray], length: int, scale: int):
    """Of this task's parts: their sums and number by part, entry and position (-1: the number)."""
    parts, annuli, size = len(books), [Annuli(b) for b in books], books[0].shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, len(books[0]), size), dtype=object)
        count = np.zeros((parts, len(books[0])), dtype=np.int64)
        for _, vectors in _blocks(batches, length):
            rows = integers(vectors, scale, parts)
            for part in range(parts):
                own = rows[:, part * size : (part + 1) * size]
                index, _ = annuli[part].nearest(own)
                held, place = np.unique(index, return_inverse=True)
                sums = np.zeros((len(held), size), dtype=own.dtype)
                np.add.at(sums, place, own)
                total[part, held] += sums.astype(object)
                count[part, held] += np.bincount(place)
        out = []
        for part, entry in zip(*np.nonzero(count), strict=True):
            out.append((part, entry, -1, 0, count[part, entry]))
            out += [(part, entry, k, limb, v) for k in range(size) for limb, v in enumerate(_limbs(int(total[part, entry, k])))]
        columns = list(zip(*out, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array([int(x) for x in c], pa.int64()) for c in columns], ["part", "entry", "position", "limb", "value"])

    return run


@dataclass
class Codebooks:
    """Entries of each part, the vectors' length, and the scale of the integers."""

    books: list[np.ndarray]
    length: int
    scale: int

    def digest(self) -> str:
        """Of all components in decimal, by part, entry and position."""
        return hashlib.sha256(",".join(str(int(x)) for b in self.books for row in b for x in row).encode()).hexdigest()

    def decode(self, code: list[int]) -> list[float]:
        """The middle of the cells that a code stands for."""
        flat = [(float(x) + 0.5) / self.scale for b, k in zip(self.books, code, strict=True) for x in b[k]]
        return flat[: self.length]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has components, all of them numbers."""
    odd = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0)).where(~F.coalesce(odd, F.lit(False)))


def train_codebooks(rows: DataFrame, *, scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """From rows (id, vector) of usable vectors; None without any."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "vector").limit(1).collect()
    if not first:
        return None
    length = len(first[0]["vector"])
    kept = rows.where(F.size("vector") == length)
    begin = kept.orderBy(F.col("id").asc_nulls_last(), "vector").limit(entries).collect()
    whole = integers(np.array([r["vector"] for r in begin], dtype=np.float64), scale, parts)
    size = whole.shape[1] // parts
    books = [whole[:, k * size : (k + 1) * size] for k in range(parts)]
    for _ in range(rounds):
        partial = arrow_pass(kept.select("vector"), _sums(books, length, scale), "part long, entry long, position long, limb long, value long")
        sums: dict[tuple, int] = {}
        for r in partial.groupBy("part", "entry", "position", "limb").agg(F.sum("value").alias("value")).collect():
            key = (r["part"], r["entry"], r["position"])
            sums[key] = sums.get(key, 0) + (r["value"] << (LIMB * r["limb"]))
        moved = []
        for part, book in enumerate(books):
            new = [[sums[part, e, k] // n for k in range(size)] if (n := sums.get((part, e, -1))) else [int(x) for x in book[e]] for e in range(len(book))]
            small = all(abs(x) <= SMALL for row in new for x in row)
            moved.append(np.array(new, dtype=np.int64 if small else object))
        books = moved
    return Codebooks(books, length, scale)


def _codes(found: Codebooks):
    annuli, parts = [Annuli(b) for b in found.books], len(found.books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, vectors in _blocks(batches, found.length):
            rows = integers(vectors, found.scale, parts)
            size = rows.shape[1] // parts
            pairs = [annuli[k].nearest(rows[:, k * size : (k + 1) * size]) for k in range(parts)]
            error = sum(d for _, d in pairs)
            error = np.array([min(int(e), LONG) for e in error], dtype=np.int64) if error.dtype == object else error
            index = np.stack([i for i, _ in pairs], axis=1).astype(np.int32)
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * parts)
            code = pa.ListArray.from_arrays(offsets, pa.array(index.reshape(-1)))
            yield pa.RecordBatch.from_arrays([own.column("id"), own.column("label"), code, pa.array(error)], ["id", "label", "code", "error"])

    return run


def compress(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = SCALE, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code array, error) of each usable vector, and the codebooks."""
    rows = usable(df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")), "vector")
    found = train_codebooks(rows.select("id", "vector"), scale=scale, parts=parts, entries=entries, rounds=rounds)
    schema = f"id long, label {rows.schema['label'].dataType.simpleString()}, code array<int>, error long"
    if found is None:
        return df.sparkSession.createDataFrame([], schema), None
    return arrow_pass(rows.where(F.size("vector") == found.length), _codes(found), schema), found


def code_report(df: DataFrame, **options) -> DataFrame:
    """vec_id, code in hex, error, label_error and the codebooks' digest of each usable vector."""
    codes, found = compress(df, **options)
    codes = stored(codes, "codes")
    by_label = codes.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    hexed = F.array_join(F.transform("code", lambda k: F.lower(F.lpad(F.hex(k), 2, "0"))), "")
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("_label"))).select(
        F.col("id").alias("vec_id"), hexed.alias("code"), "error", "label_error", F.lit(found.digest() if found else None).cast("string").alias("codebooks_sha256")
    )
