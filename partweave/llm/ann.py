"""Nearest neighbours by a hash-prefix forest.

The vectors are cut into shards by a hash string (signs of random projections), at
quantiles of the strings, so that a shard holds neighbouring ones; where one string
has too many vectors a hash of the row splits them. A directory, one row a shard, holds
each shard's centre and radius. Queries go to shards, the corpus stays:
each query first visits the shard whose centre is nearest, then only those shards
whose bound, centre times query plus radius times the query's length, reaches the
k-th best score so far, and they return only what reaches it. Vectors and queries of a shard meet in one partition, vectors
first, so a task builds the shard's forest once and streams its queries through it;
a shard with more than ``query_block`` queries is searched by several tasks.

A forest has, per tree, a sorted array of long hash strings: 64 bits drawn from a pool
of signs of random projections (inner products become angles by one more coordinate
that fills vectors up to the shard's largest norm). A query descends each tree to its
longest prefix match and then all trees ascend in step: the candidates at prefix length
x share x leading bits with the query in some tree, and between two lengths one part of
the trees after another goes up. Where the ascent stops is measured, not assumed: the
exact neighbours of a few of the shard's own vectors tell by which step all but ``miss``
of them are found. It goes on where a query has less than k candidates, to the whole
shard if need be. So there is no cap on candidates, and hard data cost more instead of
losing recall. Candidates are scored on the original vectors in double precision; a window
over the queries merges the shards' results.

Of equal vectors only the k + 1 smallest ids can be among the k nearest of any
query, so the others are not indexed; they are queries all the same.

Cases: vectors that are null, empty, zero or hold a null or non-finite component
take no part, nor do null ids. Exactly repeated rows count once. Rows that share an
id but not the vector are queries of their own, and candidates of each other. Vectors
of different lengths never meet. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from partweave.llm.common import stored

#: Trees of a shard, bits of a string, and the signs from which strings draw their bits.
TREES, BITS, POOL = 256, 64, 1024
#: Of a shard: rows, and bytes of its vectors as doubles.
SHARD_ROWS, SHARD_BYTES = 32_768, 32 << 20
#: Vectors whose exact neighbours tell where the ascent stops, and parts of the trees that
#: go up one after another.
MEASURED, PARTS = 64, 8
QUERY_BLOCK = 32_768
#: Bits of the hash string by which shards are cut.
ORDER_BITS = 48
#: Of the shards' directory, which goes to every task.
DIRECTORY_BYTES = 256 << 20
RESULT = "query_row long, query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def _unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions, and lengths up to one common factor, whatever the magnitude."""
    vectors = vectors.astype(np.float64)
    own = np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / own
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / norms, norms[:, 0] * (own[:, 0] / own.max())


def _shared(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """The number of leading bits that two strings share."""
    differ, out = a ^ b, np.zeros(np.broadcast(a, b).shape, dtype=np.int16)
    for x in range(1, bits + 1):
        same = differ >> np.uint64(bits - x) == 0
        if not same.any():
            break
        out += same
    return out


class Forest:
    def __init__(self, vectors: np.ndarray, trees: int = TREES, bits: int = BITS, seed: int = 7):
        self.vectors, self.trees, self.bits = vectors, trees, bits
        unit, norms = _unit(vectors)
        norms = norms / norms.max()
        #: Scaled so that the longest has length 1.
        self.small = (unit * norms[:, None]).astype(np.float32)
        self.fill = np.sqrt(np.maximum(1 - norms**2, 0)).astype(np.float32)
        rng = np.random.default_rng(seed)
        self.planes = rng.standard_normal((vectors.shape[1] + 1, POOL)).astype(np.float32)
        self.picks = np.stack([rng.permutation(POOL)[:bits] for _ in range(trees)])
        codes = self._codes(self.small, self.fill).T
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, axis=1)
        self.stops: dict[tuple, tuple[int, int]] = {}
        #: Vectors looked at, of all that a search of every query over all would look at.
        self.looked = self.all = 0

    def _codes(self, vectors: np.ndarray, last: np.ndarray) -> np.ndarray:
        out = np.empty((len(vectors), self.trees), dtype=np.uint64)
        pad = np.zeros((1024, 64 - self.bits), dtype=bool)
        for at in range(0, len(vectors), 1024):
            signs = vectors[at : at + 1024] @ self.planes[:-1] + last[at : at + 1024, None] * self.planes[-1] > 0
            for t, pick in enumerate(self.picks):
                packed = np.packbits(np.concatenate([pad[: len(signs)], signs[:, pick]], axis=1), axis=1)
                out[at : at + 1024, t] = packed.view(">u8")[:, 0]
        return out

    def stop(self, k: int, miss: float) -> tuple[int, int]:
        """(x, t): the ascent stops at prefix length x, with the first t trees one above."""
        if (k, miss) not in self.stops:
            self.stops[k, miss] = self._measured(k, miss)
        return self.stops[k, miss]

    def _measured(self, k: int, miss: float) -> tuple[int, int]:
        n = len(self.vectors)
        if n <= 2 * k:
            return 0, 0
        own = np.unique(np.linspace(0, n - 1, MEASURED).astype(np.int64))
        unit = _unit(self.vectors[own])[0].astype(np.float32)
        scores = unit @ self.small.T
        scores[np.arange(len(own)), own] = -np.inf
        near = np.argpartition(-scores, k, axis=1)[:, :k]
        asked = self._codes(unit, np.zeros(len(own), dtype=np.float32))
        held = self._codes(self.small[near.ravel()], self.fill[near.ravel()]).reshape(len(own), k, self.trees)
        deep = _shared(asked[:, None, :], held, self.bits)
        # The longest match of each neighbour, over all trees and over the first parts of them.
        parts = [self.trees * p // PARTS for p in range(1, PARTS)]
        whole, upto = deep.max(axis=2), {t: deep[:, :, :t].max(axis=2) for t in parts if t}
        for x in range(int(whole.max()), 0, -1):
            for t in (0, *upto):
                found = whole >= x if not t else (whole >= x) | (upto[t] >= x - 1)
                if found.mean() >= 1 - miss:
                    return x, t
        return 0, 0

    def _ranges(self, codes: np.ndarray, x: int, trees: range) -> tuple[np.ndarray, np.ndarray]:
        """Where each query's first x bits stand, by tree."""
        low = np.zeros((self.trees, len(codes)), dtype=np.int32)
        high = np.zeros_like(low)
        rest = np.uint64((1 << (self.bits - x)) - 1)
        for t in trees:
            lead = codes[:, t] & ~rest
            low[t] = np.searchsorted(self.sorted[t], lead, side="left")
            high[t] = np.searchsorted(self.sorted[t], lead | rest, side="right")
        return low, high

    def search(self, queries: np.ndarray, k: int, miss: float) -> list[tuple[np.ndarray, np.ndarray]]:
        """Per query the rows of the k or more best found (all ties of the k-th) and their scores."""
        unit = _unit(queries)[0].astype(np.float32)
        codes = self._codes(unit, np.zeros(len(queries), dtype=np.float32))
        x, above = self.stop(k, miss)
        out: list = [None] * len(queries)
        open_ = np.arange(len(queries))
        mark = np.zeros(len(self.vectors), dtype=bool)
        while len(open_):
            if x:
                low, high = self._ranges(codes[open_], x, range(above, self.trees))
                if above:
                    more = self._ranges(codes[open_], x - 1, range(above))
                    low, high = low + more[0], high + more[1]
            left = []
            for k_, q in enumerate(open_):
                rows = self._union(low[:, k_], high[:, k_], mark) if x else np.arange(len(self.vectors))
                if len(rows) < k and x:
                    left.append(q)
                else:
                    out[q] = self._best(rows, unit[q], queries[q], k)
            open_, x, above = np.array(left, dtype=np.int64), max(x - 1, 0), 0
        return out

    def _union(self, low: np.ndarray, high: np.ndarray, mark: np.ndarray) -> np.ndarray:
        for t in np.flatnonzero(high > low):
            mark[self.order[t, low[t] : high[t]]] = True
        rows = np.flatnonzero(mark)
        mark[rows] = False
        return rows

    def _best(self, rows: np.ndarray, unit: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        self.looked += len(rows)
        self.all += len(self.vectors)
        near = (self.small[rows] if len(rows) < len(self.small) else self.small) @ unit
        if len(rows) > k:
            # Single precision screens; everything near the k-th stays for the exact score.
            kth = np.partition(near, len(near) - k)[len(near) - k]
            rows = rows[near >= kth - 1e-4]
        # A sum by row, so that equal vectors get equal scores wherever they stand.
        return rows, (self.vectors[rows].astype(np.float64) * query.astype(np.float64)).sum(axis=1)


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy())


def _strings(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hash string by which the corpus is sorted."""
    planes: dict[int, np.ndarray] = {}
    for frame in frames:
        code = np.zeros(len(frame), dtype=np.int64)
        sizes = frame["vector"].map(len).to_numpy()
        for dim in np.unique(sizes):
            if dim not in planes:
                planes[dim] = np.random.default_rng(1).standard_normal((dim, ORDER_BITS))
            own = np.flatnonzero(sizes == dim)
            signs = _unit(_stack(frame["vector"].iloc[own]))[0] @ planes[dim] > 0
            code[own] = signs @ (1 << np.arange(ORDER_BITS, dtype=np.int64)[::-1])
        yield frame.assign(code=code)


def _centre(frame: pd.DataFrame) -> pd.DataFrame:
    x = _stack(frame["vector"]).astype(np.float64)
    centre = x.mean(axis=0)
    radius = float(np.sqrt(((x - centre) ** 2).sum(axis=1)).max())
    return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "dim": [x.shape[1]], "centre": [centre], "radius": [radius]})


def _visits(directory: dict[int, tuple], first: bool):
    """Rows (query, shard): the first shard of each query, or all others that the
    bound does not rule out. ``kth`` is the k-th best score so far or null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in frames:
            for at in range(0, len(whole), 1024):
                frame = whole.iloc[at : at + 1024]
                sizes = frame["vector"].map(len).to_numpy()
                for dim in np.unique(sizes):
                    if dim not in directory:
                        continue
                    shards, centres, radii = directory[dim]
                    own = frame.iloc[np.flatnonzero(sizes == dim)]
                    x = _stack(own["vector"]).astype(np.float64)
                    with np.errstate(over="ignore", invalid="ignore"):
                        middle = x @ centres.T
                        bound = middle + np.linalg.norm(x, axis=1)[:, None] * radii
                    # Sums that leave the range of doubles rule nothing out.
                    home = np.nan_to_num(middle, nan=0.0, posinf=0.0, neginf=0.0).argmax(axis=1)
                    if first:
                        yield own.assign(shard=shards[home])
                        continue
                    kth = own["kth"].to_numpy(dtype=np.float64, na_value=-np.inf)
                    slack = 1e-9 * (1 + np.abs(bound))
                    go = ~(bound + slack < kth[:, None])
                    go[np.arange(len(own)), home] = False
                    i, j = np.nonzero(go)
                    yield own.iloc[i].assign(shard=shards[j])

    return run


def _search(k: int, miss: float, trees: int, bits: int):
    """Streams partitions sorted by shard and part, vectors (asks false) before queries."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, parts, forest, rows, ids = None, [], None, None, None
        for whole in frames:
            for (key, asks), frame in whole.groupby([whole["shard"].astype(str) + "/" + whole["dim"].astype(str) + "/" + whole["part"].astype(str), "asks"], sort=False):
                if key != at:
                    at, parts, forest = key, [], None
                if not asks:
                    parts.append(frame[["row", "vec_id", "vector"]])
                    continue
                if forest is None:
                    if not parts:
                        continue
                    corpus = pd.concat(parts)
                    parts, rows, ids = [], corpus["row"].to_numpy(), corpus["vec_id"].to_numpy()
                    forest = Forest(_stack(corpus["vector"]), trees, bits)
                for low in range(0, len(frame), 512):
                    yield _best(forest, rows, ids, frame.iloc[low : low + 512], k, miss)

    return run


def _best(forest: Forest, rows: np.ndarray, ids: np.ndarray, queries: pd.DataFrame, k: int, miss: float) -> pd.DataFrame:
    found = []
    # One more than k: the query itself may be among its nearest.
    results = forest.search(_stack(queries["vector"]), k + 1, miss)
    least = queries["kth"].to_numpy(dtype=np.float64, na_value=-np.inf)
    for own, own_id, kth, (at, scores) in zip(queries["row"], queries["vec_id"], least, results, strict=True):
        other = (rows[at] != own) & ~(scores < kth)
        at, scores = at[other], scores[other]
        best = np.lexsort((ids[at], -scores))[:k]
        found.append(pd.DataFrame({"query_row": own, "query_id": own_id, "vec_id": ids[at[best]], "score": scores[best]}))
    return pd.concat(found)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    miss: float = 0.05,
    trees: int = TREES,
    bits: int = BITS,
    shard_rows: int = SHARD_ROWS,
    shard_bytes: int = SHARD_BYTES,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each row with ``is_query``
    among all rows but its own, by inner product, ties to the smaller id. Of the neighbours measured in a shard at
    most ``miss`` may be passed over."""
    of = vectors.schema[vector_col].dataType
    kept = "array<float>" if isinstance(of, ArrayType) and isinstance(of.elementType, FloatType) else "array<double>"
    rows = (
        vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col)))
        .select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kept).alias("vector"), is_query.alias("asks"))
        .dropDuplicates(["vec_id", "vector"])
        .withColumn("row", F.monotonically_increasing_id())
    )
    rows = stored(rows, "vectors")
    same = Window.partitionBy("vector").orderBy("vec_id")
    corpus = rows.withColumn("copy", F.row_number().over(same)).where(F.col("copy") <= k + 1).select("row", "vec_id", "vector")
    coded = stored(corpus.mapInPandas(_strings, f"row long, vec_id long, vector {kept}, code long"), "strings")
    dealt = stored(_sharded(coded, shard_rows, shard_bytes), "corpus")
    directory = _directory(dealt)
    queries = rows.where("asks").select("row", "vec_id", "vector")
    columns = f"row long, vec_id long, vector {kept}, kth double, shard long"

    def searched(visits: DataFrame) -> DataFrame:
        asks = stored(visits.select("row", "vec_id", "vector", F.size("vector").alias("dim"), "shard", "kth"), "visits")
        blocks = asks.groupBy("shard", "dim").agg(F.ceil(F.count(F.lit(1)) / query_block).cast("int").alias("parts"))
        part = F.pmod(F.xxhash64("row"), F.col("parts")).cast("int").alias("part")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        columns = ["shard", "dim", "row", "vec_id", "vector"]
        none = F.lit(None).cast("double").alias("kth")
        both = dealt.join(blocks, ["shard", "dim"]).select(*columns, none, every, F.lit(False).alias("asks")).unionByName(
            asks.join(blocks, ["shard", "dim"]).select(*columns, "kth", part, F.lit(True).alias("asks"))
        )
        tasks = blocks.agg(F.sum("parts")).first()[0] or 1
        met = both.repartition(int(tasks), "shard", "dim", "part").sortWithinPartitions("shard", "dim", "part", "asks")
        return stored(met.mapInPandas(_search(k, miss, trees, bits), RESULT), "found")

    found = searched(queries.withColumn("kth", F.lit(None).cast("double")).mapInPandas(_visits(directory, True), columns))
    if sum(len(d[0]) for d in directory.values()) > 1:
        order = Window.partitionBy("query_row").orderBy(F.desc("score"))
        kth = found.withColumn("n", F.row_number().over(order)).where(F.col("n") == k).select(F.col("query_row").alias("row"), F.col("score").alias("kth"))
        more = queries.join(kth, "row", "left").select("row", "vec_id", "vector", "kth").mapInPandas(_visits(directory, False), columns)
        found = found.unionByName(searched(more))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sharded(coded: DataFrame, shard_rows: int, shard_bytes: int) -> DataFrame:
    """(row, vec_id, vector, dim, shard) of about ``shard_rows`` vectors a shard, fewer
    where these would pass ``shard_bytes`` as doubles."""
    count, longest = coded.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    shard_rows = max(1, min(shard_rows, shard_bytes // (8 * (longest or 1))))
    ranges = -(-count // shard_rows)
    cuts = coded.approxQuantile("code", [k / ranges for k in range(1, ranges)], 0.25 / ranges) if ranges > 1 else []
    at = np.unique(np.array(cuts, dtype=np.int64))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["row", "vec_id", "vector"]].assign(range=np.searchsorted(at, frame["code"].to_numpy(), side="right"))

    kept = coded.schema["vector"].dataType.simpleString()
    ranged = coded.mapInPandas(deal, f"row long, vec_id long, vector {kept}, range long")
    parts = ranged.groupBy("range").agg(F.ceil(F.count(F.lit(1)) / (2 * shard_rows)).cast("int").alias("parts"))
    split = F.col("range") * (1 << 20) + F.pmod(F.xxhash64("row"), F.col("parts"))
    return ranged.join(parts, "range").select("row", "vec_id", "vector", F.size("vector").alias("dim"), split.alias("shard"))


def _directory(dealt: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By vector length: shards, centres and radii. One row a shard, so its size is that
    of the corpus divided by ``shard_rows``; checked all the same."""
    table = stored(dealt.groupBy("shard", "dim").applyInPandas(_centre, "shard long, dim int, centre array<double>, radius double"), "directory", files=1)
    size = table.agg(F.sum(8 * (F.col("dim") + 3))).first()[0] or 0
    if size > DIRECTORY_BYTES:
        raise ValueError("the shards' directory is too large to send to tasks: raise shard_rows")
    out: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    frame = table.toPandas()
    for dim, own in frame.groupby("dim"):
        out[int(dim)] = (own["shard"].to_numpy(np.int64), np.stack(own["centre"].to_numpy()).astype(np.float64), own["radius"].to_numpy())
    return out
