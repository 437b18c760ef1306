"""N-gram Jaccard join with Bayesian candidate pruning.

Documents are sets of five-word shingles. Equal sets (two 64-bit sums and the size)
form a class of exact copies, numbered when the classes are stored; one text stands
for it. A class has 96 MinHash values of 16 bits, in 24 bands of 4; classes that
agree in a band share a bucket.

Candidates are the pairs that share a bucket, never closures of it. So that sets
travel few times, a class has a home: of the largest buckets of the classes that it
meets the one that most have. A home whose sets are over ``block_weight`` is split by a
hash. A class goes to the task of each pair (its home, the home of a class that shares a
bucket with it), one row each, and a task compares the members of the one home with those
of the other, so each pair meets in exactly one task. A hot bucket thus becomes pairs of
blocks, and a chain of documents that are each near their neighbours only becomes as many
small tasks as it has links. Signatures go to the tasks first; a task names the members of
which some pair is not ruled out, and only their sets follow.

Within a task MinHash values are read a few at a time, and a pair is dropped as soon
as the posterior probability (uniform prior) that its similarity reaches the
threshold falls below the tolerance. The rest are verified exactly on their shingle
sets. A task returns link counts and a spanning forest, never the pairs themselves.

With 24 bands of 4 a pair of similarity 0.8 shares no band with probability
3e-6, one of 0.9 with 1e-11; the tolerance loses less than 1e-5 of links.

Cases: a text with 1 to 4 words is one shingle; a text without words (or null)
has no links and is its own class; repeated rows are copies; a null doc_id takes
part and never becomes the class id unless the class has no other. Extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import arrow_pass, stored
from partweave.llm.components import ROWS_PER_FILE, components
from partweave.llm.hashing import RUN_BASES, Words, mix, rolling_hash, span_hash, text_batches

SHINGLE = 5
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
STEP = 8
#: Shingles of a block of a home, at 8 bytes each; the signature of a class counts as 64.
BLOCK_WEIGHT = 1_000_000
SIGNATURE_WEIGHT = 64
#: Tasks that compare more pairs than this part of all do it by matrices.
DENSE = 0.02
#: Of a tile of the matrix form.
TILE = 2048


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    k = np.arange(1, HASHES + 1, dtype=np.uint64)
    return mix(k) | np.uint64(1), mix(k + np.uint64(1 << 32))


def shingle_sets(words: Words, n: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each document."""
    h = words.hash
    grams = rolling_hash(h, n, RUN_BASES[0])
    for a, b in zip(words.first[:-1], words.first[1:], strict=True):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield span_hash(h, np.array([a]), np.array([b]), RUN_BASES[1])
        else:
            yield np.zeros(0, dtype=np.uint64)


def minhash(shingles: np.ndarray) -> np.ndarray:
    """HASHES values: the low 16 bits of least 32-bit hashes."""
    a, b = _coefficients()
    low = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint64)
    for at in range(0, len(shingles), 4096):
        part = (shingles[at : at + 4096, None] * a + b) >> np.uint64(32)
        np.minimum(low, part.min(axis=0), out=low)
    return low.astype(np.uint16)


def _set_hashes(shingles: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit sums over a set."""
    return tuple(int(mix(mix(shingles ^ np.uint64(k)).sum(dtype=np.uint64, keepdims=True)).view(np.int64)[0]) for k in RUN_BASES)


def _signatures(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_batches(whole, "text"):
            hashes, sizes, signatures = [], [], []
            for shingles in shingle_sets(Words(batch.column("text")), n):
                hashes.append(_set_hashes(shingles))
                sizes.append(len(shingles))
                signatures.append(minhash(shingles).tobytes() if len(shingles) else None)
            h1, h2 = zip(*hashes, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("uid"), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sizes, pa.int32()), pa.array(signatures, pa.binary())],
                ["doc_id", "uid", "h1", "h2", "size", "signature"],
            )


def _shingles(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    """The members' shingle sets, a row a task. Rows of one text follow one another, and its
    set is computed once; of a repeated row one is enough."""
    seen: set[tuple] = set()
    last: tuple[bytes | None, bytes] = (None, b"")
    for whole in batches:
        for batch in text_batches(whole, "text"):
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("a", "b", "node")), strict=True))
            kept = []
            for k, key in enumerate(keys):
                if key not in seen:
                    seen.add(key)
                    kept.append(k)
            if not kept:
                continue
            own = batch.take(pa.array(kept))
            uids = own.column("uid").to_pylist()
            first = [k for k, u in enumerate(uids) if u != (uids[k - 1] if k else last[0])]
            new = iter([x.tobytes() for x in shingle_sets(Words(own.column("text").take(pa.array(first, pa.int64()))), n)])
            sets, starts = [], set(first)
            for k, u in enumerate(uids):
                if k in starts:
                    last = (u, next(new))
                sets.append(last[1])
            names = [c for c in own.schema.names if c not in ("text", "uid")]
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "shingles"])


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """For h = STEP, 2 STEP, ...: the fewest agreeing values of h with which the
    posterior P(similarity >= threshold) is at least ``tolerance``. Under a uniform
    prior it is P(Binomial(h + 1, threshold) <= matches)."""
    out = []
    for h in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, 0
        for m in range(h + 1):
            total += comb(h + 1, m) * threshold**m * (1 - threshold) ** (h + 1 - m)
            if total >= tolerance:
                break
        out.append(m)
    return out


def _pruned(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, count: np.ndarray, first: int, least: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs that survive the pruning steps from ``first`` on; ``count`` values agree before it."""
    for step in range(first, len(least)):
        if not len(i):
            break
        at = slice(step * STEP, (step + 1) * STEP)
        for low in range(0, len(i), 1 << 18):
            part = slice(low, low + (1 << 18))
            count[part] += (left[i[part], at] == right[j[part], at]).sum(axis=1)
        held = count >= least[step]
        i, j, count = i[held], j[held], count[held]
    return i, j


def dense_pairs(left: np.ndarray, right: np.ndarray, same: bool, least: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs whose signatures survive every pruning step, of all pairs, tile by tile."""
    for a in range(0, len(left), TILE):
        for b in range(a if same else 0, len(right), TILE):
            l, r = left[a : a + TILE], right[b : b + TILE]
            agree = np.zeros((len(l), len(r)), dtype=np.uint8)
            for k in range(STEP):
                agree += l[:, k, None] == r[None, :, k]
            i, j = np.nonzero(agree >= least[0])
            if same and a == b:
                i, j = i[i < j], j[i < j]
            i, j = _pruned(l, r, i, j, agree[i, j].astype(np.int64), 1, least)
            yield i + a, j + b


def bucket_pairs(left: np.ndarray, right: np.ndarray, same: bool, least: list[int], most: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The same for the pairs that share a band, each once; None if their buckets hold
    more than ``most`` pairs."""
    bands = [np.ascontiguousarray(x).view(np.uint64) for x in (left, right)]
    keys, total, parts = [], 0, []
    for b in range(BANDS):
        order = np.argsort(bands[1][:, b], kind="stable")
        held = bands[1][order, b]
        lo, hi = np.searchsorted(held, bands[0][:, b], "left"), np.searchsorted(held, bands[0][:, b], "right")
        total += int((hi - lo).sum()) - (len(left) if same else 0)
        if total > most:
            return None
        parts.append((order, lo, hi))
    for order, lo, hi in parts:
        n = hi - lo
        i = np.repeat(np.arange(len(left)), n)
        j = order[np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)]
        keys.append((i * len(right) + j)[i < j] if same else i * len(right) + j)
    pairs = np.unique(np.concatenate(keys))
    i, j = pairs // len(right), pairs % len(right)
    return _pruned(left, right, i, j, np.zeros(len(i), dtype=np.int64), 0, least)


def shared(left: list[np.ndarray], right: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The exact number of common shingles of each pair (i, j)."""
    if len(i) < 64 or len(i) < 0.02 * len(left) * len(right):
        return np.array([len(np.intersect1d(left[a], right[b], assume_unique=True)) for a, b in zip(i, j, strict=True)], dtype=np.int64)
    # Many pairs: 0/1 matrices over the shingles that both sides hold, multiplied slice by slice.
    lrow, lval = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.concatenate(left)
    rrow, rval = np.repeat(np.arange(len(right)), [len(x) for x in right]), np.concatenate(right)
    common = np.intersect1d(lval, rval)
    lin, rin = np.isin(lval, common), np.isin(rval, common)
    lrow, rrow = lrow[lin], rrow[rin]
    lcol, rcol = np.searchsorted(common, lval[lin]), np.searchsorted(common, rval[rin])
    total = np.zeros((len(left), len(right)), dtype=np.float32)
    for at in range(0, len(common), 4096):
        a = np.zeros((len(left), min(4096, len(common) - at)), dtype=np.float32)
        b = np.zeros((len(right), a.shape[1]), dtype=np.float32)
        for m, row, col in ((a, lrow, lcol), (b, rrow, rcol)):
            own = (col >= at) & (col < at + a.shape[1])
            m[row[own], col[own] - at] = 1
        total += a @ b.T
    return total[i, j].astype(np.int64)


def _forest(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``label`` names the smallest index of each index's component; the same with edges (i, j)."""
    while len(i):
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for end in (i, j, label[i], label[j]):
            np.minimum.at(new, end, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    return label


def _candidates(sides: list[pd.DataFrame], least: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs, within a home (one side) or between two, that the signatures do not rule out."""
    same = len(sides) == 1
    sig = [np.stack([np.frombuffer(x, dtype=np.uint16) for x in s["signature"]]) for s in sides]
    found = bucket_pairs(sig[0], sig[-1], same, least, max(10_000, int(DENSE * len(sig[0]) * len(sig[-1]))))
    yield from dense_pairs(sig[0], sig[-1], same, least) if found is None else [found]


def _linked(sides: list[pd.DataFrame], threshold: float, least: list[int]) -> pd.DataFrame:
    """Links within a home (one side) or between two."""
    same = len(sides) == 1
    sets = [[np.frombuffer(x, dtype=np.uint64) for x in s["shingles"]] for s in sides]
    size = [np.array([len(x) for x in s]) for s in sets]
    nodes = np.concatenate([s["node"].to_numpy() for s in sides])
    copies = np.concatenate([s["copies"].to_numpy() for s in sides])
    links, texts, label = np.zeros(len(nodes)), np.zeros(len(nodes), dtype=np.int64), np.arange(len(nodes))
    for i, j in _candidates(sides, least):
        if not len(i):
            continue
        # Only the sets of this tile's pairs are looked at.
        rows, cols = np.unique(i), np.unique(j)
        inter = shared([sets[0][a] for a in rows], [sets[-1][b] for b in cols], np.searchsorted(rows, i), np.searchsorted(cols, j))
        held = inter + 1e-9 >= threshold * (size[0][i] + size[-1][j] - inter)
        i, j = i[held], j[held] if same else j[held] + len(sides[0])
        links += np.bincount(i, copies[j], len(nodes)) + np.bincount(j, copies[i], len(nodes))
        texts += np.bincount(i, minlength=len(nodes)) + np.bincount(j, minlength=len(nodes))
        label = _forest(label, i, j)
    out = pd.DataFrame({"node": nodes, "links": links.astype(np.int64), "texts": texts, "to": nodes[label]})
    return out[out["texts"] > 0]


def _open(sides: list[pd.DataFrame], least: list[int]) -> pd.DataFrame:
    """The members that are in some candidate pair of the task."""
    held = [np.zeros(len(s), dtype=bool) for s in sides]
    for i, j in _candidates(sides, least):
        held[0][i] = True
        held[-1][j] = True
    return pd.concat([s.loc[h, ["node", "home", "a", "b"]] for s, h in zip(sides, held, strict=True)])


LINKS = "node long, links long, texts long, to long"
MET = "node long, home long, a long, b long"


def row_key(id_col: str, text_col: str) -> Column:
    """128 bits of a row's id and text, nulls apart from empty ones."""
    parts = [F.when(F.col(c).isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), F.col(c).cast("string"))) for c in (id_col, text_col)]
    return F.unhex(F.md5(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")))


def _tasks(frame: pd.DataFrame, work, columns: list[str]) -> pd.DataFrame:
    """``work`` on each task (a, b) of a group: the members of one home, or of two."""
    found = []
    # A rerun or a repeated row may bring a class twice.
    frame = frame.drop_duplicates(["a", "b", "node"])
    for (a, b), own in frame.groupby(["a", "b"], sort=False):
        sides = [own] if a == b else [own[own["home"] == a], own[own["home"] == b]]
        if len(own) > 1 and all(len(s) for s in sides):
            found.append(work(sides))
    return pd.concat(found) if found else pd.DataFrame({c: [] for c in columns}, dtype="int64")


def jaccard_classes(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    threshold: float = 0.8,
    tolerance: float = 1e-6,
    n: int = SHINGLE,
    block_weight: int = BLOCK_WEIGHT,
) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id among the documents
    that links connect), copy_id (smallest doc_id with an equal shingle set),
    n_copies, n_links (documents of similarity >= threshold, copies included) and
    n_linked_texts (different shingle sets among them)."""
    least = least_matches(threshold, tolerance)
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), row_key(id_col, text_col).alias("uid"), F.col(text_col).alias("text")
    )
    signed = stored(
        arrow_pass(rows, lambda b: _signatures(b, n), "doc_id long, uid binary, h1 long, h2 long, size int, signature binary"), "signatures"
    )
    classes = (
        signed.where("size > 0")
        .groupBy("h1", "h2", "size")
        .agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")).alias("head"),
            F.count(F.lit(1)).alias("copies"),
            F.first("signature").alias("signature"),
        )
        .withColumn("node", F.monotonically_increasing_id())
    )
    classes = stored(classes, "classes")
    found = stored(_links(rows, classes, threshold, least, n, block_weight), "links")
    linked = components(found.select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    known = (
        classes.select("node", "h1", "h2", "size", "head", "copies")
        .join(counts, "node", "left")
        .join(linked, "node", "left")
        .withColumn("root", F.coalesce("root", "node"))
    )
    known = stored(known, "known", files=_files(classes))
    heads = known.groupBy("root").agg(F.min("head").alias("first"))
    info = known.join(heads, "root").select("h1", "h2", "size", "head", "copies", "links", "texts", "first")
    alone = F.col("size") == 0
    return signed.select("doc_id", "uid", "h1", "h2", "size").join(info, ["h1", "h2", "size"], "left").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("head.doc_id")).alias("copy_id"),
        F.coalesce("copies", F.lit(1)).alias("n_copies"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("texts", F.lit(0)).alias("n_linked_texts"),
        "uid",
        (alone | (F.col("uid") == F.col("first.uid"))).alias("keeper"),
    )


def _files(rows: DataFrame) -> int:
    return 1 + rows.count() // ROWS_PER_FILE


def meetings(classes: DataFrame, block_weight: int) -> DataFrame:
    """(node, home, a, b): of each class that shares a bucket the pairs (a, b) of homes, one
    of them its own, whose members it is compared with."""
    bands = classes.select(
        "node",
        F.explode(
            F.transform(
                F.sequence(F.lit(0), F.lit(BANDS - 1)),
                lambda b: F.xxhash64(b, F.substring(F.col("signature"), 2 * ROWS * b + 1, F.lit(2 * ROWS))),
            )
        ).alias("key"),
    )
    sizes = bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared_bands = stored(bands.join(sizes, "key"), "bands")
    largest = shared_bands.groupBy("node").agg(F.max(F.struct("n", "key")).alias("top")).select("node", F.col("top.key").alias("bucket"))
    # Of the buckets that are homes of those it meets, a class takes the one chosen most
    # often, so that near copies share a home although their largest buckets differ.
    chosen = shared_bands.select("node", "key").join(largest.join(largest.groupBy("bucket").count(), "bucket"), "node")
    leading = chosen.groupBy("key").agg(F.max(F.struct("count", "bucket")).alias("lead"))
    largest = shared_bands.join(leading, "key").groupBy("node").agg(F.max("lead").alias("lead")).select("node", F.col("lead.bucket").alias("bucket"))
    weighed = largest.join(classes.select("node", (F.col("size") + SIGNATURE_WEIGHT).alias("weight")), "node")
    parts = weighed.groupBy("bucket").agg(F.ceil(F.sum("weight") / block_weight).cast("int").alias("parts"))
    homes = stored(
        weighed.join(parts, "bucket").select("node", F.xxhash64("bucket", F.pmod(F.xxhash64("node"), F.col("parts"))).alias("home")), "homes"
    )
    held = shared_bands.select("node", "key").join(homes, "node")
    # The homes that meet in a bucket, as rows; most buckets have one.
    several = held.groupBy("key").agg(F.min("home").alias("low"), F.max("home").alias("high")).where("low <> high").select("key")
    mixed = stored(held.join(several, "key"), "mixed")
    others = mixed.select("key", F.col("home").alias("other")).distinct()
    # A class meets a home once, in however many of its 24 buckets.
    met = mixed.join(others, "key").where("home <> other").select("node", "home", "other").distinct()
    every = homes.select("node", "home", F.col("home").alias("other")).unionByName(met)
    return every.select("node", "home", F.least("home", "other").alias("a"), F.greatest("home", "other").alias("b"))


def _links(rows: DataFrame, classes: DataFrame, threshold: float, least: list[int], n: int, block_weight: int) -> DataFrame:
    """LINKS of all tasks. Signatures travel first; sets only to tasks where the pruning
    leaves a pair of theirs."""
    tasks = stored(meetings(classes, block_weight), "tasks")
    groups = max(1, 4 * SIGNATURE_WEIGHT * tasks.count() // block_weight)
    # Tasks are grouped by a hash; a task is at most two blocks.
    group = lambda count: F.pmod(F.xxhash64("a", "b"), F.lit(count)).alias("grp")
    signed = tasks.join(classes.select("node", "signature"), "node").select(group(groups), "node", "home", "a", "b", "signature")
    open_ = stored(signed.groupBy("grp").applyInPandas(lambda f: _tasks(f, lambda s: _open(s, least), ["node", "home", "a", "b"]), MET), "open")
    members = open_.join(classes.select("node", F.col("head.uid").alias("uid"), "size", "copies", "signature"), "node")
    total = members.agg(F.sum(F.col("size") + SIGNATURE_WEIGHT)).first()[0] or 0
    groups = max(1, 4 * total // block_weight)
    # The members' texts return as shingle sets; only classes in some candidate pair are needed.
    with_sets = arrow_pass(
        rows.select("uid", "text").join(members.drop("size"), "uid").select("uid", "node", "home", "a", "b", "copies", "signature", "text"),
        lambda b: _shingles(b, n),
        f"{MET}, copies long, signature binary, shingles binary",
    )
    dealt = with_sets.select(group(groups), "a", "b", "node", "home", "copies", "signature", "shingles")
    return dealt.groupBy("grp").applyInPandas(lambda f: _tasks(f, lambda s: _linked(s, threshold, least), ["node", "links", "texts", "to"]), LINKS)


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: its smallest id. Rows without words all
    stay, but a row that is repeated as a whole stays once."""
    uid = row_key(id_col, text_col)
    keepers = jaccard_classes(docs, id_col=id_col, text_col=text_col, **options).where("keeper").groupBy(F.col("uid").alias("_uid")).agg(F.count(F.lit(1)).alias("_n"))
    rows = docs.select(uid.alias("_uid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(keepers.hint("shuffle_hash"), "_uid")
    # Both parts read one shuffle of the texts; only repeated rows are grouped.
    once, repeated = joined.where("_n = 1"), joined.where("_n > 1").dropDuplicates(["_uid"])
    return once.unionByName(repeated).select("row.*")
