"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Documents become token ids (an Arrow pass) and are cut into pieces; full pieces
fill a sequence each. The other pieces are dealt by a hash into shards of at most
``shard_size`` pieces, and a shard is packed on several islands. An individual is
a list of bins. An island starts from individuals that best-fit the pieces in a
random order. Crossover injects whole well-filled bins of one parent into the
other, removes the bins that hold a duplicate and best-fits the displaced pieces,
largest first, with those of the slackest bins. A child replaces the worst
individual if it has fewer or fuller bins and is like none of the others; a
population that no longer improves keeps its best and starts anew beside it. After each epoch an island keeps its
population and sends its elites to the next island of its shard (a shuffle on the
island's key); after the last one the best individual of the shard wins. An island
stops early only when it has as few bins as any packing can have.

Bins that a shard leaves slack go into the next level: their pieces are dealt anew
into fewer shards of the same bound, until one shard is left or a level hardly
lowers the number of bins; then the bins stay as they are. No task gets more than a
shard, however badly pieces combine. Copies are dealt over all shards by their row,
so each shard has its share of them and of their complements.

Cases: a null text is empty and gives the piece of id 0 alone; repeated rows are
packed as documents of their own; a null doc_id is kept; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import MEMORIES, arrow_pass, stored
from partweave.llm.hashing import text_batches

CAPACITY = 2048
END_ID = 0
SHARD = 4096
#: Of a sequence's number.
BIN_BITS, SHARD_BITS = 16, 40
ISLANDS, EPOCHS = 2, 2
#: An epoch ends after so many crossovers of a full shard (more of a smaller one, up to
#: MOST_CROSSOVERS); after IDLE in a row without a new best all but the best start anew.
POPULATION, CROSSOVERS, MOST_CROSSOVERS, IDLE, ELITES = 4, 24, 1000, 8, 2
SHARDS_PER_TASK, ISLANDS_PER_TASK, MOST_TASKS = 16, 8, 20_000
#: Bins at least this full are injected; those at least so full are not packed again.
GOOD, SETTLED = 0.998, 0.9995
#: A level that saves a smaller part than this of the bins that it packs again is the last.
LEAST_GAIN = 0.001
#: Words whose ids a worker remembers; past it the memory starts anew.
CACHE_WORDS = 600_000


# --- token ids ---------------------------------------------------------------


class Places(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __init__(self):
        super().__init__()
        self.order: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self.order)
        self.order.append(key)
        return n


# The vocabulary file's pre-token pattern, and its form for ASCII alone,
# where `re` would count \x1c to \x1f as white space and the file does not.
PRE_TOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
ASCII_PRE_TOKEN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\x09-\x0d\x20a-z0-9]+")


def _byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: printable
    Latin-1 characters stand for themselves, the others for 256, 257, ..."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class WordEncoder:
    """Ids of texts by way of their words: the vocabulary's pre-tokenizer drops
    white space and never joins across it, so a text's ids are its words' ids.
    A word is lower-cased and cut into pre-tokens here, as the file prescribes;
    the merges are the library's."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(t) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.clear()

    def clear(self) -> None:
        self.place = Places()
        self.parts: dict[str, list[int]] = {}
        self.ids: list[np.ndarray] = [np.zeros(0, np.uint32)]
        self.lengths: list[np.ndarray] = [np.zeros(0, np.int64)]

    def __call__(self, texts: pa.Array | list[str | None]) -> list[np.ndarray]:
        if len(self.place) > CACHE_WORDS:
            self.clear()
        known, number = len(self.place), self.place.__getitem__
        column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        words = pc.ascii_split_whitespace(pc.fill_null(column, ""))
        # Each different word of the batch is looked up once.
        own = words.flatten().dictionary_encode()
        places = np.fromiter(map(number, own.dictionary.to_numpy(zero_copy_only=False).tolist()), dtype=np.int64, count=len(own.dictionary))
        self._learn(self.place.order[known:])
        flat, length = np.concatenate(self.ids), np.concatenate(self.lengths)
        self.ids, self.lengths = [flat], [length]
        begin = np.cumsum(length) - length
        index = places[own.indices.to_numpy()]
        n = length[index]
        ends = np.concatenate([[0], np.cumsum(n)])
        # Where each word's ids begin in ``flat``, less where they go.
        ids = flat[np.arange(ends[-1]) + np.repeat(begin[index] - ends[:-1], n)]
        bounds = words.offsets.to_numpy()
        cuts = ends[bounds - bounds[0]].tolist()
        out = []
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            whole = np.empty(end - start + 1, dtype=np.uint32)
            whole[:-1] = ids[start:end]
            whole[-1] = END_ID
            out.append(whole)
        return out

    def _learn(self, words: list[str]) -> None:
        found: list[int] = []
        lengths: list[int] = []
        parts = self.parts
        for word in words:
            before = len(found)
            if "<" in word and any(t in word for t in self.special):
                found += self.tokenizer.encode(word, add_special_tokens=False).ids
            else:
                if word.isascii():
                    lower = word.lower()
                    pieces = (lower,) if lower.isalpha() else ASCII_PRE_TOKEN.findall(lower)
                else:
                    word = unicodedata.normalize("NFC", word)
                    # Letter by letter: only a sigma's lower case would look at its neighbours.
                    lower = word.lower() if "\u03a3" not in word else "".join([c.lower() for c in word])
                    pieces = PRE_TOKEN.findall(lower)
                for piece in pieces:
                    own = parts.get(piece)
                    if own is None:
                        own = parts[piece] = self._merge(piece)
                    found += own
            lengths.append(len(found) - before)
        self.ids.append(np.array(found, dtype=np.uint32))
        self.lengths.append(np.array(lengths, dtype=np.int64))

    def _merge(self, piece: str) -> list[int]:
        if not (piece.isascii() and piece.isprintable()):
            piece = piece.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenize(piece)]


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One a process: tasks that follow in a worker know its words."""
    return WordEncoder(path)


MEMORIES["words"] = encoder.cache_clear


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encode = encoder(path)
    for whole in batches:
        for batch in text_batches(whole, "text", 2 << 20):
            rows = []
            keys = zip(batch.column("doc_id").to_pylist(), batch.column("row_no").to_pylist(), strict=True)
            for (doc, row), ids in zip(keys, encode(batch.column("text")), strict=True):
                for piece, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at : at + capacity]
                    rows.append((doc, row, piece, at, len(own), zlib.crc32(own.astype("<u4").tobytes())))
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "row_no", "piece", "start", "length", "ids_crc32"]
            )


# --- the genetic algorithm on one shard --------------------------------------


@dataclass
class Packing:
    """An individual: the pieces of each bin, and how full the bins are."""

    bins: list[list[int]]
    fills: list[int]

    def score(self, capacity: int) -> tuple[int, float]:
        """Lower is better: the number of bins, then the mean squared fill."""
        return len(self.bins), -sum(f * f for f in self.fills) / (capacity * capacity * max(1, len(self.fills)))


@dataclass
class Tally:
    """What an epoch did."""

    crossovers: int = 0
    accepted: int = 0


def best_fit(lengths: list[int], start: Packing, loose: list[int], capacity: int) -> Packing:
    """Put each loose piece, in the order given, into the fullest bin that takes it."""
    bins, fills = start.bins, start.fills
    room = sorted((capacity - f, k) for k, f in enumerate(fills) if f < capacity)
    for item in loose:
        need = lengths[item]
        at = bisect_left(room, (need, -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(item)
            fills[k] += need
        else:
            left, k = capacity, len(bins)
            bins.append([item])
            fills.append(need)
        if left > need:
            insort(room, (left - need, k))
    return start


def crossover(lengths: list[int], mother: Packing, father: Packing, capacity: int, rng: random.Random) -> Packing:
    """The mother with well-filled bins of the father."""
    full = [k for k, f in enumerate(father.fills) if f >= GOOD * capacity]
    if not full:  # pieces that combine badly: the fuller half of the father's bins
        full = sorted(range(len(father.bins)), key=lambda k: -father.fills[k])[: -(-len(father.bins) // 2)]
    injected = [k for k in full if rng.random() < 0.5]
    child = Packing([list(father.bins[k]) for k in injected], [father.fills[k] for k in injected])
    taken = bytearray(len(lengths))
    for b in child.bins:
        for i in b:
            taken[i] = 1
    loose: list[int] = []
    kept = []
    for k, b in enumerate(mother.bins):
        own = [i for i in b if not taken[i]]
        if len(own) == len(b):
            kept.append(k)
        else:
            loose += own
    # The slackest bins give up their pieces as well.
    kept.sort(key=mother.fills.__getitem__)
    give = max(1, len(kept) // rng.choice((4, 16, 64)))
    for k in kept[:give]:
        loose += mother.bins[k]
    child.bins += [list(mother.bins[k]) for k in kept[give:]]
    child.fills += [mother.fills[k] for k in kept[give:]]
    loose.sort(key=lambda i: -lengths[i])
    return best_fit(lengths, child, loose, capacity)


def least_bins(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins: by total length, and by pieces over half a bin."""
    return max(-(-sum(lengths) // capacity), sum(2 * n > capacity for n in lengths))


def likeness(lengths: list[int], packing: Packing) -> int:
    """Equal for packings that differ by pieces of one length only."""
    return hash(tuple(sorted(tuple(sorted(lengths[i] for i in b)) for b in packing.bins)))


def evolve(lengths: list[int], pool: list[Packing], capacity: int, seed: int, tally: Tally | None = None) -> list[Packing]:
    """One epoch: the population, best first, of individuals that differ. ``pool`` is the
    population of the last epoch with the elites that came in; new individuals fill it up."""
    rng = random.Random(seed)
    tally = tally if tally is not None else Tally()
    least = least_bins(lengths, capacity)
    births = 0

    def entry(packing: Packing) -> tuple:
        nonlocal births
        births += 1
        return *packing.score(capacity), births, likeness(lengths, packing), packing

    def fresh() -> Packing:
        order = list(range(len(lengths)))
        rng.shuffle(order)
        return best_fit(lengths, Packing([], []), order, capacity)

    def ranking(found: list[tuple]) -> list[tuple]:
        alike: dict[int, tuple] = {}
        for e in sorted(found):
            alike.setdefault(e[3], e)
        return list(alike.values())[:POPULATION]

    ranked = ranking([entry(p) for p in pool] + [entry(fresh()) for _ in range(POPULATION - len(pool))])
    idle = 0
    for _ in range(min(MOST_CROSSOVERS, -(-CROSSOVERS * SHARD // max(1, len(lengths))))):
        if ranked[0][0] <= least:
            break
        if idle >= IDLE or len(ranked) < 2:  # what is left is alike: keep the best alone
            ranked, idle = ranking([ranked[0], *(entry(fresh()) for _ in range(POPULATION - 1))]), 0
            if len(ranked) < 2:
                break
        # The better of two is the mother, so that most children come near the best.
        a, b = sorted(rng.sample(range(len(ranked)), 2))
        child = entry(crossover(lengths, ranked[a][4], ranked[b][4], capacity, rng))
        tally.crossovers += 1
        idle += 1
        if (len(ranked) < POPULATION or child < ranked[-1]) and all(child[3] != r[3] for r in ranked):
            tally.accepted += 1
            idle = 0 if child < ranked[0] else idle
            ranked = ranking([*ranked, child])
    return [r[4] for r in ranked]


def _labels(packing: Packing, n: int) -> bytes:
    """The bin number of each piece."""
    out = np.empty(n, dtype=np.int32)
    for k, b in enumerate(packing.bins):
        out[b] = k
    return out.tobytes()


def _from_labels(labels: bytes, lengths: np.ndarray) -> Packing:
    bin_of = np.frombuffer(labels, dtype=np.int32)
    order = np.argsort(bin_of, kind="stable")
    cuts = np.flatnonzero(np.diff(bin_of[order])) + 1
    fills = np.bincount(bin_of, lengths).astype(np.int64)
    return Packing([part.tolist() for part in np.split(order, cuts)], fills.tolist())


POOL = "shard long, island int, rank int, bins int, score double, crossovers int, accepted int, body binary"


def _epoch(capacity: int, epoch: int):
    """The step of one island of one shard. Rows with ``kind`` 0 hold the lengths
    of the shard's pieces, rows with ``kind`` 1 an individual of the island or an
    elite that came in."""

    def step(frame: pd.DataFrame) -> pd.DataFrame:
        lengths = np.frombuffer(frame.loc[frame["kind"] == 0, "body"].iloc[0], dtype=np.int32)
        pool = [_from_labels(x, lengths) for x in sorted(frame.loc[frame["kind"] == 1, "body"])]
        shard, island = int(frame["shard"].iloc[0]), int(frame["island"].iloc[0])
        tally = Tally()
        best = evolve(lengths.tolist(), pool, capacity, hash((shard, island, epoch)) & 0xFFFFFFFF, tally)
        scores = [p.score(capacity) for p in best]
        return pd.DataFrame(
            {
                "shard": shard,
                "island": island,
                "rank": range(len(best)),
                "bins": [s[0] for s in scores],
                "score": [s[1] for s in scores],
                "crossovers": tally.crossovers,
                "accepted": tally.accepted,
                "body": [_labels(p, len(lengths)) for p in best],
            }
        )

    return step


ITEM = ("doc_id", "row_no", "piece", "start", "length", "ids_crc32")
PLACED = "doc_id long, row_no long, piece int, start long, length long, ids_crc32 long, shard long, bin int, offset long, fill long, opens boolean"


def deal(items: DataFrame, count: int, shard_size: int) -> tuple[DataFrame, int]:
    """(shard, items) of at most ``shard_size`` items each, and about how many."""
    # Six standard deviations below the bound; a shard over it all the same is split.
    mean = max(shard_size / 2, shard_size - 6 * shard_size**0.5)
    shards = 1 if count <= shard_size else int(-(-count // mean))
    keyed = items.withColumn("shard", F.pmod(F.xxhash64("row_no", "piece", F.lit(shards)), F.lit(shards)))
    order = ("length", *(c for c in ITEM if c != "length"))
    lists = keyed.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct(*order))).alias("all"))
    parts = F.ceil(F.size("all") / shard_size).cast("int")
    split = lists.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    own = F.filter("all", lambda x, i: i % F.col("parts") == F.col("part"))
    return split.select((F.col("shard") * 1024 + F.col("part")).alias("shard"), own.alias("items")), shards


def pack_level(items: DataFrame, count: int, shard_size: int, capacity: int) -> tuple[DataFrame, int]:
    """PLACED rows for ITEM rows, and the number of shards; one piece of each bin opens it."""
    dealt, shards = deal(items, count, shard_size)
    packed = stored(dealt, "shards", files=-(-shards // SHARDS_PER_TASK))
    # Islands are dear to compute and small to ship: a task for a few of them.
    tasks = min(MOST_TASKS, -(-shards * ISLANDS // ISLANDS_PER_TASK))
    islands = packed.select("shard", F.col("items.length").cast("array<int>").alias("lengths")).mapInPandas(
        lambda fs: (f.assign(kind=0, body=[np.asarray(x, dtype=np.int32).tobytes() for x in f["lengths"]])[["shard", "kind", "body"]] for f in fs),
        "shard long, kind int, body binary",
    )
    islands = islands.select("shard", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), "kind", "body")
    pool = None
    for epoch in range(EPOCHS):
        rows = islands
        if pool is not None:
            here, there = F.col("island"), F.pmod(F.col("island") + 1, F.lit(ISLANDS))
            to = F.when((F.col("rank") < ELITES) & (here != there), F.array(here, there)).otherwise(F.array(here))
            rows = islands.unionByName(pool.select("shard", F.explode(to).alias("island"), F.lit(1).alias("kind"), "body"))
        pool = rows.repartition(tasks, "shard", "island").groupBy("shard", "island").applyInPandas(_epoch(capacity, epoch), POOL)
    best = pool.groupBy("shard").agg(F.min_by("body", F.struct("bins", "score", "island", "rank")).alias("best"))
    placed = packed.join(best, "shard").mapInPandas(_placed, PLACED)
    return stored(placed, "placed", files=-(-shards // SHARDS_PER_TASK)), shards


def _placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        for shard, items, best in zip(frame["shard"], frame["items"], frame["best"], strict=True):
            own = pd.DataFrame([x if isinstance(x, dict) else x.asDict() for x in items])
            own["shard"], own["bin"] = shard, np.frombuffer(best, dtype=np.int32)
            grouped = own.groupby("bin")["length"]
            own["fill"] = grouped.transform("sum")
            own["offset"] = grouped.cumsum() - own["length"]
            own["opens"] = ~own["bin"].duplicated()
            yield own[[c.split()[0] for c in PLACED.split(", ")]]


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    shard_size: int = SHARD,
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset per piece. Sequence
    ids are numbers, not hashes: even ones for pieces that fill a sequence, odd ones
    made of level, shard and bin."""
    if not 0 < shard_size <= 1 << BIN_BITS:
        raise ValueError("a bin's number must fit its bits")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_no"), F.col(text_col).alias("text"))
    pieces = stored(
        arrow_pass(
            rows,
            lambda b: _pieces(b, tokenizer_path, capacity),
            "doc_id long, row_no long, piece int, start long, length long, ids_crc32 long",
            remembers="words",
        ),
        "pieces",
    )
    result = ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    out = pieces.where(F.col("length") == capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (2 * F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.where(F.col("length") < capacity).select(*ITEM)

    def settled(placed: DataFrame, level: int) -> DataFrame:
        number = (F.lit(level).cast("long") * (1 << SHARD_BITS) + F.col("shard")) * (1 << BIN_BITS) + F.col("bin")
        return out.unionByName(placed.withColumn("sequence_id", 2 * number + 1).select(*result))

    level, count = 1, rest.count()
    open_bins, open_placed = None, None
    while count:
        placed, shards = pack_level(rest, count, shard_size, capacity)
        slack = F.col("fill") < SETTLED * capacity
        bins, slack_bins, left = placed.agg(F.count_if("opens"), F.count_if(F.col("opens") & slack), F.count_if(slack)).first()
        if open_bins is not None and bins > open_bins:
            out = settled(open_placed, level - 1)
            break
        if shards == 1 or (open_bins is not None and bins > (1 - LEAST_GAIN) * open_bins):
            out = settled(placed, level)
            break
        out = settled(placed.where(~slack), level)
        open_placed = placed.where(slack)
        rest = open_placed.select(*ITEM)
        count, open_bins, level = left, slack_bins, level + 1
    return out
