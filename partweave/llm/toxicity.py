"""Toxicity: multiple-instance learning over sentences.

A document is a bag of sentences. A sentence's probability is a logistic function of
its words (hashed, lower-cased letter runs, each counted once); the document's is the
noisy-or of its sentences, 1 - prod(1 - p). Only document labels train: the gradient of the noisy-or
likelihood gives a toxic document's blame to the sentences that explain it, so words
that merely stand in the same document keep no weight. An L1 penalty leaves most weights
at zero. Beginnings of words are features like words, since an insult may be inflected.

The model is fitted on a bounded sample of different labelled texts: per label those
with the smallest hashes, at most ``sample_rows`` in all and ``sample_chars`` characters.
The labels of an equal text are averaged, so copies count once. The smaller class is
not drowned: each label gets half of the sample where it has so many texts, and rows are
weighted back to the labels' frequencies. Prediction is one Arrow pass over whole texts;
sentences over a probability of ``offending`` are located by their code points.

Cases: a null or empty text, or one without a letter, has no sentence and the score 0;
without training rows all scores are 0. Rows without label, text or id do not train; a
null id is not held out. Repeated rows are scored each and train once; extra columns are
ignored; an empty table gives an empty result. A sentence of over a million characters
is scored in pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partweave.llm.common import arrow_pass, stored
from partweave.llm.hashing import span_hash, text_batches
from partweave.llm.langid import _letters

BITS = 18
WORD_BASE = 0x9E3779B97F4A7C15
#: Lengths of the word beginnings that are features beside the word.
PREFIXES = (3, 4, 5, 6)
#: Code points looked at together.
CHUNK = 1 << 20
THRESHOLD = 0.7
_ENDS = np.array([ord(c) for c in ".!?\n"], dtype=np.uint32)


def _lower(text: str) -> str:
    """Lower case, a character for a character."""
    out = text.lower()
    return out if len(out) == len(text) else "".join(low if len(low := c.lower()) == 1 else c for c in text)


def _windows(points: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of at most CHUNK code points that end with a sentence, else with a word."""
    at = 0
    while at < len(points):
        end = min(len(points), at + CHUNK)
        if end < len(points):
            own = points[at:end]
            last = np.flatnonzero(np.isin(own, _ENDS))
            last = last if len(last) else np.flatnonzero(~_letters()[own])
            end = at + int(last[-1]) + 1 if len(last) else end
        yield at, end
        at = end


@dataclass
class Bag:
    """Words of some texts: bucket and sentence of each; of a sentence its text and span."""

    bucket: np.ndarray
    sentence: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray


def bag(texts: list[str | None]) -> Bag:
    """The sentences with a letter, and their words, of a few texts."""
    parts, base = [], 0
    for number, text in enumerate(texts):
        if not text:
            continue
        points = np.frombuffer(_lower(text).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        for at, to in _windows(points):
            own = points[at:to]
            letter = np.concatenate([[False], _letters()[own], [False]])
            edge = np.flatnonzero(letter[1:] != letter[:-1])
            start, end = edge[0::2], edge[1::2]
            if not len(start):
                continue
            # The ends of sentences before a word number its sentence.
            stops = np.flatnonzero(np.isin(own, _ENDS))
            place = np.searchsorted(stops, start)
            new = np.append(True, place[1:] != place[:-1])
            sentence = np.cumsum(new) - 1
            held = place[new]
            begins = np.where(held > 0, stops[np.maximum(held - 1, 0)] + 1, 0) if len(stops) else np.zeros(len(held), np.int64)
            ends = np.where(held < len(stops), stops[np.minimum(held, len(stops) - 1)] + 1, len(own)) if len(stops) else np.full(len(held), len(own))
            # A word and its beginnings, each once.
            number_of, until = [np.arange(len(start))], [end]
            for k in PREFIXES:
                longer = np.flatnonzero(end - start > k)
                number_of.append(longer)
                until.append(start[longer] + k)
            number_of, until = np.concatenate(number_of), np.concatenate(until)
            hashes = span_hash(own.astype(np.uint64) + np.uint64(1), start[number_of], until, WORD_BASE)
            parts.append(((hashes >> np.uint64(64 - BITS)).astype(np.int32), sentence[number_of] + base, np.full(len(held), number), begins + at, ends + at))
            base += len(held)
    if not parts:
        none = np.zeros(0, np.int64)
        return Bag(none, none, none, none, none)
    return Bag(*(np.concatenate(c) for c in zip(*parts, strict=True)))


# --- training ----------------------------------------------------------------


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def sentences(self, words: Bag) -> np.ndarray:
        """The probability of each sentence."""
        n = len(words.text)
        held = np.flatnonzero(self.weights[words.bucket])
        pair = np.unique(words.sentence[held].astype(np.int64) << BITS | words.bucket[held])
        logit = np.bincount(pair >> BITS, self.weights[pair & ((1 << BITS) - 1)], n)
        return _sigmoid(logit + self.bias)


NOTHING = Model(np.zeros(1 << BITS), -np.inf)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(-x))


def noisy_or(p: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """1 - prod(1 - p) of each of n documents; ``of``: the document of each p."""
    with np.errstate(divide="ignore"):
        return -np.expm1(np.bincount(of, np.log1p(-p), n))


@dataclass
class Sample:
    """A sample text: its label (a share of its copies), its weight, and its words by
    sentence, each once a sentence."""

    label: float
    weight: float
    sentence: np.ndarray
    bucket: np.ndarray


def candidates(rows: list[Sample], least: float) -> np.ndarray:
    """Buckets that stand in at least the share ``least`` of the toxic texts (three at
    least), and in a larger share of them than of the clean ones."""
    counts = np.zeros((2, 1 << BITS))
    for r in rows:
        counts[int(r.label > 0), np.unique(r.bucket)] += 1
    toxic = sum(r.label > 0 for r in rows)
    return np.flatnonzero((counts[1] >= max(3, least * toxic)) & (counts[1] * (len(rows) - toxic + 1) > (counts[0] + 1) * toxic))


def fit_bags(rows: list[Sample], *, least: float = 0.02, l1: float = 0.002, rounds: int = 80) -> Model:
    """The noisy-or likelihood with an L1 penalty, climbed by sign steps: a weight's step
    grows while its slope keeps its sign and halves when that turns."""
    held = candidates(rows, least)
    if not len(held):
        return NOTHING
    sentence, bucket, of, base = [], [], [], 0
    for k, r in enumerate(rows):
        own = np.flatnonzero(np.isin(r.bucket, held))
        count = int(r.sentence.max()) + 1 if len(r.sentence) else 0
        sentence.append(r.sentence[own].astype(np.int64) + base)
        bucket.append(r.bucket[own])
        of.append(np.full(count, k))
        base += count
    sentence, of = np.concatenate(sentence), np.concatenate(of)
    place = np.searchsorted(held, np.concatenate(bucket))
    label, weight = np.array([r.label for r in rows])[of], np.array([r.weight for r in rows])[of]
    w, step, before = np.append(np.zeros(len(held)), -6.0), np.full(len(held) + 1, 0.1), np.zeros(len(held) + 1)
    penalty = np.append(np.full(len(held), l1 * sum(r.label * r.weight for r in rows)), 0)
    for _ in range(rounds):
        p = np.clip(_sigmoid(np.bincount(sentence, w[place], base) + w[-1]), 1e-12, 1 - 1e-9)
        whole = noisy_or(p, of, len(rows))[of]
        # Of a toxic text each sentence answers for its share; of a clean one for itself.
        slope = weight * p * (label * (1 - whole) / whole - (1 - label))
        total = np.append(np.bincount(place, slope[sentence], len(held)), slope.sum())
        total = np.where(w != 0, total - penalty * np.sign(w), np.sign(total) * np.maximum(np.abs(total) - penalty, 0))
        turn = total * before
        step = np.clip(np.where(turn > 0, step * 1.3, np.where(turn < 0, step / 2, step)), 1e-4, 1)
        before = np.where(turn < 0, 0, total)
        moved = w + np.sign(before) * step
        w = np.append(np.where(moved[:-1] * w[:-1] < 0, 0, moved[:-1]), moved[-1])
    weights = np.zeros(1 << BITS)
    weights[held] = w[:-1]
    return Model(weights, float(w[-1]))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sentence and bucket of each sample text's words, each once a sentence."""
    for batch in batches:
        out = []
        for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = bag([text])
            pair = np.unique(words.sentence.astype(np.int64) << BITS | words.bucket)
            out.append((key, (pair >> BITS).astype(np.int32).tobytes(), (pair & ((1 << BITS) - 1)).astype(np.int32).tobytes()))
        columns = list(zip(*out, strict=True)) or [[], [], []]
        types = [pa.int64(), pa.binary(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["key", "sentence", "bucket"])


def sample(train: DataFrame, sample_rows: int, sample_chars: int) -> tuple[DataFrame, dict[int, int]]:
    """(key, toxic, share) of the texts that train, and the number of different texts of
    each label. ``train``: (key, toxic, chars), key a hash of the text."""
    texts = train.groupBy("key").agg(F.avg("toxic").alias("share"), F.max("chars").alias("chars")).withColumn("toxic", (F.col("share") >= 0.5).cast("int"))
    # Ranks are cut off on the map side, so a label is no large group.
    order = Window.partitionBy("toxic").orderBy("key")
    ranked = texts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= sample_rows // 2)
    chosen = ranked.withColumn("sum", F.sum("chars").over(order)).where(F.col("sum") <= sample_chars // 2)
    sizes = {r["toxic"]: r["count"] for r in texts.groupBy("toxic").count().collect()}
    return chosen.select("key", "toxic", "share"), sizes


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 8000, sample_chars: int = 1 << 26) -> Model:
    """From docs (doc_id, text) and labels (doc_id, toxic)."""
    # Only ids and hashes meet the labels; the texts stay where they are.
    keys = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", F.xxhash64("text").alias("key"), F.length("text").alias("chars"))
    marks = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic"))
    train = keys.join(marks, "doc_id").select("key", "toxic", "chars")
    chosen, sizes = sample(stored(train, "labelled"), sample_rows, sample_chars)
    # Stored, so that Spark knows how small it is and need not shuffle the texts to meet it.
    chosen = stored(chosen, "sample", files=1)
    shares = {r["key"]: (r["toxic"], r["share"]) for r in chosen.collect()}
    if len({y for y, _ in shares.values()}) < 2:
        return NOTHING
    drawn = {y: sum(t == y for t, _ in shares.values()) for y in (0, 1)}
    texts = docs.where("text IS NOT NULL").select(F.xxhash64("text").alias("key"), "text").join(chosen.select("key"), "key")
    once = texts.groupBy("key").agg(F.min("text").alias("text"))
    weight = {y: sizes[y] / drawn[y] * (drawn[1] / sizes[1]) for y in (0, 1)}
    rows = {}
    for r in arrow_pass(once, _features, "key long, sentence binary, bucket binary").toLocalIterator():
        toxic, share = shares[r["key"]]
        rows[r["key"]] = Sample(share, weight[toxic], np.frombuffer(r["sentence"], np.int32), np.frombuffer(r["bucket"], np.int32))
    return fit_bags([rows[k] for k in sorted(rows)])


# --- prediction --------------------------------------------------------------


def _scores(model: Model, offending: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_batches(whole, "text"):
                words = bag(batch.column("text").to_pylist())
                p = model.sentences(words) if len(words.text) else np.zeros(0)
                score = noisy_or(p, words.text, batch.num_rows)
                hit = np.flatnonzero(p >= offending)
                first = np.searchsorted(words.text[hit], np.arange(batch.num_rows + 1)).astype(np.int32)
                spans = pa.StructArray.from_arrays(
                    [pa.array(c[hit], t) for c, t in ((words.start, pa.int64()), (words.end, pa.int64()), (p, pa.float64()))], ["start", "end", "score"]
                )
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("held_out"), pa.array(np.clip(score, 0, 1)), pa.ListArray.from_arrays(pa.array(first), spans)],
                    ["doc_id", "held_out", "score", "offending"],
                )

    return run


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    offending: float = 0.5,
    sample_rows: int = 8000,
    sample_chars: int = 1 << 26,
) -> DataFrame:
    """doc_id, held_out, score, predicted and the offending sentences (start, end in code
    points, score) of every document; rows that are held out do not train."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic"))
    model = fit(rows.where("NOT held_out").select("doc_id", "text"), marks, sample_rows, sample_chars)
    found = arrow_pass(rows, _scores(model, offending), "doc_id long, held_out boolean, score double, offending array<struct<start:long,end:long,score:double>>")
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "offending")
