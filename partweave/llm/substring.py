"""Substring dedup over a De Bruijn graph of word runs.

Every window of ``width`` words is an edge between its two (width - 1)-word
nodes. Writing out all edges would cost far more than the texts, so edges
travel compacted: neighbouring windows of a document whose lowest-hash
``seed``-word run (their minimizer) is the same occurrence form one path
segment. Equal windows have equal minimizers, so all occurrences of an edge
meet under one minimizer.

1. One Arrow pass emits the segments: minimizer, hash of the segment's whole
   word run, document and start. Copies inside one batch are folded first.
2. An aggregate on the minimizer (combined on the map side, safe for hot
   passages) finds the repeated ones and whether the path branches there, that is,
   whether different segments share the minimizer; a join brings this back.
3. Compaction: segments that occur twice or more get numbers. An aggregate finds
   each one's successors and predecessors over all its occurrences; where A is only
   ever followed by B and B only ever preceded by A, a join links them. Pointer
   doubling, one join a round, takes each segment to the head of its nonbranching
   path. All occurrences of a path but the first are repeats of it.
4. Where paths branch, the first occurrence of each distinct segment is expanded
   into single edges: its document hashes the windows twice, a join with each
   window's first occurrence finds those that start earlier elsewhere, and
   neighbouring ones are joined to runs.
5. Source coordinates verify: each repeat names its source (document, start,
   windows); the source's words are cut from its text and sent to the repeat's
   document, which removes words only where its own are the same.

Windows are judged on the input. Hashes (128 bits of a segment or window) only
propose; an equal run under two hashes would be missed, never removed wrongly.

Cases: a null text has no words. Rows that share doc_id and text are one
document: each gets the same result. Rows that share a doc_id only are ordered
by a hash of the text. A null doc_id has no place in the order: its row is
neither source nor repeat. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partweave.llm.common import arrow_pass, stored
from partweave.llm.hashing import RUN_BASES, Words, rolling_hash, span_hash, text_batches

WIDTH = 20
SEED = 6
#: A segment's place is one long: text tag, start word, window count.
COUNT_BITS, START_BITS = 5, 32
#: Of the table of repeated segments, which is small beside the texts.
SEGMENTS_PER_FILE = 200_000
#: Pointer doubling settles paths of 2**rounds segments.
ROUNDS = 48
#: Occurrences of one run that a task joins with it; hotter runs are dealt by a salt.
HOT = 10_000
SEGMENTS = "m long, s long, doc long, place long, rest array<struct<doc:long,place:long>>"


def _minimizers(word_hash: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Seed hashes, and for each window start the position of its minimizer
    (the leftmost lowest seed hash), by a sliding minimum in doubling steps."""
    seeds = rolling_hash(word_hash, seed, RUN_BASES[0])
    span = width - seed + 1
    n = len(seeds) - span + 1
    if n <= 0:
        return seeds, np.zeros(0, dtype=np.int64)
    # 40 hash bits order the seeds; the position below them breaks ties to the left.
    key = (seeds >> np.uint64(24) << np.uint64(24)) | np.arange(len(seeds), dtype=np.uint64)
    low, reach = key, 1
    while reach * 2 <= span:
        low, reach = np.minimum(low[:-reach], low[reach:]), reach * 2
    if reach < span:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    return seeds, (low & np.uint64((1 << 24) - 1)).astype(np.int64)


def segments_of(words: Words, width: int = WIDTH, seed: int = SEED):
    """(m, s, doc index, start word in the document, windows) of every segment."""
    h = words.hash
    n = len(h) - width + 1
    parts = []
    doc_of = words.doc_of_word()
    step = 1 << 22  # positions fit the 24 bits beside a hash
    for at in range(0, max(n, 0), step):
        end = min(n, at + step)
        seeds, low = _minimizers(h[at : end + width - 1], width, seed)
        window = np.arange(at, end)
        inside = doc_of[window] == doc_of[window + width - 1]
        doc = doc_of[window]
        new = np.ones(len(window), dtype=bool)
        new[1:] = (low[1:] != low[:-1]) | (doc[1:] != doc[:-1]) | ~inside[:-1]
        new &= inside
        first = np.flatnonzero(new)
        if not len(first):
            continue
        ends = np.append(first[1:], len(window))
        # A segment ends at the next one or where windows leave the document.
        valid = np.concatenate([[0], np.cumsum(inside)])
        count = valid[ends] - valid[first]
        begin = at + first
        run = span_hash(h, begin, begin + count + width - 1, RUN_BASES[1])
        parts.append((seeds[low[first]], run, doc[first], begin - words.first[doc[first]], count))
    if not parts:
        return [np.zeros(0, np.uint64)] * 2 + [np.zeros(0, np.int64)] * 3
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _segments(batches: Iterator[pa.RecordBatch], width: int, seed: int, mask: int) -> Iterator[pa.RecordBatch]:
    rest_type = pa.list_(pa.struct([("doc", pa.int64()), ("place", pa.int64())]))
    for whole in batches:
        for batch in text_batches(whole, "text"):
            ids = batch.column("doc").to_numpy(zero_copy_only=False)
            tags = batch.column("tag").to_numpy(zero_copy_only=False)
            m, s, d, start, count = segments_of(Words(batch.column("text")), width, seed)
            m, s = m & np.uint64(mask), s & np.uint64(mask)
            doc = ids[d].astype(np.int64)
            place = (tags[d].astype(np.int64) << (COUNT_BITS + START_BITS)) | (start << COUNT_BITS) | count
            order = np.lexsort((place, doc, s, m))
            m, s, doc, place = m[order], s[order], doc[order], place[order]
            # Repeated rows are one document: their segments count once.
            new = np.ones(len(m), dtype=bool)
            new[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
            m, s, doc, place = m[new], s[new], doc[new], place[new]
            lead = np.ones(len(m), dtype=bool)
            lead[1:] = (m[1:] != m[:-1]) | (s[1:] != s[:-1])
            at = np.flatnonzero(lead)
            sizes = np.diff(np.append(at, len(m))) - 1
            rest = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(doc[~lead]), pa.array(place[~lead])], ["doc", "place"]),
                mask=pa.array(sizes == 0),
            ) if len(at) else pa.array([], rest_type)
            yield pa.RecordBatch.from_arrays(
                [pa.array(m[at].view(np.int64)), pa.array(s[at].view(np.int64)), pa.array(doc[at]), pa.array(place[at]), rest.cast(rest_type)],
                ["m", "s", "doc", "place", "rest"],
            )


def _windows(batches: Iterator[pa.RecordBatch], width: int, mask: int) -> Iterator[pa.RecordBatch]:
    """Two hashes and the coordinates of each window of the listed segments."""
    for whole in batches:
        listed = pa.RecordBatch.from_struct_array(
            whole.to_struct_array().filter(whole.column("places").is_valid())
        )
        for batch in text_batches(listed, "text"):
            words = Words(batch.column("text"))
            lists = batch.column("places")
            places = lists.flatten()
            row = np.repeat(np.arange(len(batch)), lists.value_lengths().to_numpy(zero_copy_only=False))
            start, count = (places.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("start", "count"))
            each = np.repeat(np.arange(len(start)), count)
            inner = np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)
            own = start[each] + inner
            begin = words.first[row[each]] + own
            h = words.hash
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            tag = batch.column("tag").to_numpy(zero_copy_only=False)[row[each]].astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array((span_hash(h, begin, begin + width, RUN_BASES[0]) & np.uint64(mask)).view(np.int64)),
                    pa.array((span_hash(h, begin, begin + width, RUN_BASES[1]) & np.uint64(mask)).view(np.int64)),
                    pa.array(ids[row[each]].astype(np.int64)),
                    pa.array(tag),
                    pa.array(own),
                ],
                ["w1", "w2", "doc", "tag", "start"],
            )


def _words(text) -> list[bytes]:
    return (text.as_py() or "").encode().split()


def _sources(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """The words of the listed runs."""
    for whole in batches:
        listed = pa.RecordBatch.from_struct_array(whole.to_struct_array().filter(whole.column("places").is_valid()))
        for batch in text_batches(listed, "text"):
            out: list[tuple] = []
            for doc, tag, text, places in zip(batch.column("doc_id").to_pylist(), batch.column("tag").to_pylist(), batch.column("text"), batch.column("places").to_pylist(), strict=True):
                words = _words(text)
                for p in places:
                    end = p["start"] + p["count"] + width - 1
                    if end <= len(words):
                        out.append((doc, tag, p["start"], p["count"], p["salts"], b" ".join(words[p["start"] : end])))
            columns = list(zip(*out, strict=True)) or [()] * 6
            types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["sdoc", "stag", "sstart", "count", "salts", "words"])


def _removed(batches: Iterator[pa.RecordBatch], width: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in text_batches(whole, "text"):
            totals, gone, digests, texts = [], [], [], []
            for text, places in zip(batch.column("text"), batch.column("places"), strict=True):
                words = _words(text)
                totals.append(len(words))
                edge = np.zeros(len(words) + 1, dtype=np.int64)
                for p in places.as_py() or ():
                    end = p["start"] + p["count"] + width - 1
                    if end <= len(words) and b" ".join(words[p["start"] : end]) == p["words"]:
                        edge[p["start"]] += 1
                        edge[end] -= 1
                keep = np.flatnonzero(np.cumsum(edge[:-1]) == 0)
                gone.append(len(words) - len(keep))
                if gone[-1]:
                    words = [words[i] for i in keep]
                kept = b" ".join(words)
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode() if gone[-1] else text.as_py())
            columns = [pa.array(totals, pa.int64()), pa.array(gone, pa.int64()), pa.array(digests, pa.string())]
            names = ["n_words", "n_removed", "kept_sha256"]
            if with_text:
                columns.append(pa.array(texts, pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in batch.schema.names if c not in ("text", "tag", "places")] + columns,
                [c for c in batch.schema.names if c not in ("text", "tag", "places")] + names,
            )


REPEAT = ("doc", "tag", "start", "count", "sdoc", "stag", "sstart", "salts")


def _here() -> Column:
    return F.struct("doc", "place")


def _coordinates(place: Column) -> tuple[Column, Column, Column]:
    """Text tag, start word and window count of a place."""
    start = F.shiftright(place, COUNT_BITS).bitwiseAND((1 << START_BITS) - 1)
    return F.shiftright(place, COUNT_BITS + START_BITS), start, place.bitwiseAND((1 << COUNT_BITS) - 1)


def _salts(occurrences: Column) -> Column:
    return F.ceil(occurrences / HOT).cast("int")


def _salt() -> Column:
    """Which copy of a hot run an occurrence meets."""
    return F.pmod(F.xxhash64("doc", "tag", "start"), F.col("salts")).cast("int").alias("salt")


def _copies() -> Column:
    return F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")


def path_heads(links: DataFrame) -> DataFrame:
    """(g, head) of every row of ``links`` (g, up): the end of its chain of ``up``, by
    pointer doubling. A segment without a link points to itself."""
    now = stored(links.select("g", F.coalesce("up", "g").alias("ptr")), "pointers")
    files = 1 + now.count() // SEGMENTS_PER_FILE
    for _ in range(ROUNDS):
        ahead = now.select(F.col("g").alias("ptr"), F.col("ptr").alias("next"))
        moved = stored(now.join(ahead, "ptr").select("g", F.col("next").alias("ptr"), (F.col("next") != F.col("ptr")).alias("moved")), "pointers", files=files)
        now = moved.select("g", "ptr")
        if not moved.where("moved").limit(1).count():
            break
    return now.withColumnRenamed("ptr", "head")


def compacted_repeats(met: DataFrame) -> DataFrame:
    """REPEAT rows of the nonbranching paths over repeated segments (m, s, doc, place, rest)."""
    size = 1 + F.coalesce(F.size("rest"), F.lit(0))
    segments = stored(
        met.groupBy("m", "s").agg(F.sum(size).alias("n"), F.min(_here()).alias("first")).where("n > 1").withColumn("g", F.monotonically_increasing_id()), "nodes"
    )
    each = met.join(segments.select("m", "s", "g", _salts(F.col("n")).alias("salts")), ["m", "s"]).select(
        "g", "salts", F.explode(F.concat(F.array(_here()), F.coalesce("rest", F.expr("CAST(array() AS array<struct<doc:long,place:long>>)")))).alias("o")
    )
    tag, start, count = _coordinates(F.col("o.place"))
    # Repeated rows are one document; their segments count once.
    occurrences = stored(
        each.select("g", "salts", "o.doc", tag.alias("tag"), start.alias("start"), count.alias("count")).repartition("doc", "tag").dropDuplicates(["doc", "tag", "start"]),
        "occurrences",
    )
    along = Window.partitionBy("doc", "tag").orderBy("start")
    ends = F.col("start") + F.col("count")
    beside = occurrences.select(
        "g",
        F.when(F.lead("start").over(along) == ends, F.lead("g").over(along)).alias("next"),
        F.when(F.lag(ends).over(along) == F.col("start"), F.lag("g").over(along)).alias("before"),
        "count",
    )

    def only(c: str) -> Column:
        """The one neighbour that all occurrences have, or null."""
        return F.when((F.min(c) == F.max(c)) & (F.count(c) == F.count(F.lit(1))), F.min(c))

    degrees = stored(beside.groupBy("g").agg(only("next").alias("next"), only("before").alias("before"), F.max("count").alias("count")), "degrees")
    follows = degrees.select(F.col("next").alias("g"), F.col("g").alias("from")).where("g IS NOT NULL")
    links = degrees.join(follows, (degrees["g"] == follows["g"]) & (degrees["before"] == follows["from"]), "left").select(degrees["g"], F.col("from").alias("up"))
    lengths = path_heads(links).join(degrees.select("g", "count"), "g").groupBy(F.col("head").alias("g")).agg(F.sum("count").alias("windows"))
    stag, sstart, _ = _coordinates(F.col("first.place"))
    paths = segments.join(lengths, "g").withColumn("salts", _salts(F.col("n"))).select("g", _copies(), "windows", F.col("first.doc").alias("sdoc"), stag.alias("stag"), sstart.alias("sstart"))
    dealt = occurrences.select("g", "salts", _salt(), "doc", "tag", "start")
    found = dealt.join(paths, ["g", "salt"]).where("NOT (doc = sdoc AND tag = stag AND start = sstart)")
    return found.select("doc", "tag", "start", F.col("windows").alias("count"), "sdoc", "stag", "sstart", "salts")


def _runs(windows: DataFrame) -> DataFrame:
    """REPEAT rows of windows (w1, w2, doc, tag, start) that have an earlier equal one."""
    dealt = windows.repartition("w1", "w2")
    here = F.struct("doc", "tag", "start")
    heads = dealt.groupBy("w1", "w2").agg(F.min(here).alias("head"), F.max(here).alias("tail"), F.count(F.lit(1)).alias("n")).where("head != tail")
    later = dealt.join(heads, ["w1", "w2"]).where(here != F.col("head")).select("doc", "tag", "start", "head", "n")
    later = later.repartition("doc", "tag").dropDuplicates(["doc", "tag", "start"])
    keys = ["doc", "tag", F.col("head.doc").alias("sdoc"), F.col("head.tag").alias("stag"), (F.col("start") - F.col("head.start")).alias("shift")]
    shifted = later.select(*keys, "start", "n")
    run = Window.partitionBy("doc", "tag", "sdoc", "stag", "shift").orderBy("start")
    return (
        shifted.withColumn("run", F.col("start") - F.row_number().over(run))
        .groupBy("doc", "tag", "sdoc", "stag", "shift", "run")
        # Repeats of one source run hold the same windows, so they count the same.
        .agg(F.min("start").alias("start"), F.count(F.lit(1)).alias("count"), F.max("n").alias("n"))
        .select("doc", "tag", "start", "count", "sdoc", "stag", (F.col("start") - F.col("shift")).alias("sstart"), _salts(F.col("n")).alias("salts"))
    )


def dedup_substrings(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    width: int = WIDTH,
    seed: int = SEED,
    with_text: bool = False,
    hash_bits: int = 64,
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; with ``with_text`` also kept_text
    (the text itself where no word is removed) and the ``keep`` columns in a struct
    ``kept``. Fewer ``hash_bits`` make clashes, which verification must catch."""
    if not 1 <= width - seed + 1 < 1 << COUNT_BITS:
        raise ValueError("a segment's window count must fit its bits")
    mask = (1 << hash_bits) - 1
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc"),
        F.xxhash64(text_col).bitwiseAND(0xFFFF).alias("tag"),
        F.col(text_col).alias("text"),
        (F.struct(*keep) if keep else F.lit(None).cast("string")).alias("kept"),
    )
    segments = arrow_pass(rows.where("doc IS NOT NULL").select("doc", "tag", "text"), lambda b: _segments(b, width, seed, mask), SEGMENTS)
    size = 1 + F.coalesce(F.size("rest"), F.lit(0))
    repeated = (
        segments.groupBy("m").agg(F.sum(size).alias("n"), F.min("s").alias("s0"), F.max("s").alias("s1")).where("n > 1")
        .select("m", (F.col("s0") != F.col("s1")).alias("branches"))
    )
    met = stored(segments.join(repeated, "m"), "segments")
    whole = stored(compacted_repeats(met), "repeats")
    tag, start, count = _coordinates(F.col("at.place"))
    expanded = stored(
        met.where("branches").groupBy("m", "s").agg(F.min(_here()).alias("at")).select("at.doc", tag.alias("tag"), start.alias("start"), count.alias("count")), "expanded"
    )

    def with_places(found: DataFrame, *columns: str) -> DataFrame:
        """The same left join each time, so that one shuffle of the texts serves all."""
        lists = found.groupBy(F.col("doc").alias("of"), F.col("tag").alias("of_tag")).agg(F.collect_list(F.struct(*columns)).alias("places"))
        joined = rows.join(
            lists.hint("shuffle_hash"), (F.col("doc") == F.col("of")) & (F.col("tag") == F.col("of_tag")), "left"
        )
        return joined.select(F.col("doc").alias("doc_id"), "tag", "kept", "text", "places")

    windows = arrow_pass(
        with_places(expanded, "start", "count"), lambda b: _windows(b, width, mask), "w1 long, w2 long, doc long, tag long, start long"
    )
    repeats = whole.unionByName(_runs(windows)).select(*REPEAT)
    wanted = repeats.groupBy(F.col("sdoc").alias("doc"), F.col("stag").alias("tag"), F.col("sstart").alias("start"), "count").agg(F.max("salts").alias("salts"))
    source_key = ["sdoc", "stag", "sstart", "count"]
    sources = arrow_pass(
        with_places(wanted, "start", "count", "salts"), lambda b: _sources(b, width), "sdoc long, stag long, sstart long, count long, salts int, words binary"
    )
    words = sources.groupBy(*source_key).agg(F.max("salts").alias("salts"), F.min("words").alias("words")).select(*source_key, "words", _copies())
    dealt = repeats.select("doc", "tag", "start", *source_key, _salt())
    final = with_places(dealt.join(words, [*source_key, "salt"]), "start", "count", "words")
    kept_type = rows.schema["kept"].dataType.simpleString()
    schema = f"doc_id long, kept {kept_type}, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    out = arrow_pass(final, lambda b: _removed(b, width, with_text), schema)
    return out if keep else out.drop("kept")
