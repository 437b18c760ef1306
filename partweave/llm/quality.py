"""Quality rules with cross-document line frequency.

Per-document measures come from one Arrow pass over whole texts. The same pass
hashes every normalised line (lower case, digits as 0, white space joined). Spark
counts, per host and line, the distinct documents that hold it: rows are already
distinct in a document, so a count with map-side combine is exact and a line or
host that a third of all rows share shrinks before the shuffle. A line is over
the limit if more than ``max(least_docs, share * documents of the host)``
documents hold it; it counts as removed. A document that keeps fewer than
``least_kept`` of its words is depleted and rejected.

Cases: a null text has no words and fails the base rules; a null host is a host
of its own; repeated rows count as documents of their own; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import arrow_pass, stored
from partweave.llm.hashing import text_batches

SYMBOLS = b"#*$%&|<>"
NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
DIGITS = re.compile(r"\d")
WINDOW = 8

MEASURES = (
    "row_no long, doc_id long, host string, n_words long, word_chars long, n_symbols long,"
    " n_dup_lines long, n_repeat_words long, lines array<struct<line:long,words:int>>"
)


def repeated_words(ids: np.ndarray, width: int = WINDOW) -> int:
    """Words in ``width``-word windows that are found twice or more in the text.
    Windows get exact ranks by doubling: a rank of 2n words is a pair of ranks."""
    if len(ids) <= width:
        return 0
    ranks, span = ids, 1
    while span < width:
        pairs = ranks[:-span] * np.int64(len(ids) + 1) + ranks[span:]
        _, ranks = np.unique(pairs, return_inverse=True)
        span *= 2
    counts = np.bincount(ranks)
    starts = np.flatnonzero(counts[ranks] > 1)
    if not len(starts):
        return 0
    edges = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + width, -1)
    return int(np.count_nonzero(np.cumsum(edges[:-1])))


def measure(text: str | None) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines."""
    raw = (text or "").encode()
    words = raw.split()
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))
    # Continuation bytes are no code points of their own.
    word_bytes = np.frombuffer(b"".join(words), dtype=np.uint8)
    word_chars = len(word_bytes) - int(np.count_nonzero((word_bytes & 0xC0) == 0x80))
    lines, hashes, dup = set(), {}, 0
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        if line in lines:
            dup += 1
        lines.add(line)
        normal = DIGITS.sub("0", b" ".join(own).decode(errors="replace").lower())
        key = xxhash.xxh3_64_intdigest(normal) - (1 << 63)
        hashes[key] = hashes.get(key, 0) + len(own)
    return (
        len(words),
        word_chars,
        len(raw.translate(None, NOT_SYMBOLS)),
        dup,
        repeated_words(ids),
        [{"line": k, "words": n} for k, n in hashes.items()],
    )


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    line_type = pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int32())]))
    for whole in batches:
        for batch in text_batches(whole, "text"):
            found = [measure(t.as_py()) for t in batch.column("text")]
            columns = list(zip(*found, strict=True))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row_no"),
                    batch.column("doc_id"),
                    batch.column("host"),
                    *[pa.array(c, pa.int64()) for c in columns[:5]],
                    pa.array(columns[5], line_type),
                ],
                ["row_no", "doc_id", "host", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"],
            )


def quality_report(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    least_docs: int = 20,
    share: float = 0.01,
    least_kept: float = 0.3,
) -> DataFrame:
    """doc_id, the measures, base_failed, n_removed_words, depleted and kept."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_no"),
        F.col(id_col).alias("doc_id"),
        F.col(host_col).alias("host"),
        F.col(text_col).alias("text"),
    )
    # Stored once: row numbers stay as they are, and no text is measured twice.
    measured = stored(arrow_pass(rows, _measures, MEASURES), "quality")
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("host_docs"))
    lines = measured.select("row_no", "host", F.explode("lines").alias("l")).select("row_no", "host", "l.*")
    frequent = (
        lines.groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("line_docs"))
        .where(F.col("line_docs") > least_docs)
        .withColumnRenamed("host", "host_of")
    )
    limits = hosts.select(F.col("host").alias("host_of"), F.greatest(F.lit(least_docs), share * F.col("host_docs")).alias("most"))
    over = _over(frequent, limits)
    removed = (
        lines.join(over, F.col("host").eqNullSafe(F.col("host_of")) & (F.col("line") == F.col("line_of")))
        .groupBy("row_no")
        .agg(F.sum("words").alias("n_removed_words"))
    )
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (
        measured.drop("lines")
        .join(removed, "row_no", "left")
        .withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0)).cast("long"))
        .withColumn("base_failed", base_failed)
        .withColumn("depleted", (F.col("n_words") - F.col("n_removed_words")) < least_kept * F.col("n_words"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("depleted"))
        .drop("row_no", "host")
    )


def _over(frequent: DataFrame, limits: DataFrame) -> DataFrame:
    """The lines above their host's limit."""
    limits = limits.withColumnRenamed("host_of", "host_limit")
    return (
        frequent.join(limits, F.col("host_of").eqNullSafe(F.col("host_limit")))
        .where(F.col("line_docs") > F.col("most"))
        .select("host_of", F.col("line").alias("line_of"))
    )
