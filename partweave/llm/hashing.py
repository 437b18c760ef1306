"""Vectorised word hashing for Arrow string batches.

Words are maximal runs of bytes other than space and \\x09-\\x0D, so UTF-8 texts
split without decoding. A word's hash is a polynomial over its bytes modulo
2**64; prefix sums give all words of a block at once, and an odd base has an
inverse, so a hash does not depend on where the word stands. Hashes of word
runs are built from mixed word hashes in the same way.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BASE = 0x9E3779B97F4A7C15
RUN_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
#: Bytes hashed at once; only a single longer word makes a larger block.
BLOCK_BYTES = 1 << 20

_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    found = _powers.get(base)
    if found is None or len(found) < n:
        out = np.full(max(n, 1), base, dtype=np.uint64)
        out[0] = 1
        _powers[base] = found = np.multiply.accumulate(out)
    return found[:n]


def inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each pair, equal for equal runs anywhere."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, n), out=sums[1:])
    raw = (sums[ends] - sums[starts]) * powers(inverse(base), n + 1)[starts]
    return mix(raw + (ends - starts).astype(np.uint64))


def rolling_hash(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each ``width`` neighbouring values."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = out * np.uint64(base) + values[k : k + n]
    return mix(out)


def _blocks(data: np.ndarray, space: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about BLOCK_BYTES that end at white space."""
    at = 0
    while at < len(data):
        end = min(len(data), at + BLOCK_BYTES)
        if end < len(data):
            back = np.flatnonzero(space[at:end])
            if len(back):
                end = at + int(back[-1]) + 1
            else:
                ahead = np.flatnonzero(space[end:])
                end = end + int(ahead[0]) + 1 if len(ahead) else len(data)
        yield at, end
        at = end


class Words:
    """The words of a batch of texts (null: none), with documents in order.

    ``start``/``end``: byte ranges in ``data``; ``first[d]:first[d + 1]`` are the
    words of document d; ``hash`` is a mixed 64-bit hash of each word.
    """

    def __init__(self, texts: pa.Array | list):
        self.texts = [b"" if t is None else t for t in _as_bytes(texts)]
        # One white-space byte after each text keeps words of neighbours apart.
        self.data = np.frombuffer(b"\n".join(self.texts) + b"\n", dtype=np.uint8)
        sizes = np.fromiter((len(t) + 1 for t in self.texts), dtype=np.int64, count=len(self.texts))
        self.doc_start = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        space = _IS_SPACE[self.data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if len(space) and not space[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.doc_start)
        self.space = space

    def __len__(self) -> int:
        return len(self.start)

    @property
    def hash(self) -> np.ndarray:
        out = np.empty(len(self.start), dtype=np.uint64)
        inv = inverse(BYTE_BASE)
        for at, end in _blocks(self.data, self.space):
            lo, hi = np.searchsorted(self.start, [at, end])
            if lo == hi:
                continue
            block = self.data[at:end]
            sums = np.zeros(len(block) + 1, dtype=np.uint64)
            # A byte is at least 1, so a leading zero byte counts as well.
            np.cumsum((block.astype(np.uint64) + np.uint64(1)) * powers(BYTE_BASE, len(block)), out=sums[1:])
            s, e = self.start[lo:hi] - at, self.end[lo:hi] - at
            out[lo:hi] = mix((sums[e] - sums[s]) * powers(inv, len(block) + 1)[s])
        return out

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.texts)), np.diff(self.first))


def _as_bytes(texts) -> list:
    if isinstance(texts, (pa.Array, pa.ChunkedArray)):
        return texts.cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).to_pylist()
    return [t.encode() if isinstance(t, str) else t for t in texts]


def text_batches(batch: pa.RecordBatch, column: str, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts hold about ``limit`` bytes (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    total = np.cumsum(lengths)
    at = 0
    while at < len(lengths):
        base = total[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(at, end - at)
        at = end
