"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a public model file, whose path is a parameter. That file
ranks its pieces by merge order; a piece's log score is that of a Zipf law over
the rank, log(1 / rank), and a byte piece costs more than any other. Spaces
become the marker U+2581, and one marker is put before the text. A piece holds
a marker only at its start, so a text falls into units (markers and the
characters up to the next marker) that no piece crosses; other white space
stands alone. The distinct units of a batch walk the trie together in numpy:
one array step per position and depth, for all units at once. Units of unbroken text
walk it alone in a window of ``WINDOW`` characters: at its end the best paths to the
last positions are traced back to where they meet, what lies before is settled, and
the scores after it are carried over, so the result is that of the whole unit and
memory does not grow with it.

The path of highest score wins; of equal ones the one whose last piece is
longest, and so on from the end. A character that no piece starts at falls back
to its UTF-8 bytes.

Cases: a null or empty text has no pieces; a marker character in the text is
encoded as a space and decoded as one; repeated rows and null ids are kept;
extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import MEMORIES, arrow_pass
from partweave.llm.hashing import text_batches

MARKER = "▁"
UNIT = re.compile("▁*[^▁\\s]+|▁+|\\s")
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")
#: Characters of the units that a worker remembers, and of the longest that it does.
CACHE_CHARS, CACHE_UNIT = 4 << 20, 64
#: Units longer than this walk the trie alone, in windows of so many characters.
LONG_UNIT, WINDOW = 256, 1 << 16
#: Scores are whole numbers of this part, so sums are exact and ties are ties.
SCALE = 1e6


class DoubleArray:
    """A trie over code points as two arrays: the child of ``state`` by ``symbol``
    is ``base[state] + symbol`` if ``check`` there names ``state``. ``value`` holds
    the piece that ends at a state, or -1."""

    def __init__(self, words: dict[str, int]):
        # Frequent symbols get small numbers, which keeps children close together.
        alphabet = [c for c, _ in Counter(c for w in words for c in w).most_common()]
        self.symbol = np.zeros(0x110000, dtype=np.int32)  # 0: in no piece
        for k, c in enumerate(alphabet, 1):
            self.symbol[ord(c)] = k
        children: list[dict[int, int]] = [{}]
        ends = {0: -1}
        for word, number in words.items():
            node = 0
            for c in word:
                key = int(self.symbol[ord(c)])
                if key not in children[node]:
                    children[node][key] = len(children)
                    children.append({})
                node = children[node][key]
            ends[node] = number
        size = len(children) + 2 * len(alphabet) + 2
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, dtype=bool)
        free[0] = False
        start, tail, queue = 1, 1, [(0, 0)]
        while queue:
            node, state = queue.pop()
            value[state] = ends.get(node, -1)
            keys = np.array(sorted(children[node]), dtype=np.int64)
            if not len(keys):
                continue
            while not free[start]:
                start += 1
            # The first of some free places that suits all children, else the end.
            tried = start + np.flatnonzero(free[start : start + 256])
            fits = free[np.minimum(tried[:, None] + (keys - keys[0]), len(free) - 1)].all(axis=1) & (tried > keys[0])
            at = int(tried[fits][0] - keys[0]) if fits.any() else max(tail, 1)
            while at + int(keys[-1]) + 1 >= len(free):
                grow = len(free)
                base, value = np.concatenate([base, np.zeros(grow, np.int32)]), np.concatenate([value, np.full(grow, -1, np.int32)])
                check, free = np.concatenate([check, np.full(grow, -1, np.int32)]), np.concatenate([free, np.ones(grow, bool)])
            tail = max(tail, at + int(keys[-1]) + 1)
            base[state] = at
            check[at + keys] = state
            free[at + keys] = False
            queue += [(children[node][int(k)], at + int(k)) for k in keys]
        self.base, self.check, self.value = base, check, value

    def step(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Next states, -1 where there is none."""
        to = self.base[state] + symbol
        ok = (symbol > 0) & (to < len(self.check))
        to = np.where(ok, to, 0)
        return np.where(ok & (self.check[to] == state), to, -1)


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        self.bytes = np.full(256, -1, dtype=np.int64)
        self.text: list[bytes] = [b""] * len(texts)
        words = {}
        for i, t in enumerate(texts):
            if found := BYTE_PIECE.fullmatch(t):
                self.bytes[int(found[1], 16)] = i
                self.text[i] = bytes([int(found[1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i)):
                words[t] = i
                self.text[i] = t.replace(MARKER, " ").encode()
        self.trie = DoubleArray(words)
        # Ranks follow the ids, as the file lists its pieces in order.
        rank = {i: r for r, i in enumerate(sorted(words.values()), 1)}
        self.score = np.zeros(len(texts))
        for i, r in rank.items():
            self.score[i] = -np.round(SCALE * np.log(r))
        self.byte_score = -np.round(SCALE * (np.log(len(rank)) + 10))
        self.longest = max(map(len, words))
        self.known: dict[str, np.ndarray] = {}
        self.known_chars = 0
        #: The trie as lists, for walks one step at a time; made when a long unit comes.
        self.lists: tuple[list[int], ...] | None = None

    def encode_units(self, units: list[str]) -> list[np.ndarray]:
        """Viterbi for many units at once."""
        order = sorted(range(len(units)), key=lambda k: len(units[k]))
        out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(units)
        at = 0
        while at < len(order):
            if len(units[order[at]]) > LONG_UNIT:
                out[order[at]] = self.encode_long(units[order[at]])
                at += 1
                continue
            # Units of about one length.
            end = at + 1
            width = min(LONG_UNIT, max(8, 2 * len(units[order[at]])))
            while end < len(order) and end - at < 8192 and len(units[order[end]]) <= width:
                end += 1
            for k, ids in zip(order[at:end], self._viterbi([units[k] for k in order[at:end]]), strict=True):
                out[k] = ids
            at = end
        return out

    def _viterbi(self, units: list[str]) -> list[np.ndarray]:
        length = np.array([len(u) for u in units])
        width, n = int(length.max()), len(units)
        points = np.zeros((n, width), dtype=np.int64)
        flat = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        row = np.repeat(np.arange(n), length)
        points[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = flat
        symbol = self.trie.symbol[points]
        n_bytes = np.where(points < 0x80, 1, np.where(points < 0x800, 2, np.where(points < 0x10000, 3, 4)))
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, width + 1), dtype=np.int32)  # start of the last piece
        piece = np.full((n, width + 1), -1, dtype=np.int32)  # -1: bytes
        for p in range(width):
            live = np.flatnonzero(length > p)
            state = self.trie.step(np.zeros(len(live), dtype=np.int32), symbol[live, p])
            single = np.zeros(len(live), dtype=bool)
            walk, depth = np.arange(len(live)), 0
            while True:
                on = np.flatnonzero(state >= 0)
                walk, state = walk[on], state[on]
                if not len(walk):
                    break
                depth += 1
                number = self.trie.value[state]
                ends = number >= 0
                rows, ids = live[walk[ends]], number[ends]
                if depth == 1:
                    single[walk[ends]] = True
                score = best[rows, p] + self.score[ids]
                # Starts come in order, so on a tie the earlier start, the longer piece, stays.
                better = score > best[rows, p + depth]
                rows = rows[better]
                best[rows, p + depth] = score[better]
                back[rows, p + depth], piece[rows, p + depth] = p, ids[better]
                on = np.flatnonzero(length[live[walk]] > p + depth)
                walk, state = walk[on], state[on]
                if not len(walk):
                    break
                state = self.trie.step(state, symbol[live[walk], p + depth])
            rows = live[~single]
            score = best[rows, p] + self.byte_score * n_bytes[rows, p]
            better = score > best[rows, p + 1]
            rows = rows[better]
            best[rows, p + 1] = score[better]
            back[rows, p + 1], piece[rows, p + 1] = p, -1
        out = []
        for k, unit in enumerate(units):
            ids, at = [], len(unit)
            while at:
                start, number = int(back[k, at]), int(piece[k, at])
                if number >= 0:
                    ids.append(number)
                else:
                    ids += [int(self.bytes[b]) for b in reversed(unit[start:at].encode("utf-8", "surrogatepass"))]
                at = start
            out.append(np.array(ids[::-1], dtype=np.int32))
        return out

    def encode_long(self, unit: str, window: int = WINDOW) -> np.ndarray:
        """Viterbi of one unit, window by window."""
        if self.lists is None:
            self.lists = tuple(x.tolist() for x in (self.trie.base, self.trie.check, self.trie.value, self.score))
        base, check, value, score = self.lists
        out = array("i")
        done = 0  # settled characters
        best: list[float] = [0.0]  # from ``done`` on
        back: list[int] = [0]
        piece: list[int] = [-1]
        reached = 0  # positions walked from, beyond ``done``
        while done < len(unit):
            held = min(len(unit), done + reached + window + self.longest)
            symbol = self.trie.symbol[np.frombuffer(unit[done:held].encode("utf-32-le", "surrogatepass"), dtype=np.uint32)].tolist()
            last = min(len(unit) - done, reached + window)
            room = len(symbol) + 1 - len(best)
            best += [-np.inf] * room
            back += [0] * room
            piece += [-1] * room
            for p in range(reached, last):
                state, q, here, single = 0, p, best[p], False
                while q < len(symbol):
                    c = symbol[q]
                    to = base[state] + c
                    if not c or to >= len(check) or check[to] != state:
                        break
                    state, q = to, q + 1
                    number = value[state]
                    if number >= 0:
                        single = single or q == p + 1
                        # Starts come in order, so on a tie the longer piece stays.
                        if here + score[number] > best[q]:
                            best[q], back[q], piece[q] = here + score[number], p, number
                if not single:
                    size = len(unit[done + p].encode("utf-8", "surrogatepass"))
                    if here + self.byte_score * size > best[p + 1]:
                        best[p + 1], back[p + 1], piece[p + 1] = here + self.byte_score * size, p, -1
            reached = last
            if done + last == len(unit):
                meet = last
            else:
                # Every later path passes one of the positions from ``last`` on that a piece
                # reaches; all were reached from before ``last``.
                meet = self._meeting(back, [q for q in range(last, min(last + self.longest, len(best))) if best[q] > -np.inf])
            out.extend(self._traced(unit, done, back, piece, meet))
            best, back, piece = best[meet:], [max(0, b - meet) for b in back[meet:]], piece[meet:]
            done, reached = done + meet, reached - meet
        return np.array(out, dtype=np.int32)

    @staticmethod
    def _meeting(back: list[int], ends: list[int]) -> int:
        """The last position that the best paths to all ``ends`` share."""
        paths = sorted(set(ends))
        while len(paths) > 1:
            # The furthest steps back; paths that meet become one.
            paths = sorted({*paths[:-1], back[paths[-1]]})
        return paths[0]

    def _traced(self, unit: str, done: int, back: list[int], piece: list[int], at: int) -> list[int]:
        ids: list[int] = []
        while at:
            start, number = back[at], piece[at]
            if number >= 0:
                ids.append(number)
            else:
                ids += [int(self.bytes[b]) for b in reversed(unit[done + start : done + at].encode("utf-8", "surrogatepass"))]
            at = start
        return ids[::-1]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        split = [UNIT.findall(MARKER + t.replace(" ", MARKER)) if t else [] for t in texts]
        if self.known_chars > CACHE_CHARS:
            self.known.clear()
            self.known_chars = 0
        new = list({u for units in split for u in units if u not in self.known})
        coded = dict(zip(new, self.encode_units(new), strict=True))
        out = []
        for units in split:
            own = [coded[u] if u in coded else self.known[u] for u in units]
            out.append(np.concatenate(own) if own else np.zeros(0, np.int32))
        short = {u: ids for u, ids in coded.items() if len(u) <= CACHE_UNIT}
        self.known.update(short)
        self.known_chars += sum(map(len, short))
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Piece texts joined, markers as spaces, without the one that encoding put first."""
        text = b"".join([self.text[i] for i in ids.tolist()]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(maxsize=1)
def load(path: str) -> Pieces:
    return Pieces(path)


MEMORIES["pieces"] = load.cache_clear


def _coded(path: str, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(path)
        byte_ids = np.zeros(len(pieces.text), dtype=bool)
        byte_ids[pieces.bytes[pieces.bytes >= 0]] = True
        for whole in batches:
            for batch in text_batches(whole, "text", 1 << 20):
                texts = batch.column("text").to_pylist()
                found = pieces.encode(texts)
                names = ["doc_id", "n_pieces", "n_byte_pieces", "ids_crc32", "round_trip"]
                columns = [
                    batch.column("doc_id"),
                    pa.array([len(i) for i in found], pa.int64()),
                    pa.array([int(byte_ids[i].sum()) for i in found], pa.int64()),
                    pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in found], pa.int64()),
                    pa.array([pieces.decode(i) == (t or "").replace(MARKER, " ") for i, t in zip(found, texts, strict=True)]),
                ]
                if with_ids:
                    names.append("ids")
                    columns.append(pa.array([i.tolist() for i in found], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode_documents(docs: DataFrame, model_path: str, *, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, ids_crc32 (unsigned, little-endian 32-bit
    ids), round_trip (decoding gives the text back), and with ``with_ids`` ids."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, round_trip boolean" + (", ids array<int>" if with_ids else "")
    return arrow_pass(rows, _coded(model_path, with_ids), schema, remembers="pieces")


def decode_documents(coded: DataFrame, model_path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of id lists; a null list gives the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model_path)
        for batch in batches:
            texts = [pieces.decode(np.array(i or [], dtype=np.int64)) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    rows = coded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return arrow_pass(rows, run, "doc_id long, text string", remembers="pieces")
