"""Conversation structure repair by cost layers of reachable grammar states.

Role initials of a whole conversation are to match ``(s?(ua)+)?``, whose states are
START, SYSTEM (after s), USER (after u) and REPLY (after ua); START and REPLY accept.
Each turn is kept (cost 0), given another role (3) or deleted (4, the only edit of a
blank or repeated turn); turns without text may be inserted anywhere (3); a truncated
turn that stays costs 3 more.

For each turn there is a bitset of (layer, state): the states from which the rest of the
conversation can be accepted at exactly base + layer. An edit of the next turn shifts its
bitset by the edit's layers; insertions shift a bitset within its turn. From the layer
that first holds START at the first turn, the bits are followed forwards: at each turn the
edit of the smallest letter that stays on a cheapest way, so the audit is the least. A
band of eight layers is exact: insertions lead from any state to USER and REPLY, and what
the rest costs from START (where deleting a leading s makes up for it) it costs from USER
and REPLY with at most 7 more, so all states lie within eight layers.

A conversation may hold any share of all rows. Its rows are numbered in order over range
partitions (text left behind), and cut into segments of SEGMENT rows. A segment gives the
least (cost, audit) between each pair of states; a conversation joins these, a row for
each SEGMENT turns. Ways of equal cost are compared by their audits segment by segment:
where one audit begins another, the shorter leaves its insertions to the next segment.
Only the last pass brings the texts, once, sorted by conversation and order: it streams
them into a digest and holds one batch at a time. SHA-256 reads its input in sequence, so
a conversation's texts go through one task there, and its audit is one value of the result.

Cases: null roles and texts are one space, a null conversation or turn is one space in
the checksum; rows of a null conversation are one conversation; null turns come first.
Equal turns are ordered by role and text, rows that are equal altogether stand together,
the first of them is no duplicate of the others. A role without an initial s, u or a can
only be given another or deleted. All rows dropped: zeros, an empty audit, the hash of the
empty string. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby, islice, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partweave.llm.common import arrow_pass, stored
from partweave.operators.ordering import numbered

START, SYSTEM, USER, REPLY = range(4)
STATES, LAYERS = 4, 8
BAND = (1 << (STATES * LAYERS)) - 1
RETYPE, DELETE, INSERT, CUT = 3, 4, 3, 3
#: After each state: the state that a u or an a leads to, and the role that it takes.
NEXT = {START: USER, SYSTEM: USER, USER: REPLY, REPLY: USER}
ROLE = {START: "user", SYSTEM: "user", USER: "assistant", REPLY: "user"}
#: Where a kept turn of an initial leads.
KEEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", REPLY): USER, ("a", USER): REPLY}
SEGMENT = 1024
BLANK = r"[^\x20\x09-\x0D]"


# --- cost layers -------------------------------------------------------------


@lru_cache(maxsize=None)
def edits(kind: str) -> tuple[tuple[str, int, tuple[tuple[int, int], ...]], ...]:
    """(letter, cost, ((state, next state), ...)) of a turn, by letter. A kind is an
    initial (or a dot) with x if the turn must go, t if it is truncated, else a space."""
    cut = CUT if kind[1] == "t" else 0
    found = [("D", DELETE, tuple((s, s) for s in range(STATES)))]
    if kind[1] != "x":
        found.append(("K", cut, tuple((s, t) for (i, s), t in KEEPS.items() if i == kind[0])))
        found.append(("R", RETYPE + cut, tuple(NEXT.items())))
    return tuple(found)


def _inserts(bits: int) -> int:
    """With the layers that insertions before the next turn reach."""
    for layer in range(LAYERS):
        for state, then in NEXT.items():
            if layer >= INSERT and bits >> ((layer - INSERT) * STATES + then) & 1:
                bits |= 1 << (layer * STATES + state)
    return bits


def _least_layers(bits: int) -> int:
    """Only the first layer of each state."""
    out, seen = 0, 0
    for layer in range(LAYERS):
        own = bits >> (layer * STATES) & 15 & ~seen
        out |= own << (layer * STATES)
        seen |= own
    return out


def _settled(bits: int) -> tuple[int, int]:
    """Bits moved down to their first layer, and by how many."""
    down = ((bits & -bits).bit_length() - 1) // STATES
    return down, bits >> (down * STATES)


@lru_cache(maxsize=1 << 16)
def before(bits: int, kind: str) -> tuple[int, int]:
    """(rise of the base, bitset) before a turn, from the bitset after it."""
    out = 0
    for _, cost, moves in edits(kind):
        for state, then in moves:
            for layer in range(LAYERS):
                if bits >> (layer * STATES + then) & 1:
                    out |= 1 << ((layer + cost) * STATES + state)
    down, out = _settled(out)
    return down, _least_layers(_inserts(out & BAND))


#: At the end: START and REPLY accept at no cost, the others after insertions.
END = _least_layers(_inserts(1 << START | 1 << REPLY))


def layer_of(bits: int, state: int) -> int | None:
    return next((k for k in range(LAYERS) if bits >> (k * STATES + state) & 1), None)


def repair(kinds: list[str], entry: int = START, end: int = END) -> tuple[int, str, int]:
    """(cost, audit, state after the last turn) of the cheapest and least edits from
    ``entry``; ``end`` holds the states that accept there, by layers."""
    bits, bases = [end], [0]
    for kind in reversed(kinds):
        down, own = before(bits[-1], kind)
        bits.append(own)
        bases.append(bases[-1] + down)
    bits.reverse()
    bases.reverse()
    at, state, audit = 0, entry, []
    layer = layer_of(bits[0], state)
    if layer is None:
        return -1, "", -1
    cost = left = bases[0] + layer
    while True:
        for letter, price, moves in _choices(kinds[at] if at < len(kinds) else None):
            then = dict(moves).get(state)
            where = at + (letter != "I")
            if then is not None and (own := left - price - bases[where]) >= 0 and own < LAYERS and bits[where] >> (own * STATES + then) & 1:
                audit.append(letter)
                at, state, left = where, then, left - price
                break
        else:
            return cost, "".join(audit), state


@lru_cache(maxsize=None)
def _choices(kind: str | None) -> tuple:
    """All edits before the turns that are left, by letter."""
    own = edits(kind) if kind is not None else ()
    return tuple(sorted([*own, ("I", INSERT, tuple(NEXT.items()))]))


def routes(kinds: list[str]) -> list[tuple[int, int, int, str]]:
    """(state, state after, cost, audit) of a segment, for each pair that edits join."""
    out = []
    for after in range(STATES):
        end = _least_layers(_inserts(1 << after))
        for state in range(STATES):
            cost, audit, last = repair(kinds, state, end)
            if last == after:
                out.append((state, after, cost, audit))
    return out


def joined(segments: list[list[tuple[int, int, int, str]]]) -> tuple[int, str, list[int]]:
    """(cost, audit, state at the start of each segment) over segments in order."""
    rest: list[dict[int, int]] = [{START: 0, REPLY: 0, USER: INSERT, SYSTEM: 2 * INSERT}]
    for own in reversed(segments):
        least: dict[int, int] = {}
        for state, after, cost, _ in own:
            if after in rest[-1]:
                least[state] = min(least.get(state, 1 << 62), cost + rest[-1][after])
        rest.append(least)
    rest.reverse()
    state, audit, starts = START, [], []
    for k, own in enumerate(segments):
        starts.append(state)
        ways = [(text, after) for s, after, cost, text in own if s == state and after in rest[k + 1] and cost + rest[k + 1][after] == rest[k][state]]
        text, state = min(ways)
        audit.append(text)
    tail = {START: "", REPLY: "", USER: "I", SYSTEM: "II"}[state]
    return rest[0][START], "".join(audit) + tail, starts


# --- damage and faults -------------------------------------------------------


def damaged(df: DataFrame) -> DataFrame:
    """conv, turn, role, text after the damage that each row's checksum prescribes."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = df.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
        (F.crc32(key.cast("binary")) % 20).alias("harm"),
    ).where("harm <> 0")
    text = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.when(F.col("harm") == 3, 2).otherwise(1)
    return rows.select("conv", "turn", F.when(F.col("harm") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), times.alias("times"))


def _kind(role: Column, text: Column) -> Column:
    initial = F.substring(role, 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise(".")
    cut = ~F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1).isin(".", "!", "?")
    return F.concat(initial, F.when(~F.regexp_like(text, F.lit(BLANK)), "x").when(cut, "t").otherwise(" "))


def order_of(prefix: str = "") -> list[Column]:
    return [F.col(f"{prefix}turn").asc_nulls_first(), F.col(f"{prefix}role"), F.col(f"{prefix}digest")]


def faults(rows: DataFrame) -> DataFrame:
    """Of each different row: conv, turn, role, digest, times, kind, blank and first, which
    tells whether its role and text stand nowhere earlier. Equal rows are counted before
    they meet, and only digests of texts travel."""
    narrow = rows.select("conv", "turn", "role", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), _kind(F.col("role"), F.col("text")).alias("kind"), "times")
    different = narrow.groupBy("conv", "turn", "role", "digest", "kind").agg(F.sum("times").alias("times"))
    different = stored(different, "turns")
    earliest = different.groupBy(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest")).agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("held"), F.col("turn").alias("turn"))).alias("_first")
    )
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    return different.join(earliest, same).select(
        "conv", "turn", "role", "digest", "times", "kind", (F.col("kind").endswith("x")).alias("blank"), F.col("turn").eqNullSafe(F.col("_first.turn")).alias("first")
    )


# --- Spark passes ------------------------------------------------------------


_ROUTES = "array<struct<state:int,after:int,cost:long,audit:string>>"
_ARROW = {
    "long": pa.int64(),
    "string": pa.string(),
    _ROUTES: pa.list_(pa.struct([("state", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])),
}
_SEGMENT = f"conv long, segment long, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, routes {_ROUTES}"
_WHOLE = "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_LEGAL = {"su", "ua", "au"}
#: Results sent on together.
GROUPS = 512


def _rows(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def _sent(groups: Iterator[dict], schema: str) -> Iterator[pa.RecordBatch]:
    arrow = pa.schema([(name, _ARROW[kind]) for name, kind in (f.split() for f in schema.split(", "))])
    while own := list(islice(groups, GROUPS)):
        yield pa.RecordBatch.from_pylist(own, schema=arrow)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each segment (rows in order): its counts, what its neighbours need to see of it,
    and its routes."""

    def found() -> Iterator[dict]:
        for (conv, segment), own in groupby(_rows(batches, "conv", "segment", "turn", "kind", "fault"), key=lambda r: r[:2]):
            _, _, turn, kinds, fault = zip(*own, strict=True)
            dated = [t for t in turn if t is not None]
            initials = "".join(k[0] for k in kinds)
            yield {
                "conv": conv, "segment": segment, "first": initials[0], "last": initials[-1],
                "low": dated[0] if dated else None, "high": dated[-1] if dated else None, "turns": len(set(dated)),
                "blank": fault.count("b"), "duplicate": fault.count("d"), "truncated": fault.count("t"),
                "illegal": sum(initials[k : k + 2] not in _LEGAL for k in range(len(initials) - 1)),
                "routes": [dict(zip(("state", "after", "cost", "audit"), r, strict=True)) for r in routes(list(kinds))],
            }

    return _sent(found(), _SEGMENT)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each conversation from its segments, in order."""
    columns = [f.split()[0] for f in _SEGMENT.split(", ")]

    def found() -> Iterator[dict]:
        for conv, own in groupby(_rows(batches, *columns), key=lambda r: r[0]):
            parts = [dict(zip(columns, r, strict=True)) for r in own]
            illegal = sum(p["illegal"] for p in parts) + sum(a["last"] + b["first"] not in _LEGAL for a, b in pairwise(parts))
            # A turn at a border is counted by both neighbours.
            dated = [p for p in parts if p["turns"]]
            distinct = sum(p["turns"] for p in dated) - sum(a["high"] == b["low"] for a, b in pairwise(dated))
            cost, audit, _ = joined([[(r["state"], r["after"], r["cost"], r["audit"]) for r in p["routes"]] for p in parts])
            yield {
                "conv": conv, "gaps": dated[-1]["high"] - dated[0]["low"] + 1 - distinct if dated else 0,
                **{c: sum(p[c] for p in parts) for c in ("blank", "duplicate", "truncated")}, "illegal": illegal, "cost": cost, "audit": audit,
            }

    return _sent(found(), _WHOLE)


def repaired_lines(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) of the repaired conversation from its audit and its rows."""
    state = START
    for letter in audit:
        if letter == "I":
            yield ROLE[state], ""
            state = NEXT[state]
            continue
        role, text = next(rows)
        if letter == "K":
            yield role, text
            state = KEEPS[role[:1], state]
        elif letter == "R":
            yield ROLE[state], text
            state = NEXT[state]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, the audit first: the digest of what is left, fed row by row."""
    state: dict = {}

    def texts(own: list[tuple]) -> Iterator[tuple[str, str]]:
        while own[0] is not None and own[0][:2] == (state["conv"], 1):
            _, _, role, text, times = own[0]
            for _ in range(times):
                yield role, text
            own[0] = next(source, None)

    source = _rows(batches, "conv", "kind", "role", "text", "times")
    own = [next(source, None)]

    def found() -> Iterator[dict]:
        while own[0] is not None:
            state["conv"], _, _, audit, _ = own[0]
            own[0] = next(source, None)
            sha, between = hashlib.sha256(), ""
            rest = texts(own)
            for role, text in repaired_lines(audit, rest):
                sha.update(f"{between}{role}:{text}".encode("utf-8", "surrogatepass"))
                between = "\n"
            for _ in rest:  # no row is left, as the audit has a letter for each
                pass
            yield {"conv": state["conv"], "repaired_sha256": sha.hexdigest()}

    return _sent(found(), "conv long, repaired_sha256 string")


def repair_conversations(df: DataFrame) -> DataFrame:
    """conv_id, counts of faults, cost, audit and the digest of the repaired rows."""
    rows = damaged(df)
    known = faults(rows)
    # Rows that are equal altogether: the first stands for itself, the others are duplicates.
    each = known.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times").cast("int"))))
    again = ~F.col("first") | (F.col("copy") > 1)
    gone = F.col("blank") | again
    marked = each.select(
        "conv", "turn", "role", "digest", "copy",
        F.when(gone, F.concat(F.substring("kind", 1, 1), F.lit("x"))).otherwise(F.col("kind")).alias("kind"),
        F.when(F.col("blank"), "b").when(again, "d").when(F.col("kind").endswith("t"), "t").otherwise("").alias("fault"),
    )
    counted = numbered(marked, [], [F.col("conv").asc_nulls_first(), *order_of(), "copy"], "number")
    cut = counted.select("conv", "turn", "kind", "fault", "number", F.expr(f"number DIV {SEGMENT}").alias("segment"))
    segments = arrow_pass(cut.repartition("conv", "segment").sortWithinPartitions("conv", "segment", "number"), _segments, _SEGMENT)
    wholes = stored(arrow_pass(segments.repartition("conv").sortWithinPartitions("conv", "segment"), _conversations, _WHOLE), "conversations")
    audits = wholes.select("conv", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("times"))
    texts = rows.select("conv", F.lit(1).alias("kind"), "turn", "role", F.unhex(F.sha2(F.col("text"), 256)).alias("digest"), "text", F.col("times").cast("long").alias("times"))
    stream = audits.unionByName(texts).repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "kind", *order_of())
    digests = arrow_pass(stream.select("conv", "kind", "role", "text", "times"), _digests, "conv long, repaired_sha256 string")
    found = wholes.join(digests.withColumnRenamed("conv", "_conv"), F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    every = df.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = {c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")}
    return every.join(found, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256")
    )
