"""Secret scans with a trigram inverted index, in DataFrame functions only.

Each rule is a regular expression. Its Boolean trigram query (an OR of ANDs)
is derived from the parsed expression. The index has one posting per document
and trigram that some query names; a group-by on the document intersects the
postings, and only documents that satisfy a rule's query are joined back and
verified with the rule's expression. Rules without a mandatory trigram, such as
a run of hex digits, scan every text.

Postings hold the trigrams of the lower-cased text, so they over-approximate;
verification is exact. Posting keys are hashes of the id and text: a collision
or a repeated row can only add a candidate.

Cases: a null or empty text has no spans; a null id is kept as it is; repeated
rows each give a row; extra columns are ignored by ``scan_secrets``.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as sre
from re import _parser as sre_parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """``group``/``min_length``: a match fails if that group is shorter."""

    kind: str
    regex: str
    group: int = 0
    min_length: int = 0


# The three base kinds, in their listed order.
BASE_RULES = (
    Rule(
        "assign",
        r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    # A greedy run of at least n characters is the same as a failing test on the whole run.
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("url_login", r"[a-z][a-z0-9+.-]{1,20}://[^\s:/@]{1,64}:[^\s:/@]{1,64}@"),
)
RULES = BASE_RULES + EXTRA_RULES


# --- Boolean trigram queries -------------------------------------------------

Dnf = frozenset  # of frozensets of trigrams; {frozenset()} is "always"
ALWAYS: Dnf = frozenset([frozenset()])


def _both(a: Dnf, b: Dnf) -> Dnf:
    """AND of two queries; the weaker of the two if the product would be large."""
    if len(a) * len(b) > MAX_ALTERNATIVES:
        return min((x for x in (a, b) if x != ALWAYS), key=len)
    return _absorb(frozenset(x | y for x, y in product(a, b)))


def _absorb(q: Dnf) -> Dnf:
    return frozenset(x for x in q if not any(y < x for y in q))


def _of_strings(strings: set[str]) -> Dnf:
    return _absorb(
        frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)
    )


def _strings(item) -> set[str] | None:
    """All strings an element can match, or None if they are too many."""
    op, arg = item
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        if any(kind is not sre.LITERAL for kind, _ in arg) or len(arg) > 8:
            return None
        return {chr(c).lower() for _, c in arg}
    if op is sre.SUBPATTERN:
        return _sequence_strings(arg[-1])
    if op is sre.BRANCH:
        found = [_sequence_strings(branch) for branch in arg[1]]
        return None if None in found else set().union(*found)
    if op is sre.MAX_REPEAT:
        low, high, body = arg
        inner = _sequence_strings(body)
        if inner is None or high > 3:
            return None
        return {
            "".join(p) for n in range(low, high + 1) for p in product(inner, repeat=n)
        }
    return None


def _sequence_strings(sequence) -> set[str] | None:
    whole = {""}
    for item in sequence:
        inner = _strings(item)
        if inner is None or len(whole) * len(inner) > MAX_ALTERNATIVES:
            return None
        whole = {a + b for a in whole for b in inner}
    return whole


def _query(sequence) -> Dnf:
    """Join neighbouring enumerable elements into strings; AND what they demand."""
    query, run = ALWAYS, {""}
    for item in [*sequence, None]:
        inner = _strings(item) if item else None
        if inner is not None and len(run) * len(inner) <= MAX_ALTERNATIVES:
            run = {a + b for a in run for b in inner}
            continue
        query, run = _both(query, _of_strings(run)), inner or {""}
        if inner is None and item:
            op, arg = item
            if op is sre.SUBPATTERN:
                query = _both(query, _query(arg[-1]))
            elif op is sre.BRANCH:
                query = _both(query, frozenset().union(*(_query(b) for b in arg[1])))
            elif op is sre.MAX_REPEAT and arg[0] > 0:
                query = _both(query, _query(arg[2]))
    return query


def trigram_query(regex: str) -> list[list[str]]:
    """The OR of ANDs of lower-case trigrams that any match of ``regex`` must
    contain; an empty list if no trigram is mandatory."""
    query = _query(sre_parser.parse(regex))
    if any(not clause for clause in query):
        return []
    return sorted(sorted(clause) for clause in query)


#: Steps of a fold over a list.
FOLD = 512


# --- spans -------------------------------------------------------------------


def rule_spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, kind_no, end>> of one rule, in code points. The texts
    between the matches and the matches themselves give all positions."""
    matches = F.regexp_extract_all(text, F.lit(rule.regex), F.lit(0))
    checked = (
        F.regexp_extract_all(text, F.lit(rule.regex), F.lit(rule.group))
        if rule.group
        else matches
    )
    lengths = F.transform(
        F.arrays_zip(
            F.slice(F.split(text, rule.regex, -1), F.lit(1), F.size(matches)).alias("gap"),
            matches.alias("hit"),
            checked.alias("part"),
        ),
        lambda z: F.struct(
            F.length(z["gap"]).alias("gap"),
            F.length(z["hit"]).alias("hit"),
            F.length(z["part"]).alias("part"),
        ),
    )
    none = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")

    def placed(chunk: Column, at: Column) -> Column:
        """The spans of a chunk that begins at a place."""
        return F.aggregate(
            chunk,
            F.struct(at.alias("at"), none.alias("spans")),
            lambda acc, z: F.struct(
                (acc["at"] + z["gap"] + z["hit"]).alias("at"),
                F.when(
                    z["part"] >= rule.min_length,
                    F.concat(
                        acc["spans"],
                        F.array(
                            F.struct(
                                (acc["at"] + z["gap"]).alias("start"),
                                F.lit(number).alias("kind_no"),
                                (acc["at"] + z["gap"] + z["hit"]).alias("end"),
                            )
                        ),
                    ),
                )
                .otherwise(acc["spans"])
                .alias("spans"),
            ),
            lambda acc: acc["spans"],
        )

    total = lambda chunk: F.aggregate(chunk, F.lit(0), lambda t, z: t + z["gap"] + z["hit"])
    return F.when(F.size(matches) > 0, _by_chunks(lengths, total, placed)).otherwise(none)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _by_chunks(items: Column, total, work) -> Column:
    """The joined results of ``work`` on chunks of a list, each with the sum of ``total`` over
    the chunks before it. A fold copies what it has gathered at each step, so it must not
    run over a list of any length; over chunks the copies are in proportion to it."""

    def chunked(own: Column) -> Column:
        last = F.floor((F.size(own) - 1) / FOLD).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(own, k * FOLD + 1, F.lit(FOLD)))
        return F.transform(chunks, lambda c: F.struct(c.alias("c"), total(c).alias("n")))

    def placed(chunks: Column) -> Column:
        starts = F.aggregate(
            chunks,
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda acc, c: F.struct((acc["at"] + c["n"]).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"],
        )
        return F.flatten(F.zip_with(chunks, starts, lambda c, at: work(c["c"], at)))

    return _let(_let(items, chunked), placed)


def candidates(rows: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(uid, may): ``may`` has bit i for each indexed rule i whose query the
    document's postings satisfy. ``rows`` has uid and text."""
    queries = {i: trigram_query(rule.regex) for i, rule in enumerate(rules)}
    clauses = [(i, c) for i, found in queries.items() for c in found]
    named = sorted({t for _, clause in clauses for t in clause})
    vocabulary = F.array(*[F.lit(t) for t in named])
    postings = (
        # The generator keeps the lower-cased text from being computed once per trigram.
        rows.select("uid", F.explode(F.array(F.lower("text"))).alias("low"))
        .select("uid", F.explode(F.filter(vocabulary, lambda t: F.contains(F.col("low"), t))).alias("trigram"))
    )
    counted = postings.groupBy("uid").agg(
        *[
            F.count(F.when(F.col("trigram").isin(clause), 1)).alias(f"c{k}")
            for k, (_, clause) in enumerate(clauses)
        ]
    )
    may = F.lit(0)
    for k, (i, clause) in enumerate(clauses):
        may = may.bitwiseOR(F.when(F.col(f"c{k}") >= len(clause), 1 << i).otherwise(0))
    return counted.select("uid", may.alias("may")).where("may != 0")


def scan_secrets(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: tuple[str, ...] = (),
    rules: tuple[Rule, ...] = RULES,
) -> DataFrame:
    """One row per document: ``id``, ``text``, the ``keep`` columns (in a struct
    ``kept``) and ``spans``: array<struct<start, kind_no, end>> by start, then
    rule order; positions are code points, ends exclusive."""
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        (F.struct(*keep) if keep else F.lit(None).cast("string")).alias("kept"),
    ).withColumn("uid", F.xxhash64("id", "text"))
    found = candidates(rows.select("uid", "text"), rules)
    # The candidate side has one row a document and builds the hash table; texts are not sorted.
    joined = rows.join(found.hint("shuffle_hash"), "uid", "left")
    spans = []
    for i, rule in enumerate(rules):
        own = rule_spans(F.col("text"), rule, i)
        if trigram_query(rule.regex):
            none = F.array().cast("array<struct<start:int,kind_no:int,end:int>>")
            own = F.when(F.col("may").bitwiseAND(F.lit(1 << i)) != 0, own).otherwise(none)
        spans.append(own)
    return joined.select("id", "text", "kept", F.array_sort(F.concat(*spans)).alias("spans"))


def spans_text(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat(
                F.element_at(kinds, s["kind_no"] + 1), F.lit(":"),
                s["start"].cast("string"), F.lit(":"), s["end"].cast("string"),
            ),
        ),
        ",",
    )


def secret_report(docs: DataFrame) -> DataFrame:
    """The digest per document: counts of the base kinds, the SHA-256 of the base
    spans and all spans."""
    found = scan_secrets(docs)
    base = F.filter("spans", lambda s: s["kind_no"] < len(BASE_RULES))

    def count_of(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind_no"] == number)).cast("long")

    counts = [count_of(i).alias(f"n_{rule.kind}") for i, rule in enumerate(BASE_RULES)]
    return found.select(
        F.col("id").alias("doc_id"),
        *counts,
        F.sha2(spans_text(base).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans")).alias("spans"),
    )


def redacted(text: Column, spans: Column, marker: str = "[SECRET]") -> Column:
    """``text`` with each stretch covered by spans replaced by ``marker``."""

    def folded(own: Column, reach: Column) -> Column:
        """The stretches of a chunk; the first one has no start and ends where those before reach."""
        none = F.array(F.struct(F.lit(-1).alias("start"), reach.alias("end")))
        merged = lambda out, s: F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))
        return F.aggregate(
            own,
            none,
            lambda out, s: F.when(
                s["start"] < F.element_at(out, -1)["end"], F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(merged(out, s)))
            ).otherwise(F.concat(out, F.array(F.struct(s["start"].alias("start"), s["end"].alias("end"))))),
        )

    def chunked(own: Column) -> Column:
        last = F.floor((F.size(own) - 1) / FOLD).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(own, k * FOLD + 1, F.lit(FOLD)))
        return F.transform(chunks, lambda c: F.struct(c.alias("c"), F.array_max(F.transform(c, lambda s: s["end"])).alias("n")))

    def piece(chunk: Column, reach: Column) -> Column:
        """The text from where the chunks before reach to where this one does."""
        own = F.substring(text, reach + 1, F.greatest(reach, chunk["n"]) - reach)

        def joined(z: Column) -> Column:
            found = z["found"]
            return F.array_join(
                F.transform(
                    found,
                    lambda s, i: F.when(s["start"] < 0, "").otherwise(
                        F.concat(F.substring(z["own"], F.get(found, i - 1)["end"] - reach + 1, s["start"] - F.get(found, i - 1)["end"]), F.lit(marker))
                    ),
                ),
                "",
            )

        return _let(F.struct(own.alias("own"), folded(chunk["c"], reach).alias("found")), joined)

    def whole(chunks: Column) -> Column:
        reaches = F.aggregate(chunks, F.array(F.lit(0)), lambda out, c: F.concat(out, F.array(F.greatest(F.element_at(out, -1), c["n"]))))
        starts = _let(reaches, lambda r: F.zip_with(chunks, F.slice(r, F.lit(1), F.size(r) - 1), piece))
        end = F.array_max(F.transform(chunks, lambda c: c["n"]))
        return F.concat(F.array_join(starts, ""), F.substring(text, end + 1, F.length(text)))

    return F.when(F.size(spans) == 0, text).otherwise(_let(_let(spans, chunked), whole))
