"""Oracle SQL of the training-data queries that SQL can express."""

from __future__ import annotations

from partweave.llm.secrets import BASE_RULES, RULES, Rule

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Base 32 of a SHA-1 in hex: five hex digits are four letters.
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n >> {shift}) & 31 AS INT) + 1, 1)"
OP1 = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 8), lambda k: list_transform([CAST('0x' || substr(hex, CAST(5 * k + 1 AS INT), 5) AS BIGINT)],
  lambda n: {" || ".join(_LETTER.format(shift=s) for s in (15, 10, 5, 0))})[1]), '') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM f"""

OP2 = f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM w WHERE len(w) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
each AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
kept AS (SELECT e.doc_id, array_to_string(list(e.word ORDER BY e.i) FILTER (WHERE g.i IS NULL), ' ') AS t, count(g.i) AS n_removed FROM each e LEFT JOIN gone g
  ON e.doc_id = g.doc_id AND e.i = g.i GROUP BY e.doc_id)
SELECT w.doc_id, len(w.w) AS n_words, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256 FROM w LEFT JOIN kept k ON w.doc_id = k.doc_id"""


def _spans(rule: Rule, number: int) -> str:
    """A list of (start, number, end) of one rule."""
    regex = rule.regex.replace("'", "''")
    hits, part = f"regexp_extract_all(t, '{regex}')", f"regexp_extract_all(t, '{regex}', {rule.group})"
    start = "list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0)"
    return f"""(SELECT list_filter(list_transform(range(1, len(hits) + 1), lambda i: {{'s': CAST({start} AS INT), 'k': {number}, 'e': CAST({start} AS INT) + CAST(length(hits[i]) AS INT), 'n': length(part[i])}}),
      lambda x: x.n >= {rule.min_length}) FROM (SELECT {hits} AS hits, {part} AS part, string_split_regex(t, '{regex}') AS gaps))"""


_KIND = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
_TEXT = f"array_to_string(list_transform(%s, lambda x: {_KIND}[x.k + 1] || ':' || x.s || ':' || x.e), ',')"
OP7 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT doc_id, list_sort(list_concat({", ".join(_spans(r, i) for i, r in enumerate(RULES))})) AS spans FROM d)
SELECT doc_id, {", ".join(f"CAST(len(list_filter(spans, lambda x: x.k = {i})) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(BASE_RULES))},
  sha256({_TEXT % f"list_filter(spans, lambda x: x.k < {len(BASE_RULES)})"}) AS base_sha256, {_TEXT % "spans"} AS spans FROM s"""

OP8 = f"""WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, {WORDS} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS i FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM d),
own AS (SELECT *, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') AS w FROM line),
words AS (SELECT *, regexp_replace(lower(array_to_string(w, ' ')), '\\d', '0', 'g') AS norm FROM own WHERE len(w) > 0),
dup AS (SELECT doc_id, sum(n - 1) AS n FROM (SELECT doc_id, line, count(*) AS n FROM words GROUP BY doc_id, line) GROUP BY doc_id),
per AS (SELECT doc_id, source, norm, sum(len(w)) AS n FROM words GROUP BY doc_id, source, norm),
host AS (SELECT source, count(*) AS n FROM d GROUP BY source),
over AS (SELECT p.source, p.norm FROM per p JOIN host h ON p.source IS NOT DISTINCT FROM h.source GROUP BY p.source, p.norm, h.n HAVING count(*) > greatest(20, 0.01 * h.n)),
rem AS (SELECT p.doc_id, sum(p.n) AS n FROM per p JOIN over o ON p.source IS NOT DISTINCT FROM o.source AND p.norm = o.norm GROUP BY p.doc_id),
m AS (SELECT d.doc_id, len(d.w) AS n_words, CAST(coalesce(list_sum(list_transform(d.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  len(regexp_extract_all(d.text, '[#*$%&|<>]')) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
  CAST(coalesce(rem.n, 0) AS BIGINT) AS n_removed_words FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN rem USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_words - n_removed_words < 0.3 * n_words AS depleted FROM m)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM f"""

OP9 = f"""WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n, list(s ORDER BY s) AS s FROM g GROUP BY doc_id),
pair AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT p.a, p.b, y.s AS s, p.n = x.n AND p.n = y.n AS same FROM pair p JOIN size x ON p.a = x.doc_id JOIN size y ON p.b = y.doc_id WHERE 10 * p.n >= 8 * (x.n + y.n - p.n)),
reach AS (SELECT doc_id AS a, doc_id AS c FROM d UNION SELECT l.b, r.c FROM reach r JOIN link l ON l.a = r.a),
root AS (SELECT a AS doc_id, min(c) AS class_id FROM reach GROUP BY a),
n AS (SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (WHERE same) AS n_same, min(b) FILTER (WHERE same) AS low, count(DISTINCT s) FILTER (WHERE NOT same) AS n_texts FROM link GROUP BY a)
SELECT d.doc_id, class_id, least(d.doc_id, coalesce(low, d.doc_id)) AS copy_id, coalesce(n_same, 0) + 1 AS n_copies, coalesce(n_links, 0) AS n_links, coalesce(n_texts, 0) AS n_linked_texts
FROM d JOIN root USING (doc_id) LEFT JOIN n USING (doc_id)"""


def _op11() -> str:
    """Four rounds of the assignment, each a pair of relations: nearest entries and moved entries."""
    gap = "list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c)"
    parts = []
    for n in range(5):
        parts.append(f"a{n} AS MATERIALIZED (SELECT vec_id, part, any_value(x) AS x, min({{'d': {gap}, 'k': k}}) AS best FROM p JOIN b{n} USING (part) GROUP BY vec_id, part)")
        if n < 4:
            parts.append(f"""m{n} AS (SELECT part, k, list(c ORDER BY pos) AS c FROM (SELECT part, best.k AS k, pos, floor(sum(x[pos]) / count(*)) AS c
  FROM (SELECT part, best, x, unnest(range(1, len(x) + 1)) AS pos FROM a{n}) GROUP BY part, best.k, pos) GROUP BY part, k)""")
            parts.append(f"b{n + 1} AS MATERIALIZED (SELECT part, k, coalesce(m{n}.c, b{n}.c) AS c FROM b{n} LEFT JOIN m{n} USING (part, k))")
    return f"""WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, list_slice(v, CAST(part * len(v) / 4 + 1 AS INT), CAST((part + 1) * len(v) / 4 AS INT)) AS x FROM e, (SELECT unnest(range(0, 4)) AS part)),
b0 AS MATERIALIZED (SELECT * FROM (SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS k, x AS c FROM p) WHERE k < 256),
{", ".join(parts)},
r AS (SELECT vec_id, string_agg(format('{{:02x}}', CAST(best.k AS INT)), '' ORDER BY part) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM a4 GROUP BY vec_id),
s AS (SELECT sha256(string_agg(CAST(CAST(c AS BIGINT) AS VARCHAR), ',' ORDER BY part, k, pos)) AS codebooks_sha256
  FROM (SELECT part, k, unnest(c) AS c, unnest(range(0, len(c))) AS pos FROM b4))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM r JOIN e USING (vec_id), s"""


OP11 = _op11()

_FAR = 1 << 40


def _least(*ways: str) -> str:
    return f"list_sort([{', '.join(ways)}])[1]"


def _after(state: str, letter: str, cost: str, when: str = "") -> str:
    """A state's cheapest way with one more edit, out of reach unless ``when``."""
    price = f"{state}.c + {cost}" if not when else f"CASE WHEN {when} THEN {state}.c + {cost} ELSE {_FAR} END"
    return f"{{'c': {price}, 'a': {state}.a || '{letter}'}}"


def _op12() -> str:
    """The grammar's states as columns n (none yet), s, u and a (the last role), each with
    its cheapest way: cost and letters; a recursion over the turns."""
    kept = lambda state, initial: _after(state, "K", "t", f"NOT gone AND i = '{initial}'")
    other = lambda state: _after(state, "R", "3 + t", "NOT gone")
    gone = lambda state: _after(state, "D", "4")
    to_u = [w for state in ("w.n", "w.s", "w.a") for w in (kept(state, "u"), other(state))]
    insert = lambda state: _after(state, "I", "3")
    step = "xor(v >> 1, CAST(3988292384 AS UBIGINT) * (v & 1))"
    return rf"""WITH RECURSIVE k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
h AS (SELECT *, xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS UBIGINT))),
  lambda a, b: list_reduce(list_concat([xor(a, b)], CAST(range(8) AS UBIGINT[])), lambda v, unused: {step})), CAST(4294967295 AS UBIGINT)) % 20 AS harm FROM k),
d AS (SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role END AS role,
  CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE WHEN harm = 3 THEN 2 ELSE 1 END)) AS copy FROM h WHERE harm <> 0),
f AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again,
  regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z', 1) NOT IN ('.', '!', '?') AS cut,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos FROM d),
g AS MATERIALIZED (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 3 ELSE 0 END AS t, substr(role, 1, 1) AS i FROM f),
w AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS done, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS n, {{'c': CAST({_FAR} AS BIGINT), 'a': ''}} AS s, {{'c': CAST(3 AS BIGINT), 'a': 'I'}} AS u, {{'c': CAST(6 AS BIGINT), 'a': 'II'}} AS a FROM g
  UNION ALL SELECT conv_id, done, n, s, {_least("u", insert("n"), insert("s"), insert("a"))} AS u, {_least("a", insert(_least("u", insert("n"), insert("s"), insert("a"))))} AS a FROM (
  SELECT w.conv_id, done + 1 AS done, {gone("w.n")} AS n, {_least(gone("w.s"), kept("w.n", "s"))} AS s, {_least(gone("w.u"), *to_u)} AS u, {_least(gone("w.a"), kept("w.u", "a"), other("w.u"))} AS a
  FROM w JOIN g ON w.conv_id IS NOT DISTINCT FROM g.conv_id AND g.pos = w.done + 1)),
best AS (SELECT conv_id, {_least("w.n", "w.a")} AS b FROM w WHERE done = (SELECT max(g.pos) FROM g WHERE g.conv_id IS NOT DISTINCT FROM w.conv_id)),
letter AS (SELECT conv_id, b.a AS audit, unnest(string_split(b.a, '')) AS letter, unnest(range(1, length(b.a) + 1)) AS j FROM best WHERE b.a <> ''),
placed AS (SELECT *, sum(CASE WHEN letter = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY j) AS pos FROM letter),
line AS (SELECT p.conv_id, j, letter, g.role, g.text, row_number() OVER (PARTITION BY p.conv_id ORDER BY j) AS o, first_value(letter = 'K' AND g.i = 's') OVER (PARTITION BY p.conv_id ORDER BY j) AS lead
  FROM placed p LEFT JOIN g ON p.conv_id IS NOT DISTINCT FROM g.conv_id AND p.pos = g.pos AND p.letter <> 'I' WHERE letter <> 'D'),
sha AS (SELECT conv_id, sha256(string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - CAST(lead AS INT)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j)) AS sha FROM line GROUP BY conv_id),
pair AS (SELECT conv_id, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) || i AS two FROM g),
bad AS (SELECT conv_id, count(*) AS illegal FROM pair WHERE two NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (NOT blank AND again) AS duplicate,
  count(*) FILTER (NOT gone AND cut) AS truncated FROM g GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN sums ON c.conv_id IS NOT DISTINCT FROM sums.conv_id LEFT JOIN bad ON c.conv_id IS NOT DISTINCT FROM bad.conv_id
  LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id LEFT JOIN sha ON c.conv_id IS NOT DISTINCT FROM sha.conv_id"""


OP12 = _op12()
