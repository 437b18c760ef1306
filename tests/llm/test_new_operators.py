"""Product codes, conversation repair and toxicity against plain versions."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import pytest

from partweave.llm import codes, queries, toxicity, turns

SF = "/root/testdata/sf0.001"


# --- vector codes ------------------------------------------------------------


def plain_codes(rows, scale=1024, parts=4, entries=256, rounds=4):
    """(id, code, error) by a full search with Python integers."""
    import math

    kept = sorted((r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])), key=lambda r: (r[0] is None, r[0], r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    whole = [[math.floor(scale * np.float64(x)) for x in v] + [0] * (-len(v) % parts) for _, v in kept]
    size = len(whole[0]) // parts
    cut = [[w[k * size : (k + 1) * size] for k in range(parts)] for w in whole]
    books = [[c[k] for c in cut[:entries]] for k in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for k in range(parts):
            held = [nearest(c[k], books[k])[1] for c in cut]
            books[k] = [[sum(col) // len(own) for col in zip(*own, strict=True)] if (own := [c[k] for c, h in zip(cut, held, strict=True) if h == e]) else b for e, b in enumerate(books[k])]
    found = [[nearest(c[k], books[k]) for k in range(parts)] for c in cut]
    return [(r[0], [i for _, i in f], sum(d for d, _ in f)) for r, f in zip(kept, found, strict=True)], books


def compressed(spark, rows, **options):
    df = spark.createDataFrame([(i, v, None, "x") for i, v in rows], "vec_id long, embedding array<double>, label int, id string")
    found, books = codes.compress(df, **options)
    return sorted((r["id"] is None, r["id"], r["code"], r["error"]) for r in found.collect()), books


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_codes_equal_a_full_search(spark, spread):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(5)]
    rows = [(k, [float(np.float32(c + rng.gauss(0, spread))) for c in rng.choice(centres)]) for k in range(120)]
    rows += [(7, rows[7][1]), (500, rows[3][1])]  # repeated row, repeated vector
    got, books = compressed(spark, rows, entries=16)
    want, plain = plain_codes(rows, entries=16)
    assert got == sorted((False, i, c, e) for i, c, e in want)
    assert [b.tolist() for b in books.books] == plain


def test_codes_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(3, [0.5, -0.25, 1.0]), (None, [0.5, 0.5, 0.5]), (1, [1e30, -3.0, 2.0]), (2, [3e38, 0.0, -3e38]), (4, None), (5, []), (6, [nan, 1.0, 1.0]), (7, [inf, 1.0, 1.0]), (8, [None, 1.0, 1.0]), (9, [1.0])]
    got, books = compressed(spark, rows, entries=2, rounds=2)
    want, plain = plain_codes(rows, entries=2, rounds=2)
    assert got == sorted((i is None, i, c, min(e, codes.LONG)) for i, c, e in want) and len(got) == 4
    assert [[[int(x) for x in e] for e in b] for b in books.books] == plain
    none, nothing = codes.compress(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert none.collect() == [] and nothing is None
    report = codes.code_report(spark.createDataFrame([], "vec_id long, embedding array<float>, label int"))
    assert report.collect() == []
    assert report.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_annuli_leave_out_most_entries_and_no_nearest_one():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (256, 16))
    rows = centres[rng.integers(0, 256, 3000)] + rng.integers(-60, 60, (3000, 16))
    tally = codes.Tally()
    index, best = codes.Annuli(centres).nearest(rows, tally)
    full = ((rows[:, None, :] - centres[None]) ** 2).sum(axis=2)
    assert (best == full.min(axis=1)).all() and (index == full.argmin(axis=1)).all()
    assert tally.looked < 0.3 * tally.all


def test_codes_decode_to_near_vectors(spark):
    rng = random.Random(5)
    rows = [(k, [rng.random() for _ in range(4)]) for k in range(40)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, label int")
    found, books = codes.compress(df)
    for r in found.collect():  # as many entries as vectors: only the grid is lost
        assert np.abs(np.array(books.decode(r["code"])) - rows[r["id"]][1]).max() <= 1 / 1024


# --- conversations -----------------------------------------------------------


def plain_repair(kinds):
    """Best-first search by cost, then audit."""
    then = {0: 2, 1: 2, 2: 3, 3: 2}
    heap, seen = [(0, "", 0, 0)], set()
    while True:
        cost, audit, at, state = heapq.heappop(heap)
        if (at, state) in seen:
            continue
        seen.add((at, state))
        if at == len(kinds) and state in (0, 3):
            return cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", at, then[state]))
        if at < len(kinds):
            initial, fault = kinds[at]
            cut = 3 * (fault == "t")
            heapq.heappush(heap, (cost + 4, audit + "D", at + 1, state))
            if fault != "x":
                keep = {"s0": 1, "u0": 2, "u1": 2, "u3": 2, "a2": 3}.get(f"{initial}{state}")
                if keep:
                    heapq.heappush(heap, (cost + cut, audit + "K", at + 1, keep))
                heapq.heappush(heap, (cost + 3 + cut, audit + "R", at + 1, then[state]))


def test_repair_equals_a_search_over_all_edits_and_segments_join():
    rng = random.Random(5)
    every = [a + b for a in "sua." for b in " tx"]
    for _ in range(250):
        kinds = [rng.choice(every) for _ in range(rng.randrange(14))]
        want = plain_repair(kinds)
        assert turns.repair(kinds)[:2] == want
        for size in (1, 2, 5):
            parts = [turns.routes(kinds[k : k + size]) for k in range(0, len(kinds), size)]
            assert turns.joined(parts)[:2] == want


def plain_conversations(rows):
    """The whole result by conversation, in Python."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = []
        for c, turn, role, text in rows:
            if c != conv:
                continue
            role, text = (" " if x is None else x for x in (role, text))
            harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if harm == 1 else "".join(x for x in text if x not in ".!?") if harm == 2 else text
            own += [(turn is not None, turn or 0, "user" if harm == 4 else role, text)] * (0 if harm == 0 else 2 if harm == 3 else 1)
        own.sort(key=lambda r: (r[0], r[1], r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        seen, kinds, faults = set(), [], []
        for _, _, role, text in own:
            words = text.strip(" \t\n\v\f\r")
            again, initial = (role, text) in seen, role[:1] if role[:1] in ("s", "u", "a") else "."
            seen.add((role, text))
            faults.append("b" if not words else "d" if again else "t" if words[-1] not in ".!?" else "")
            kinds.append(initial + {"b": "x", "d": "x", "t": "t", "": " "}[faults[-1]])
        dated = [r[1] for r in own if r[0]]
        cost, audit = plain_repair(kinds)
        lines, at, state = [], 0, 0
        for letter in audit:
            if letter == "D":
                at += 1
                continue
            role, text = ("assistant" if state == 2 else "user"), ""
            if letter != "I":
                role, text = (own[at][2] if letter == "K" else role), own[at][3]
                at += 1
            lines.append(f"{role}:{text}")
            state = 1 if role[:1] == "s" else 3 if role[:1] == "a" else 2
        initials = [k[0] for k in kinds]
        out[conv] = (
            max(dated) - min(dated) + 1 - len(set(dated)) if dated else 0, faults.count("b"), faults.count("d"), faults.count("t"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


CONVERSATION = "conv_id long, turn long, role string, text string, conv int, kind string, digest string, segment long"
ODD_TURNS = [
    (1, 0, "user", "Hi there."), (1, 0, "user", "Hi there."), (1, 0, "assistant", "Yes!"), (1, None, "system", "Be kind."), (1, None, None, None),
    (2, 4, "robot", "No."), (2, 5, "", "x"), (2, 900, "user", "éß。 \n"), (None, None, "user", "A."), (None, 3, "assistant", "B?"), (None, 3, "user", None),
    (3, 7, "user", " \t\n"), (4, -5, "assistant", "y" * 50_000), (4, -4, "user", "z. "),
]


@pytest.mark.parametrize("segment", [turns.SEGMENT, 3])
def test_conversations_equal_plain_ones(spark, monkeypatch, segment):
    monkeypatch.setattr(turns, "SEGMENT", segment)
    rng = random.Random(9)
    rows = list(ODD_TURNS)
    for conv in range(10, 40):
        for turn in range(rng.randrange(1, 9)):
            rows += [(conv, turn + (turn > 4) * 3, rng.choice(["user", "assistant", "system"]), rng.choice(["One.", "Two", "", f"Three {turn}!"]))] * rng.choice([1, 1, 1, 2])
    # A conversation with a third of all rows.
    rows += [(99, k, "user" if k % 2 else "assistant", f"t{rng.randrange(60)}{rng.choice('.!x')}") for k in range(len(rows) // 2)]
    df = spark.createDataFrame([(*r, 1, "k", "d", 2) for r in rows], CONVERSATION).repartition(3)
    got = {r["conv_id"]: tuple(r)[1:] for r in turns.repair_conversations(df).collect()}
    assert got == plain_conversations(rows)


def test_no_conversations(spark):
    got = turns.repair_conversations(spark.createDataFrame([], CONVERSATION))
    assert got.collect() == []
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_all_rows_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = turns.repair_conversations(spark.createDataFrame([(conv, 0, "user", "Hi.", 1, "k", "d", 2)], CONVERSATION)).collect()
    assert [tuple(r) for r in got] == [(conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


# --- toxicity ----------------------------------------------------------------


def test_sentences_and_words_equal_plain_ones():
    texts = ["One two. TWO\nthree!! ", None, "", "no end", "...", "İstanbul ÀÉ. x1y", "a" * 10]
    got = toxicity.bag(texts)
    plain = []
    for k, text in enumerate(texts):
        at = 0
        for piece in __import__("re").findall(r"[^.!?\n]*[.!?\n]|[^.!?\n]+", text or ""):
            if any(c.isalpha() for c in piece):
                plain.append((k, at, at + len(piece)))
            at += len(piece)
    assert list(zip(got.text.tolist(), got.start.tolist(), got.end.tolist(), strict=True)) == plain
    same = toxicity.bag(["two", "abcdefgh", "abcdef"])
    first = got.bucket[got.sentence == 0]
    assert same.bucket[0] in first and same.bucket[0] in got.bucket[got.sentence == 1]
    assert set(same.bucket[same.sentence == 2]) < set(same.bucket[same.sentence == 1])


def test_windows_split_no_sentence(monkeypatch):
    rng = random.Random(2)
    text = " ".join(f"w{'x' * rng.randrange(5)} {'y' * rng.randrange(1, 5)}{rng.choice(['', '.', '!'])}" for _ in range(300))
    whole = toxicity.bag([text])
    monkeypatch.setattr(toxicity, "CHUNK", 200)
    cut = toxicity.bag([text])
    assert (cut.start == whole.start).all() and (cut.end == whole.end).all()
    pairs = lambda b: sorted(zip(b.sentence.tolist(), b.bucket.tolist(), strict=True))
    assert pairs(cut) == pairs(whole)


def test_scores_are_the_noisy_or_of_sentences():
    model = toxicity.Model(np.zeros(1 << toxicity.BITS), -2.0)
    words = toxicity.bag(["bad one. bad two bad.", "", "fine"])
    for b, w in (("bad", 3.0), ("one", -1.0)):
        model.weights[toxicity.bag([b]).bucket] = w
    p = model.sentences(words)
    plain = [1 / (1 + np.exp(-z)) for z in (0.0, 1.0, -2.0)]
    assert np.allclose(p, plain)
    assert np.allclose(toxicity.noisy_or(p, words.text, 3), [1 - (1 - plain[0]) * (1 - plain[1]), 0, plain[2]])


@pytest.fixture(scope="module")
def made(spark):
    """Toxic documents hold one or two sentences with an insult (inflected at times); word
    by word they are like the others."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("bdfgklmnprst") + rng.choice("aeiou") for _ in range(rng.randrange(1, 4)))
    vocabulary = [word() for _ in range(400)]
    rows, spans = [], {}
    for d in range(900):
        sentences = [[rng.choice(vocabulary) for _ in range(rng.randrange(4, 12))] for _ in range(rng.randrange(3, 25))]
        bad = rng.sample(range(len(sentences)), rng.randrange(1, 3)) if d % 4 == 0 else []
        for k in bad:
            sentences[k].insert(1, rng.choice(["Zwixlo", "QUARFEX", "vlomp" + rng.choice(["", "er", "ish", "ot"])]))
        texts = [" ".join(s).capitalize() + rng.choice(".!?") for s in sentences]
        rows.append((d, " ".join(texts), int(bool(bad))))
        at = 0
        for k, t in enumerate(texts):
            if k in bad:
                spans.setdefault(d, set()).add(at)
            at += len(t)
            at += 1 if k else 1
    docs = spark.createDataFrame([(d, t, "en", "s", 1, 2) for d, t, _ in rows], "doc_id long, text string, lang string, source string, key int, toxic int")
    labels = spark.createDataFrame([(d, 0, y) for d, _, y in rows], "doc_id long, quality int, toxic int")
    return docs, labels, {d: y for d, _, y in rows}, spans


def test_held_out_toxic_documents_are_found_and_their_sentences_located(made):
    docs, labels, truth, spans = made
    got = toxicity.score_toxicity(docs, labels).collect()
    assert len(got) == len(truth)
    out = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in out) / len(out) >= 0.98
    assert all((r["score"] >= 0.7) == r["predicted"] and 0 <= r["score"] <= 1 for r in got)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = [(r["doc_id"], texts[r["doc_id"]][s["start"] : s["end"]].lower()) for r in out for s in r["offending"]]
    insulting = sum(any(x in t for x in ("zwixlo", "quarfex", "vlomp")) for _, t in found)
    assert insulting >= 0.95 * len(found) and insulting >= 0.9 * sum(len(spans.get(r["doc_id"], ())) for r in out)


def test_toxicity_on_odd_tables(spark, odd_docs, no_docs, made):
    docs, labels, _, _ = made
    none = toxicity.score_toxicity(no_docs, labels)
    assert none.columns == ["doc_id", "held_out", "score", "predicted", "offending"] and none.collect() == []
    marks = spark.createDataFrame([(1, 1), (1, None), (None, 1), (2, 0), (5, 0), (8, 1)], "doc_id long, toxic int")
    for own in (marks, marks.where("false"), marks.where("toxic = 1")):
        got = toxicity.score_toxicity(odd_docs, own).collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(r["doc_id"]) for r in odd_docs.collect())
        assert all(0 <= r["score"] <= 1 and (r["score"] == 0 or r["doc_id"] not in (3, 4, 6)) for r in got)


def test_labels_do_not_reach_a_score_except_by_training(made):
    """Held-out rows' labels change nothing."""
    from pyspark.sql import functions as F

    docs, labels, _, _ = made
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    scores = [{r["doc_id"]: r["score"] for r in toxicity.score_toxicity(docs, own).collect()} for own in (labels, turned)]
    assert scores[0] == scores[1]


def test_registered_queries_read_whole_tables(spark):
    got = queries.QUERIES["op13_toxicity"](spark, SF)
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
