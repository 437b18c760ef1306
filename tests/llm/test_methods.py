"""Methods against brute force, exact round trips and held-out accuracy."""

import io
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from partweave.llm import ann, hashing, jaccard, langid, oracles, packing, pieces, quality, queries, secrets, substring, warc, wrappers
from partweave.llm.components import components

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "conversations", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    ours = queries.QUERIES[name](spark, SF).toPandas()
    theirs = con.sql(queries.ORACLE[name]).df()
    flat = lambda df: df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).map(str).sort_values(sorted(df.columns)).values.tolist()
    number = lambda rows: [[v.removesuffix(".0") for v in r] for r in rows]
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert sorted(number(flat(ours))) == sorted(number(flat(theirs)))
    assert oracles.OP2


def brute_removed(docs, width=20):
    """n_removed by doc_id, from all windows."""
    seen, out = set(), {}
    for d, text in sorted(docs):
        words = (text or "").encode().split()
        gone = set()
        for i in range(len(words) - width + 1):
            w = tuple(words[i : i + width])
            if w in seen:
                gone.update(range(i, i + width))
            seen.add(w)
        out[d] = len(gone)
    return out


def test_hash_clashes_remove_nothing(spark):
    rng = random.Random(10)
    docs = [(d, " ".join(f"u{d}x{rng.randrange(10**6)}" for _ in range(80))) for d in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for bits in (1, 4):
        assert {r.n_removed for r in substring.dedup_substrings(df, hash_bits=bits).collect()} == {0}


@pytest.mark.parametrize("hot", [substring.HOT, 2])
def test_paths_compact_to_their_heads_and_branches_are_resolved(spark, monkeypatch, hot):
    """With a low limit most runs are hot and dealt by a salt."""
    monkeypatch.setattr(substring, "HOT", hot)
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(10**6)}"
    long_, short = [word() for _ in range(900)], [word() for _ in range(35)]
    docs = [(d, " ".join([word() for _ in range(rng.randrange(30))] + long_ + [word()])) for d in range(6)]
    docs += [(10 + d, " ".join([word() for _ in range(25)] + short[d : 30 + d % 6] + [word() for _ in range(9)] + long_[100 + d : 300])) for d in range(12)]
    docs += [(30, "a " * 70), (31, "a " * 45), (32, " ".join(long_[:19])), (33, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring.dedup_substrings(df).collect()} == brute_removed(docs)
    links = spark.createDataFrame([(k, k - 1 if k % 100 else None) for k in range(1000)], "g long, up long")
    assert {(r.g, r.head) for r in substring.path_heads(links).collect()} == {(k, k - k % 100) for k in range(1000)}


def test_word_hashes_do_not_depend_on_the_place():
    texts = ["a bb  ccc\n\tbb", None, "", "\x0bbb a b ccc", "x" * 3_000_000 + " bb", "é ééé bb"]
    w = hashing.Words(texts)
    spelled = [x for t in texts for x in (t or "").encode().split()]
    assert len(w) == len(spelled)
    seen = {}
    for word, h in zip(spelled, w.hash, strict=True):
        assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_trigram_queries_are_mandatory():
    samples = {"assign": ["Password: abcdefghijkl", "API_KEY='0123456789ab'", "apikey=aaaaaaaaaaaa"], "access": ["AKIA" + "A" * 14], "jwt": ["eyJ" + "a" * 9 + "." + "b" * 9 + "." + "c" * 9], "stripe": ["rk_live_" + "a" * 16], "url_login": ["ftp://me:pw@host"]}
    for rule in secrets.RULES:
        query = secrets.trigram_query(rule.regex)
        for s in samples.get(rule.kind, []):
            assert any(all(t in s.lower() for t in clause) for clause in query)
    assert secrets.trigram_query(secrets.BASE_RULES[2].regex) == []


def test_every_rule_finds_its_secret_and_redaction_covers_it(spark):
    found = {"private_key": "-----BEGIN RSA PRIVATE KEY-----", "github": "ghp_" + "a1B2" * 9, "slack": "xoxb-1234567890-abc", "jwt": "eyJhbGciOi12.eyJzdWIiOi12.abcdefgh_1", "stripe": "sk_live_" + "Z" * 20, "google": "AIza" + "x" * 35, "url_login": "https://user:hunter2@host"}
    text = "é start " + " / ".join(found.values()) + " end"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    spans = secrets.secret_report(df).first().spans.split(",")
    for kind, value in found.items():
        at = text.index(value)
        assert any(s.startswith(f"{kind}:{at}:") for s in spans), kind
    scanned = secrets.scan_secrets(df)
    out = scanned.select(secrets.redacted(F.col("text"), F.col("spans")).alias("t")).first().t
    assert all(v not in out for v in found.values()) and out.startswith("é start ") and out.endswith(" end")


def test_repeated_words_exactly():
    rng = random.Random(1)
    for n in (0, 7, 8, 9, 30, 200):
        ids = [rng.randrange(3) for _ in range(n)]
        count = Counter(tuple(ids[i : i + 8]) for i in range(n - 7))
        hit = set()
        for i in range(n - 7):
            if count[tuple(ids[i : i + 8])] > 1:
                hit.update(range(i, i + 8))
        assert quality.repeated_words(np.array(ids, dtype=np.int64)) == len(hit)


def test_depleted_documents_are_rejected(spark):
    boiler = "\n".join(f"shared footer line number {'abcdefgh'[k]} of the site with words" for k in range(4))
    rows = [(i, f"unique{i} " * 1 + " ".join(f"t{i}x{k}" for k in range(60)), "h") for i in range(30)]
    rows += [(100 + i, boiler + f"\nown{i} text{i} here{i}", "h") for i in range(30)]
    got = {r.doc_id: r for r in quality.quality_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[i].kept for i in range(30))
    assert all(got[100 + i].depleted and not got[100 + i].kept for i in range(30))


def test_pruning_keeps_what_reaches_the_threshold():
    least = jaccard.least_matches(0.8, 1e-6)
    rng = np.random.default_rng(1)
    lost = sum(any((rng.random(96) < 0.8)[: 8 * (k + 1)].sum() < m for k, m in enumerate(least)) for _ in range(3000))
    assert lost <= 3
    assert least[-1] > 50


def test_shared_counts_both_ways():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 400, 200).astype(np.uint64)) for _ in range(40)]
    i, j = np.triu_indices(40, 1)
    exact = np.array([len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j, strict=True)])
    assert (jaccard.shared(sets, sets, i, j) == exact).all()
    assert (jaccard.shared(sets, sets, i[:9], j[:9]) == exact[:9]).all()


def test_large_groups_split_into_blocks(spark):
    rng = random.Random(4)
    base = [f"b{k}" for k in range(120)]
    rows = []
    for d in range(40):
        own = list(base)
        own[rng.randrange(120)] = f"e{d}"
        rows.append((d, " ".join(own)))
    # About eight sets a block.
    got = jaccard.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string"), block_weight=8 * 180).collect()
    assert {r.class_id for r in got} == {0}
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(116)} for d, t in rows}
    for r in got:
        assert r.n_links == sum(len(sets[r.doc_id] & s) >= 0.8 * len(sets[r.doc_id] | s) for d, s in sets.items() if d != r.doc_id)


def test_both_ways_to_pair_agree():
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 16, jaccard.HASHES)
    sig = np.where(rng.random((60, jaccard.HASHES)) < 0.15, rng.integers(0, 1 << 16, (60, jaccard.HASHES)), base).astype(np.uint16)
    least = jaccard.least_matches(0.8, 1e-6)
    for left, right, same in ((sig, sig, True), (sig[:25], sig[25:], False)):
        dense = {(i, j) for a, b in jaccard.dense_pairs(left, right, same, least) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        bucket = set(zip(*(x.tolist() for x in jaccard.bucket_pairs(left, right, same, least, 1 << 40)), strict=True))
        bands = [x.reshape(len(x), jaccard.BANDS, jaccard.ROWS) for x in (left, right)]
        share = {(i, j) for i, j in dense if (bands[0][i] == bands[1][j]).all(axis=1).any()}
        assert bucket == share and share
        assert jaccard.bucket_pairs(left, right, same, least, 10) is None


def chain(n, width=60, step=4):
    """Documents that are near their neighbours only: windows of one long text."""
    return [(d, " ".join(f"c{k}" for k in range(d * step, d * step + width))) for d in range(n)]


def test_a_chain_is_compared_in_linear_time(spark):
    """Similarity of neighbours is 52/60; the closure of the chain is never compared."""
    least = jaccard.least_matches(0.8, 1e-6)
    shipped = {}
    for n in (500, 2000):
        docs = spark.createDataFrame(chain(n), "doc_id long, text string")
        rows = docs.select("doc_id", jaccard.row_key("doc_id", "text").alias("uid"), "text")
        signed = jaccard.arrow_pass(rows, lambda b: jaccard._signatures(b, 5), "doc_id long, uid binary, h1 long, h2 long, size int, signature binary")
        classes = signed.select(F.struct("doc_id", "uid").alias("head"), F.lit(1).alias("copies"), "size", "signature", F.col("doc_id").alias("node"))
        tasks = jaccard.meetings(jaccard.stored(classes, "classes"), jaccard.BLOCK_WEIGHT)
        sizes = tasks.groupBy("a", "b").count()
        shipped[n] = sizes.agg(F.sum("count"), F.sum(F.col("count") * F.col("count"))).first()
    assert all(shipped[2000][k] < 4.5 * shipped[500][k] for k in (0, 1))
    got = {r.doc_id: r for r in jaccard.jaccard_classes(spark.createDataFrame(chain(500), "doc_id long, text string")).collect()}
    assert {r.class_id for r in got.values()} == {0}
    assert [got[d].n_links for d in (0, 1, 250, 499)] == [1, 2, 2, 1]
    assert least


def test_a_bucket_of_many_homes_makes_rows_not_arrays(spark):
    """20,000 classes that share one band, and one with ten others each: every class meets
    every block of the large bucket once, as a row; no row or task grows with the bucket."""
    rng = np.random.default_rng(15)
    signatures = rng.integers(0, 1 << 16, (20_000, jaccard.HASHES), dtype=np.uint16)
    signatures[:, : jaccard.ROWS] = 7
    signatures[:, jaccard.ROWS : 2 * jaccard.ROWS] = (np.arange(20_000) // 10)[:, None].astype(np.uint16)
    rows = [(k, 400, x.tobytes()) for k, x in enumerate(signatures)]
    classes = spark.createDataFrame(pd.DataFrame(rows, columns=["node", "size", "signature"])).repartition(4)
    tasks = jaccard.meetings(classes, 1_000_000)
    assert tasks.dtypes == [("node", "bigint"), ("home", "bigint"), ("a", "bigint"), ("b", "bigint")]
    blocks = -(-20_000 * (400 + jaccard.SIGNATURE_WEIGHT) // 1_000_000)
    assert tasks.count() == 20_000 * blocks == tasks.distinct().count()
    assert tasks.groupBy("a", "b").count().agg(F.max("count")).first()[0] < 3 * 20_000 / blocks
    # No two are near: no task asks for a set.
    least = jaccard.least_matches(0.8, 1e-6)
    part = tasks.join(classes, "node").where("a = b").limit(4000).toPandas()
    assert len(jaccard._tasks(part, lambda s: jaccard._open(s, least), ["node", "home", "a", "b"])) == 0


def test_rows_have_keys_of_128_bits(spark):
    rows = [(1, "a"), (1, None), (None, "a"), (None, None), (1, ""), (11, "a"), (1, "1:+a"), (None, "+a"), (None, "-")]
    keys = [r["k"] for r in spark.createDataFrame(rows, "i long, t string").select(jaccard.row_key("i", "t").alias("k")).collect()]
    assert len(set(keys)) == len(rows) and {len(k) for k in keys} == {16}


def test_redaction_and_spans_do_not_depend_on_the_folds_length(spark, monkeypatch):
    """Overlapping, contained and touching spans against a plain loop, across chunk borders."""
    rng = random.Random(16)
    rows = []
    for k in range(100):
        text = "".join(rng.choice("abc\u00e9\U0001f600 x") for _ in range(rng.randrange(60)))
        starts = sorted(rng.randrange(len(text)) for _ in range(rng.randrange(14))) if text else []
        rows.append((k, text, [(a, 0, min(len(text), a + rng.randrange(1, 9))) for a in starts]))
    df = spark.createDataFrame(rows, "k int, t string, s array<struct<start:int,kind_no:int,end:int>>")
    hexes = [" ".join("".join(rng.choice("0123456789abcdef") for _ in range(rng.choice((8, 16, 40)))) for _ in range(rng.randrange(30))) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(hexes)), "doc_id long, text string")
    found = []
    for fold in (3, 512):
        monkeypatch.setattr(secrets, "FOLD", fold)
        got = {r.k: r.o for r in df.select("k", secrets.redacted(F.col("t"), F.col("s")).alias("o")).collect()}
        for k, text, spans in rows:
            at, out = 0, ""
            for a, _, b in spans:
                out += text[at:a] + "[SECRET]" if a >= at else ""
                at = max(at, b)
            assert got[k] == out + text[at:]
        found.append(sorted((r.id, r.spans) for r in secrets.scan_secrets(docs).collect()))
    assert found[0] == found[1]


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 360)]
    root = {}

    def find(v):
        while root.setdefault(v, v) != v:
            v = root[v]
        return v

    for a, b in edges:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {v: find(v) for e in edges if e[0] != e[1] for v in e}
    assert got == want


def test_recall_of_the_forest():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((8000, 64)).astype(np.float32)
    x *= rng.uniform(0.5, 2, (8000, 1)).astype(np.float32)
    forest = ann.Forest(x)
    hits = 0
    for q, (rows, scores) in enumerate(forest.search(x[:60], 20, 0.05)):
        best = set(np.argsort(-(x @ x[q]))[:20].tolist())
        hits += len(best & set(rows[np.argsort(-scores)[:20]].tolist()))
    assert hits / 1200 >= 0.9


def measured(x, queries):
    """(recall of the 20 nearest, share of the vectors looked at) of a forest over all rows."""
    forest, hits = ann.Forest(x), 0
    for q, (rows, scores) in zip(queries, forest.search(x[queries], 21, 0.05), strict=True):
        exact = (x @ x[q]).astype(np.float64)
        exact[q] = -np.inf
        best = [r for r in rows[np.argsort(-scores)] if r != q][:20]
        hits += len(set(np.argsort(-exact)[:20].tolist()) & set(best))
    return hits / (20 * len(queries)), forest.looked / forest.all


def test_the_forest_looks_at_a_part_of_the_vectors():
    """The share is printed; on clusters it is small, without any it is what recall takes."""
    rng = np.random.default_rng(5)
    table = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet").sort_values("vec_id")
    tables = np.stack(table["embedding"].to_numpy()).astype(np.float32)
    loose = rng.standard_normal((50_000, 64)).astype(np.float32)
    centres = rng.standard_normal((300, 64))
    tight = (centres[rng.integers(0, 300, 50_000)] + 0.5 * rng.standard_normal((50_000, 64))).astype(np.float32)
    for name, x, queries, most in (("sf0.1", tables, range(0, 2000, 20), 0.7), ("50,000 without clusters", loose, range(0, 50_000, 500), 0.7), ("50,000 in clusters", tight, range(0, 50_000, 500), 0.15)):
        recall, share = measured(x, np.array(queries))
        print(f"{name}: recall {recall:.3f}, share looked at {share:.3f}")
        assert recall >= 0.9 and share <= most, (name, recall, share)


def test_prefixes_and_ranges_equal_plain_ones():
    rng = np.random.default_rng(6)
    forest = ann.Forest(rng.standard_normal((400, 10)).astype(np.float32), trees=5, bits=24)
    codes = np.empty((400, 5), dtype=np.uint64)
    codes[forest.order.T, np.arange(5)] = forest.sorted.T
    text = [[format(int(c), "024b") for c in row] for row in codes]
    plain = lambda a, b: next((k for k in range(24) if a[k] != b[k]), 24)
    shared = ann._shared(codes[:20, None, :], codes[None, :50, :], 24)
    assert all(shared[i, j, t] == plain(text[i][t], text[j][t]) for i in range(20) for j in range(50) for t in range(5))
    for x in (1, 3, 24):
        low, high = forest._ranges(codes[:20], x, range(5))
        for i in range(20):
            for t in range(5):
                assert set(forest.order[t, low[t, i] : high[t, i]].tolist()) == {j for j in range(400) if text[j][t][:x] == text[i][t][:x]}


def test_shards_and_blocks_merge(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((300, 8)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=5, shard_rows=70, query_block=4).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    x64 = x.astype(np.float64)
    hits = 0
    for q in range(0, 300, 20):
        s = x64 @ x64[q]
        s[q] = -np.inf
        best = np.argsort(-s)[:5]
        assert len(got[q]) == 5 and [v for _, v in got[q]] == sorted((v for _, v in got[q]), reverse=True)
        assert all(v == pytest.approx(s[i], abs=1e-12) for i, v in got[q])
        hits += len(set(best.tolist()) & {i for i, _ in got[q]})
    assert hits / 75 >= 0.9


def test_shards_are_ruled_out_by_their_bound_and_scores_are_the_originals(spark):
    """Clusters far apart: a query visits few shards and still finds what brute force finds.
    Vectors of doubles are scored as doubles."""
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((6, 12)) * 50
    x = np.concatenate([c + rng.standard_normal((80, 12)) for c in centres])
    rng.shuffle(x)
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=5, shard_rows=60).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 480, 20):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        assert len(got[q]) == 5 and all(v == pytest.approx(s[i], rel=1e-14) for i, v in got[q])
        hits += len(set(np.argsort(-s)[:5].tolist()) & {i for i, _ in got[q]})
    assert hits / 120 >= 0.95
    directory = {12: (np.arange(6), centres, np.full(6, 8.0))}
    asks = pd.DataFrame({"row": [0], "vec_id": [0], "vector": [centres[2]], "kth": [None]})
    home = pd.concat(ann._visits(directory, True)(iter([asks])))
    assert home["shard"].tolist() == [int((centres @ centres[2]).argmax())]
    more = pd.concat(ann._visits(directory, False)(iter([asks.assign(kth=float(centres[2] @ centres[2]))])))
    assert len(more) < 5


def test_rows_that_share_an_id_are_candidates_of_each_other(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.9, 0.1]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [1e300, 1e300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r.query_id, r.vec_id) for r in ann.nearest(df, F.col("vec_id") % 20 == 0, k=5).collect()]
    assert sorted(got) == sorted([(0, 0), (0, 1), (0, 2)] * 2)


def test_language_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang_pred <> 'und'")
    assert got.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.95


def test_the_sample_is_bounded_and_holds_every_language_once_a_text(spark):
    rows = [(i, "der gleiche deutsche Text steht immer wieder da", "de") for i in range(3000)]
    rows += [(5000 + i, f"english text number {'abcdefghij'[i % 10]} {'klmnop'[i % 6]}", "en") for i in range(300)]
    rows += [(9000 + i, "un seul texte fran\u00e7ais", "fr") for i in range(3)]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string").select(F.xxhash64("text").alias("key"), "lang", "text")
    for most in (6, 40):
        got = [(r.lang, r.key) for r in langid.sample(train, most).collect()]
        assert len(got) == len(set(got)) <= most
        assert Counter(lang for lang, _ in got) == {"de": 1, "fr": 1, "en": min(30, most // 3)}
    languages, *_ = langid.fit(train, 40)
    assert languages == ["de", "en", "fr"]


def test_document_frequencies_and_predictions_from_given_weights(spark):
    texts = ["ab ab", "abc", None, "b1b", "1 2", "", "\u00e9a"]
    train = spark.createDataFrame([(k, "xx" if k % 2 else "yy", t) for k, t in enumerate(texts) if t is not None], "key long, lang string, text string").repartition(3)
    _, idf, _, _ = langid.fit(train)

    def grams(text):
        letters = re.sub(r"[^a-z\u00e9]+", " ", text)
        return {letters[i : i + n] for n in langid.ORDERS for i in range(len(letters) - n + 1)}

    with_letters = [t for t in texts if t and re.search(r"[a-z\u00e9]", t)]
    df = Counter(g for t in with_letters for g in grams(t))
    for text in with_letters:
        counts = langid.ngram_counts(text)
        want = sorted(np.log((1 + len(with_letters)) / (1 + df[g])) + 1 for g in grams(text))
        assert np.allclose(sorted(idf[counts > 0]), want)
    rng = np.random.default_rng(1)
    weights = rng.standard_normal((langid.BUCKETS, 3))
    run = langid._predictions(["p", "q", "r"], idf, weights, 2.0, with_text=False)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], ["doc_id", "text"])
    got = [r for b in run(iter([batch])) for r in b.to_pylist()]
    for text, r in zip(texts, got, strict=True):
        counts = langid.ngram_counts(text)
        if counts is None:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        value = np.array([(1 + np.log(c)) * i if c else 0.0 for c, i in zip(counts, idf, strict=True)])
        logits = value / np.sqrt((value**2).sum()) @ weights / 2.0
        p = np.exp(logits) / np.exp(logits).sum()
        assert r["lang_pred"] == "pqr"[p.argmax()] and r["score"] == pytest.approx(p.max())


def test_ftrl_is_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(5)
    rows = []
    for _ in range(400):
        y = int(rng.integers(0, 2))
        at = np.sort(rng.choice(200, 20, replace=False)) + (200 if y else 0)
        rows.append((y, at.astype(np.int32), np.full(20, 0.2)))
    w = langid.ftrl(rows, 2, l1=0.3)
    assert (w == 0).mean() > 0.9
    assert np.mean([np.argmax(v @ w[a]) == y for y, a, v in rows]) > 0.95
    logits = rng.normal(size=(4000, 3))
    p = np.exp(logits) / np.exp(logits).sum(axis=1, keepdims=True)
    labels = np.array([rng.choice(3, p=r) for r in p])
    assert langid.temperature(logits * 4, labels) == pytest.approx(4, rel=0.25)


def test_packing_is_near_the_bound_and_exact(spark, documents):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack_documents(documents, path, shard_size=64).toPandas()
    bound = -(-got.length.sum() // 2048)
    assert got.sequence_id.nunique() <= 1.03 * bound + 1
    assert packing.pack_documents(documents, path).select("sequence_id").distinct().count() <= bound + 1
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(path)
    want = {}
    for r in documents.collect():
        ids = np.array([*plain.encode(r.text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want[r.doc_id, piece] = (at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes()))
    assert want == {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()}


def watched_levels(monkeypatch, shard_size):
    """Lists the sizes of all shards of each level that a packing deals."""
    levels = []
    level = packing.pack_level

    def watched(items, count, size, capacity):
        placed, shards = level(items, count, size, capacity)
        levels.append([r["count"] for r in placed.groupBy("shard").count().collect()])
        assert size == shard_size
        return placed, shards

    monkeypatch.setattr(packing, "pack_level", watched)
    return levels


def test_pieces_that_do_not_combine_stay_in_bounded_shards(spark, monkeypatch):
    levels = watched_levels(monkeypatch, 32)
    # 300 copies of 1200 ids, and a few documents that fit beside them.
    docs = [(i, "a " * 1199) for i in range(300)] + [(1000 + i, "a " * 839) for i in range(40)]
    got = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), shard_size=32).toPandas()
    assert max(map(max, levels)) <= 32 and len(levels) < 6
    assert sorted(got.doc_id) == [d for d, _ in docs]
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert got.sequence_id.nunique() <= 305


def test_no_shard_passes_its_bound_and_sequence_ids_are_exact(spark, monkeypatch):
    levels = watched_levels(monkeypatch, 32)
    rng = random.Random(8)
    docs = [(i, "a " * rng.randrange(1099, 1900)) for i in range(600)] + [(1000 + i, "a " * 2047) for i in range(3)]
    got = packing.pack_documents(spark.createDataFrame(docs, "doc_id long, text string"), public_tokenizers.path("word_bpe_49k.json"), shard_size=32).toPandas()
    assert max(map(max, levels)) <= 32 and len(levels) < 6
    assert got.sequence_id.nunique() == 603 == len(got)
    # Even numbers for full pieces, odd ones for bins.
    assert set(got[got.length == 2048].sequence_id % 2) == {0} and set(got[got.length < 2048].sequence_id % 2) == {1}


def test_crossover_keeps_every_piece_once():
    rng = random.Random(6)
    lengths = [rng.randrange(1, 2048) for _ in range(300)]
    parents = []
    for _ in range(2):
        loose = list(range(300))
        rng.shuffle(loose)
        parents.append(packing.best_fit(lengths, packing.Packing([], []), loose, 2048))
    tally = packing.Tally()
    pool = packing.evolve(lengths, parents, 2048, 1, tally)
    for child in (packing.crossover(lengths, *parents, 2048, rng), *pool):
        assert sorted(i for b in child.bins for i in b) == list(range(300))
        assert child.fills == [sum(lengths[i] for i in b) for b in child.bins] and max(child.fills) <= 2048
    # The result is the algorithm's: children replaced the random individuals and beat them.
    assert tally.crossovers >= 5 and tally.accepted >= 3
    assert len(pool[0].bins) < min(len(p.bins) for p in parents)


def test_evolution_finds_the_optimum_of_small_sets():
    def optimum(lengths, capacity):
        best = [len(lengths)]

        def put(k, fills):
            if len(fills) >= best[0]:
                return
            if k == len(lengths):
                best[0] = len(fills)
                return
            for i, f in enumerate(fills):
                if f + lengths[k] <= capacity and f not in fills[:i]:
                    put(k + 1, [*fills[:i], f + lengths[k], *fills[i + 1 :]])
            put(k + 1, [*fills, lengths[k]])

        put(0, [])
        return best[0]

    rng = random.Random(12)
    for n in (1, 2, 5, 8, 10):
        for _ in range(12):
            lengths = [rng.randrange(1, 61) for _ in range(n)]
            assert len(packing.evolve(lengths, [], 100, rng.randrange(1 << 30))[0].bins) == optimum(sorted(lengths, reverse=True), 100)


def test_an_island_goes_on_from_its_population_and_the_elites_that_came(monkeypatch):
    pools = []
    evolve = packing.evolve
    monkeypatch.setattr(packing, "evolve", lambda lengths, pool, *rest: pools.append(pool) or evolve(lengths, pool, *rest))
    rng = random.Random(3)
    lengths = np.array([rng.randrange(700, 1300) for _ in range(60)], dtype=np.int32)
    frame = pd.DataFrame({"shard": 0, "island": 0, "kind": [0], "body": [lengths.tobytes()]})
    first = packing._epoch(2048, 0)(frame)
    assert len(first) == packing.POPULATION and pools == [[]]
    packing._epoch(2048, 1)(pd.concat([frame, pd.DataFrame({"shard": 0, "island": 0, "kind": 1, "body": [*first.body, *first.body[: packing.ELITES]]})]))
    assert len(pools[1]) == packing.POPULATION + packing.ELITES
    assert sorted(len(p.bins) for p in pools[1])[-packing.POPULATION :] and min(len(p.bins) for p in pools[1]) == first.bins.min()


def test_word_ids_equal_the_librarys():
    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["I'm THEY'LL x'se", "İstanbul ΑΣ ΑΣΑ ß ﬁ é", "日本語 한국어 ½ ²", "<|endoftext|>x", "a b\x1cc", "_a-b 12ab #$%", "", None]
    for text, ids in zip(odd, e(odd), strict=True):
        assert ids[:-1].tolist() == e.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_ascii_control_characters_keep_their_ids():
    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    texts = [t for c in map(chr, range(128)) for t in (c, f"a{c}b", f"!{c}!", f"1{c}'s", f"a{c * 3}b c")]
    for text, ids in zip(texts, e(texts), strict=True):
        assert ids[:-1].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_words_are_looked_up_once_a_batch():
    class Counted(packing.Places):
        asked = 0

        def __getitem__(self, key):
            self.asked += 1
            return super().__getitem__(key)

    e = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    e.place = Counted()
    texts = ["the cat  sat " * 100, None, " \t", "sat the\x0bcat"] * 10
    found = e(pa.array(["cut off", *texts]).slice(1))
    assert e.place.asked <= 4
    for text, ids in zip(texts, found, strict=True):
        assert ids.tolist() == [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, packing.END_ID]


@pytest.fixture(scope="module")
def piece_model():
    return pieces.Pieces(public_tokenizers.path("piece_bpe_32k.model"))


def test_viterbi_against_all_splits(piece_model, documents):
    known = {}
    for i, t in enumerate(piece_model.text):
        if t and not (piece_model.bytes == i).any():
            known[t.decode().replace(" ", pieces.MARKER)] = i

    def brute(text):
        best = [(0.0, ())] + [(-np.inf, ())] * len(text)
        for end in range(1, len(text) + 1):
            for start in range(max(0, end - piece_model.longest), end):
                part = text[start:end]
                if part in known:
                    step, ids = piece_model.score[known[part]], (known[part],)
                elif end - start == 1:
                    raw = part.encode()
                    step, ids = piece_model.byte_score * len(raw), tuple(int(piece_model.bytes[b]) for b in raw)
                else:
                    continue
                if best[start][0] + step > best[end][0]:
                    best[end] = (best[start][0] + step, best[start][1] + ids)
        return list(best[-1][1])

    texts = [r.text for r in documents.collect() if r.text] + ["a  b   c", "日本 \U0001f600x\n\ty", "  ", "\x00é", " lead"]
    for text, ids in zip(texts, piece_model.encode(texts), strict=True):
        assert ids.tolist() == brute(pieces.MARKER + text.replace(" ", pieces.MARKER))
        assert piece_model.decode(ids) == text


def test_unbroken_text_is_cut_in_windows_without_a_trace(piece_model):
    rng = random.Random(2)
    units = ["".join(rng.choice("日本語中国人大学生我的是不了在有abcdefgh the\U0001f600é".replace(" ", "")) for _ in range(2500)), "xy" * 1500, pieces.MARKER * 700, "a" * 900]
    for unit, want in zip(units, piece_model._viterbi(units), strict=True):
        for window in (1, 7, 100, 1 << 16):
            assert piece_model.encode_long(unit, window).tolist() == want.tolist()
    text = "".join(rng.choice("日本語中国人大学生我的是不了在有") for _ in range(1_000_000))
    ids = piece_model.encode([text])[0]
    assert piece_model.decode(ids) == text
    assert all(len(u) <= pieces.CACHE_UNIT for u in piece_model.known)


def test_decoding_in_spark(spark, documents):
    path = public_tokenizers.path("piece_bpe_32k.model")
    coded = pieces.encode_documents(documents, path, with_ids=True)
    assert coded.where("NOT round_trip").count() == 0
    back = pieces.decode_documents(coded, path).join(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("t")), "doc_id")
    assert back.where("text <> t").count() == 0


def test_archives_are_gzip_members_and_damage_is_found(spark, tmp_path):
    import gzip

    df = spark.createDataFrame([(1, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (3, "http://a/3", "y" * 20_000_000)], "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"))
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "w").glob("part-*")))
    assert gzip.decompress(data).count(b"WARC/1.1\r\n") == 3 == len(list(warc.members(io.BytesIO(data))))
    assert gzip.decompress(data).count(b"WARC-Date: ") == 3
    got = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "w"), with_payload=True).collect()}
    assert bytes(got[1].payload) == "<p>é</p>".encode() and got[2].payload is None and got[2].refers_to == 1 and got[3].payload_bytes == 20_000_000
    record = warc.record_bytes(1, 5, "u", b"payload", None, "2020-01-01T00:00:00Z")
    assert warc.parse_record(record)[-1] == b"payload"
    for broken in (record.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"), record[:-5], record.replace(b"WARC/1.1", b"XARC/1.1")):
        with pytest.raises(warc.WarcError):
            warc.parse_record(broken)
    with pytest.raises(warc.WarcError):
        list(warc.members(io.BytesIO(warc.member(record)[:-9])))


def test_archives_are_bounded_and_long_ones_are_read_in_pieces(spark, tmp_path):
    rows = [(i, f"http://a/{i}", random.Random(i).randbytes(2000).hex()) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"), archive_bytes=8000, date="2020-01-01T00:00:00Z")
    parts = sorted((tmp_path / "w").glob("part-*"))
    assert len(parts) > 10 and max(p.stat().st_size for p in parts) <= 8000
    # One archive of all members, longer than what travels whole.
    (tmp_path / "long").mkdir()
    (tmp_path / "long" / "all.warc.gz").write_bytes(b"".join(p.read_bytes() for p in parts))
    reads = [warc.read_archives(spark, str(tmp_path / d), with_payload=True, whole_bytes=n).collect() for d, n in (("w", 1 << 20), ("long", 8000))]
    for got in reads:
        assert {(r.page_id, bytes(r.payload).decode()) for r in got} == {(i, t) for i, _, t in rows}
        assert len({r.record_id for r in got}) == 60


def test_the_reader_holds_a_step_and_a_record():
    class Source:
        def __init__(self, data):
            self.data, self.at, self.most = data, 0, 0

        def read(self, n):
            self.most = max(self.most, n)
            part = self.data[self.at : self.at + n]
            self.at += len(part)
            return part

    data = b"".join(warc.member(warc.record_bytes(i, i, "u", random.Random(i).randbytes(50_000), None, "d")) for i in range(40))
    source, ahead = Source(data), 0
    for k, record in enumerate(warc.members(source)):
        assert warc.parse_record(record)[1] == k
        ahead = max(ahead, source.at - (k + 1) * 50_000)
    assert source.most <= warc.FEED and ahead < 2 * warc.FEED and k == 39


def test_record_ids_are_unique_and_dangling_revisits_are_found(spark, tmp_path):
    rows = [(1, "u", "same"), (1, "u", "same"), (2, "u", "same"), (None, "u", "same"), (None, "v", "alone"), (None, "v", "alone")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"))
    got = warc.read_archives(spark, str(tmp_path / "w"))
    assert got.select("record_id").distinct().count() == 6
    assert sorted((str(r.page_id), r.record_type) for r in got.collect()) == sorted([("1", "response")] * 2 + [("2", "revisit"), ("None", "revisit"), ("None", "response"), ("None", "response")])
    assert warc.dangling_revisits(got).count() == 0
    assert warc.dangling_revisits(got.where("page_id IS NULL OR page_id = 2")).count() == 1


PAGE = """<html><head><title>T</title><script>var a="</p><p>";</script></head><body><header>Site</header><nav><ul><li><a href="/">Home</a></li><li><a href="/x">X</a></li></ul></nav>
<div class="sidebar">Side</div><div class="cookie-notice">We use cookies</div><article><h1>Title &amp; more</h1><p>First <b>bold</b>text<br>after&nbsp;break.</p><div class="ad">Buy</div><p>Second {n}</p><form>Mail</form>
<ul><li>One<li>Two</ul></article><section id="comments"><p>Nice!</p></section><footer>&copy; Site</footer></body></html>"""


def test_extraction_of_an_article(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.replace("{n}", str(i))) for i in range(5)]
    rows += [(10, "http://g.example/a", "<body><div class='menu'>M</div><main><p>Main text</p></main><aside>no</aside></body>")]
    rows += [(20 + i, f"http://plain.example/{i}", f"<body><div>Same header line</div><div><p>Text of page {i} goes on</p></div><p><a href='/'>only link</a></p></body>") for i in range(4)]
    got = {r.page_id: r.text for r in wrappers.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3] == "Title & more First boldtext after break. Second 3 One Two"
    assert got[10] == "Main text"
    assert got[21] == "Text of page 1 goes on"


def test_layout_classes_teasers_and_copies_do_not_drop_articles(spark):
    body = "<p>The whole article has many words that must stay.</p><p>And a second part of it.</p>"
    text = "The whole article has many words that must stay. And a second part of it."
    pages = {
        f"<body class='has-sidebar'>{body}</body>": text,
        f"<body class='no-comments single-post'><div class='sidebar'>Side</div>{body}</body>": text,
        f"<body><div class='content with-sidebar'>{body}<div class='sidebar'>Side</div></div></body>": text,
        f"<body><article class='post social'>{body}<div class='social'>Share</div></article></body>": text,
        f"<body><form id='aspnetForm'><div class='widget'>{body}</div><div class='menu'>Menu</div></form></body>": text,
        f"<body><main><h1>Title</h1><article>Teaser</article><div>{body}</div></main></body>": f"Title Teaser {text}",
        f"<body><div class='ad'/>{body}<a name='x'/></body>": text,
        f"<body><article>{body}</article><div class='comments'>{'<p>Some comment on it.</p>' * 30}</div></body>": text,
        f"<body>{body}<div class='comments'><p>Nice</p></div><form>Mail</form></body>": text,
    }
    rows = [(k, f"http://h{k}.example/", html) for k, html in enumerate(pages)]
    rows += [(100 + k, f"http://copies.example/{k}", f"<body><div>{body}</div></body>") for k in range(4)]
    got = {r.page_id: r.text for r in wrappers.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(pages.values())) | {100 + k: text for k in range(4)}


def items(*tokens):
    """Items of a stream of (path, text) pairs."""
    return [wrappers.Item(core, repeated, low=wrappers._hash(t), high=wrappers._hash(t)) for core, repeated, a, b in wrappers.runs([p for p, _ in tokens]) for t in ["|".join(x for _, x in tokens[a:b])]]


def test_wrappers_resolve_mismatches():
    assert wrappers.runs(["h", "p", "p", "p", "f"]) == [("h", False, 0, 1), ("p", True, 1, 4), ("f", False, 4, 5)]
    assert wrappers.runs(["x", "a", "b", "a", "b", "y"]) == [("x", False, 0, 1), ("a b", True, 1, 5), ("y", False, 5, 6)]
    one = items(("h", "H"), ("p", "1"), ("p", "2"), ("f", "F"))
    two = items(("h", "H"), ("p", "3"), ("f", "F"))
    assert wrappers.expression(wrappers.align(one, two)) == "h (p#)+ f"
    three = items(("h", "H"), ("q", "Q"), ("p", "1"))
    assert wrappers.expression(wrappers.align(wrappers.align(one, two), three)) == "h (q)? (p#)+ (f)?"
    assert wrappers.expression(wrappers.align(items(("p", "1"), ("f", "F")), items(("f", "F"), ("p", "2")))) in ("(p)? f (p)?", "(f)? p# (f)?")


def test_a_merge_tree_gives_what_one_alignment_gives(spark):
    rng = random.Random(13)
    rows = []
    for i in range(90):
        extra = "".join(f"<div class='x{c}'>box {rng.random()}</div>" for c in "abcdefg" if rng.random() < 0.5)
        rows.append((i, f"http://deep.example/{i}", f"<body><div class='top'>Site</div>{extra}<div class='txt'><p>Text {i} {rng.random()}</p></div></body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    kept = lambda w: sorted((i.core, i.low == i.high, i.pages, i.chars) for i in w[0]["items"])
    flat, deep = (wrappers.infer_wrappers(df, fan=fan).expressions.collect() for fan in (1000, 4))
    assert len(flat) == len(deep) == 1 and flat[0].pages == deep[0].pages == 90
    for got in (flat, deep):
        by_core = {c: (constant, n) for c, constant, n, _ in kept(got)}
        assert by_core["body/div.top"] == (True, 90) and by_core["body/div.txt/p"] == (False, 90)


def test_an_expression_keeps_the_items_of_most_pages_and_the_rest_beside():
    own = [wrappers.Item(c, pages=n) for c, n in zip("abcde", (1, 9, 2, 9, 3), strict=True)]
    kept, rest = wrappers._parted(own, 3)
    assert [i.core for i in kept] == ["b", "d", "e"] and [i.core for i in rest] == ["a", "c"] and wrappers._parted(own[:3], 3) == (own[:3], [])
    # What no item matches is decided by the rest, else it is text.
    assert wrappers.matched(["b"], wrappers.runs(["b", "x"])) == [0, -1]
    found = [("b", "one", 0, 3), ("x", "two", 3, 3), ("y", "three", 0, 3)]
    assert wrappers.page_text(found, ["b"], [wrappers.TEXT], "", {"x": wrappers.LINKS}) == (["one", "three"], True)


def test_repeated_groups_of_any_length():
    """Against a plain search of every size and place."""

    def plain(tokens):
        now = [(t, False) for t in tokens]
        size = 1
        while size <= len(now) // 2:
            cores, out, at = [c for c, _ in now], [], 0
            while at < len(now):
                n = 1
                while cores[at + n * size : at + (n + 1) * size] == cores[at : at + size] and at + (n + 1) * size <= len(cores):
                    n += 1
                out.append((" ".join(cores[at : at + size]), True) if n > 1 else now[at])
                at += n * size if n > 1 else 1
            now, size = out, size + 1
        return now

    rng = random.Random(21)
    for _ in range(300):
        group = [rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(1, 15))]
        tokens = [rng.choice("xyz") for _ in range(rng.randrange(4))] + group * rng.randrange(1, 4) + [rng.choice("xyab") for _ in range(rng.randrange(6))]
        got = wrappers.runs(tokens)
        assert [(c, r) for c, r, _, _ in got] == plain(tokens)
        assert [at for _, _, at, _ in got] == [0, *(end for _, _, _, end in got[:-1])][: len(got)] and (not got or got[-1][3] == len(tokens))
    long_group = [f"t{k}" for k in range(40)]
    assert [r for _, r, _, _ in wrappers.runs(["h", *long_group, *long_group, "f"])] == [False, True, False]


def brute_wrapper(pages):
    """Of a small host by counting tokens, without alignment: cores that are constant on
    three and half of the distinct pages, cores that are mostly links, and the deepest
    layout path with most letters of the others."""
    found = [wrappers.blocks(h) for h in dict.fromkeys(pages)]
    texts, letters, links = defaultdict(set), Counter(), Counter()
    on = Counter()
    for page in found:
        for core, _, first, end in wrappers.runs([b[0] for b in page]):
            own = page[first:end]
            texts[core].add("\0".join(b[1] for b in own))
            letters[core] += sum(len(b[1]) for b in own)
            links[core] += sum(b[2] for b in own)
        on.update({core for core, *_ in wrappers.runs([b[0] for b in page])})
    template = {c for c in texts if len(texts[c]) == 1 and on[c] >= 3 and 2 * on[c] >= len(found)}
    linked = {c for c in texts if c not in template and 2 * links[c] > letters[c]}
    mass = Counter()
    for core in texts:
        if len(texts[core]) > 1 and 2 * links[core] <= letters[core]:
            for one in core.split(" "):
                parts = one.split("/")
                mass.update({"/".join(parts[:k]): letters[core] // len(core.split(" ")) for k in range(1, len(parts) + 1)})
    return template, linked, wrappers.deepest(mass)


@pytest.mark.parametrize("most_items", [wrappers.MOST_ITEMS, 4])
def test_wrappers_of_small_hosts_equal_brute_force(spark, most_items):
    """Tokens that stand once on a page, in a fixed order, so that counting them is exact;
    with four items an expression the rest comes from the table beside it."""
    rng = random.Random(22)
    rows, hosts = [], {}
    for host in range(6):
        boxes = [f"box{chr(97 + k)}" for k in range(rng.randrange(5, 9))]
        fixed = {b: rng.random() < 0.4 for b in boxes}
        linked = {b: rng.random() < 0.3 for b in boxes}
        for page in range(rng.randrange(3, 12)):
            html = "<body>"
            for b in boxes:
                if rng.random() < 0.85:
                    text = f"Same words of {b}" if fixed[b] else f"Words {rng.random()} of page {page} in {b}"
                    html += f"<div class='{b}'>" + (f"<a href='/'>{text}</a>" if linked[b] else text) + "</div>"
            html += f"<div class='inner'><div class='most'>{' '.join(str(rng.random()) for _ in range(30))}</div></div></body>"
            rows.append((len(rows), f"http://s{host}.example/{page}", html))
            hosts.setdefault(f"s{host}.example", []).append(html)
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = wrappers.infer_wrappers(df, fan=3, most_items=most_items)
    elements = {r["host"]: r["element"] for r in wrappers.content_elements(found).collect()}
    rest = {} if found.rest is None else {(r["host"], r["core"]): r for r in found.rest.collect()}
    assert bool(rest) == (most_items == 4)
    for r in found.expressions.collect():
        template, linked, element = brute_wrapper(hosts[r["host"]])
        assert elements[r["host"]] == element and element.endswith("div.inner/div.most")
        own = [wrappers.Item(**i.asDict()) for i in r["items"]]
        verdicts = {i.core: v for i, v in zip(own, wrappers.marks(own, r["pages"]), strict=True)}
        if most_items != 4:
            assert {c for c, v in verdicts.items() if v == wrappers.TEMPLATE} == template
            assert {c for c, v in verdicts.items() if v == wrappers.LINKS} == linked
        # Nothing is lost: pages and letters of both together are those of the host.
        chars = sum(i.chars for i in own) + sum(x["chars"] for (h, _), x in rest.items() if h == r["host"])
        assert chars == sum(len(b[1]) for html in dict.fromkeys(hosts[r["host"]]) for b in wrappers.blocks(html))
    want = {r["page_id"]: r["text"] for r in wrappers.extract_articles(df).collect()}
    got = {r["page_id"]: r["text"] for r in wrappers.extract_articles(df, fan=3, most_items=most_items).collect()}
    assert got == want and len({t for t in got.values()}) == len(rows)


def test_on_the_tables_the_wrapper_decides_most_pages(spark):
    """And does so without tags, roles or class words."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = wrappers.infer_wrappers(pages)
    elements = {r["host"]: r["element"] for r in wrappers.content_elements(found).collect()}
    known = {r["host"]: ([wrappers.Item(**i.asDict()) for i in r["items"]], r["pages"]) for r in found.expressions.collect()}
    got = {r["page_id"]: r for r in wrappers.extract_articles(pages).collect()}
    by_wrapper = same = 0
    for r in pages.withColumn("host", wrappers.host_of(F.col("url"))).collect():
        own, n = known[r["host"]]
        if not got[r["page_id"]]["by_wrapper"]:
            continue
        by_wrapper += 1
        plain = [(path, text, links, 3) for path, text, links, _ in wrappers.blocks(r["html"])]  # no block is known as furniture
        texts, decided = wrappers.page_text(plain, [i.core for i in own], wrappers.marks(own, n), elements.get(r["host"], ""))
        same += decided and " ".join(texts) == got[r["page_id"]]["text"]
    assert by_wrapper >= 0.8 * len(got) and same >= 0.95 * by_wrapper


def scrambled(html, seed):
    """The same page with other class names."""
    name = lambda old: "".join(random.Random(f"{seed}/{old}").choices("qzxkvj", k=6))
    return re.sub(r"class='([^']*)'", lambda m: f"class='{name(m[1])}'", html)


def test_the_wrapper_decides_without_class_names(spark):
    """A host without semantic elements: constants are template, links are menus, and the
    content is where the slots' letters are, whatever the classes are called."""
    rng = random.Random(14)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    pages, want = [], {}
    for i in range(12):
        body = [prose(30) for _ in range(rng.randrange(2, 6))]
        title, teaser = prose(5), prose(6)
        menu = "".join(f"<li><a href='/{k}'>{prose(1)}</a></li>" for k in range(rng.randrange(3, 6)))
        note = f"<div class='notice'>{'We use small files to keep settings.'}</div>" if i % 3 else ""
        pages.append(
            f"<body><div class='header'>The Daily Page</div><div class='menu'><ul>{menu}</ul></div>{note}"
            f"<div class='content'><h1>{title}</h1>{''.join(f'<p>{p}</p>' for p in body)}</div>"
            f"<div class='related'><p>{teaser}</p></div><div class='footer'>All rights reserved, write to us</div></body>"
        )
        want[i] = " ".join([title, *body])
    for seed in (None, 1, 2):
        rows = [(i, f"http://h{seed}.example/{i}", html if seed is None else scrambled(html, seed)) for i, html in enumerate(pages)]
        got = {r.page_id: r.text for r in wrappers.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
        assert got == want


def test_quotes_that_never_close_end_with_their_tag(spark):
    rows = [(1, "http://q.example/", '<article><p title="a>Hello</p><p>World &gt; all</p></article>'), (2, "http://r.example/", "<p title='x > y'>Fine</p>")]
    got = {r.page_id: r.text for r in wrappers.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "Hello World > all", 2: "Fine"}


def test_stored_tables_live_in_the_shared_folder_until_cleared(spark, tmp_path, monkeypatch):
    from partweave.llm import common

    own = spark
    assert common.scratch_dir(spark).startswith("file:")
    monkeypatch.setattr(common, "scratch_dir", lambda _: f"file://{tmp_path}")
    table = common.stored(own.range(10).withColumn("x", F.col("id") * 2), "t", files=1)
    assert table.agg(F.sum("x")).first()[0] == 90
    assert list(tmp_path.glob(f"partweave/{own.sparkContext.applicationId}/t-*/*.parquet"))
    common.clear_scratch(own)
    assert not list(tmp_path.glob("partweave/*/t-*"))


def test_pipeline_takes_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, SF), name)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    one, near, sub, clean = kept.values()
    shingles = lambda t: frozenset(tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4)))
    first = {}
    for d, t in sorted(one.items()):
        first.setdefault(shingles(t), d)
    assert len({shingles(t) for t in near.values()}) == len(near) <= len(one)
    assert set(first.values()) >= set(near)
    assert set(sub) == set(near) == set(clean)
    windows = Counter(tuple(w[i : i + 20]) for t in near.values() for w in [t.split()] for i in range(len(w) - 19))
    for d, t in near.items():
        w = t.split()
        if all(windows[tuple(w[i : i + 20])] == 1 for i in range(len(w) - 19)):
            assert sub[d] == t
    report = {r.doc_id: r.spans for r in secrets.secret_report(spark.createDataFrame(pd.DataFrame(sub.items(), columns=["doc_id", "text"]))).collect()}
    assert all((clean[d] == sub[d]) == (report[d] == "") for d in sub)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(clean)
