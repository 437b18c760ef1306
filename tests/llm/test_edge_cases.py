"""Each operator on odd and on empty tables."""

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from partweave.llm import ann, jaccard, langid, packing, pieces, quality, secrets, substring, warc, wrappers

BPE = public_tokenizers.path("word_bpe_49k.json")
SPM = public_tokenizers.path("piece_bpe_32k.model")
OPERATORS = {
    "substring": lambda d: substring.dedup_substrings(d),
    "langid": lambda d: langid.identify(d),
    "packing": lambda d: packing.pack_documents(d, BPE),
    "pieces": lambda d: pieces.encode_documents(d, SPM),
    "secrets": lambda d: secrets.secret_report(d),
    "quality": lambda d: quality.quality_report(d),
    "jaccard": lambda d: jaccard.jaccard_classes(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(no_docs, name):
    assert OPERATORS[name](no_docs).collect() == []


@pytest.mark.parametrize("name", [n for n in OPERATORS if n != "packing"])
def test_a_row_for_each_row(odd_docs, name):
    got = OPERATORS[name](odd_docs).select("doc_id").collect()
    want = odd_docs.select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r.doc_id) for r in want)


def by_id(df):
    return {r.doc_id: r for r in df.where("doc_id IS NOT NULL").collect()}


def test_substring_on_odd_rows(odd_docs):
    got = by_id(substring.dedup_substrings(odd_docs))
    assert got[1].n_removed == 0 and got[2].n_removed == 60 and got[8].n_removed == 60
    assert got[4].n_words == 0 and got[4].kept_sha256 == hashlib.sha256(b"").hexdigest()
    null = [r for r in substring.dedup_substrings(odd_docs).collect() if r.doc_id is None]
    assert [r.n_removed for r in null] == [0, 0]


@pytest.mark.parametrize("parts", [1, 2])
def test_a_repeated_row_without_another_copy_keeps_its_text(spark, parts):
    text = " ".join(f"a{k}" for k in range(60))
    rows = [(7, text), (7, text), (8, " ".join(f"b{k}" for k in range(50)))]
    # Two parts: the equal rows lie in different ones.
    docs = spark.createDataFrame([rows[0], rows[2], rows[1]], "doc_id long, text string") if parts == 2 else spark.createDataFrame(rows, "doc_id long, text string")
    got = substring.dedup_substrings(docs.coalesce(parts), with_text=True).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept_text) for r in got) == sorted((d, 0, t) for d, t in rows)
    later = spark.createDataFrame([*rows, (9, text)], "doc_id long, text string").coalesce(parts)
    assert sorted((r.doc_id, r.n_removed) for r in substring.dedup_substrings(later).collect()) == [(7, 0), (7, 0), (8, 0), (9, 60)]


def test_jaccard_on_odd_rows(odd_docs):
    rows = jaccard.jaccard_classes(odd_docs).collect()
    got = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert got[1].class_id == got[2].class_id == 1 and got[1].n_copies == 3 and got[1].n_links == 3
    assert got[3].class_id == 3 and got[3].n_links == 0 and got[6].n_links == 0
    near = [r for r in rows if r.doc_id is None and r.n_links]
    assert len(near) == 1 and near[0].class_id == 1 and near[0].n_links == 3
    kept = jaccard.keep_one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    assert sorted(r.doc_id for r in kept.where("doc_id IS NOT NULL").collect()) == [1, 3, 4, 5, 6, 7, 8, 9, 10, 11]


def test_secrets_on_odd_rows(odd_docs):
    got = by_id(secrets.secret_report(odd_docs))
    assert (got[9].n_assign, got[9].n_access, got[9].n_hex) == (1, 1, 1)
    assert got[4].spans == "" and got[4].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_language_on_odd_rows(odd_docs):
    got = by_id(langid.identify(odd_docs))
    assert got[3].lang_pred == got[4].lang_pred == got[6].lang_pred == "und" and got[3].score == 0
    assert all(0 <= r.score <= 1 for r in got.values())


def test_packing_on_odd_rows(odd_docs):
    rows = packing.pack_documents(odd_docs, BPE).collect()
    assert sum(r.piece == 0 for r in rows) == odd_docs.count()
    for r in rows:
        assert r.doc_id not in (3, 4, 6) or r.length == 1
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048


def test_pages(spark):
    page = "page_id long, url string, html string, host string, text string, digest string"
    assert warc.archive_round_trip(spark.createDataFrame([], page)).collect() == []
    assert wrappers.extract_articles(spark.createDataFrame([], page)).collect() == []
    rows = [
        (1, "http://a.b/x", "<article><p>One &amp; two<p>three</article>", "h", "t", "d"),
        (2, None, None, None, None, None),
        (None, "bad url \n", "", "h", "t", "d"),
        (3, "http://a.b/y", "<article><p>One &amp; two<p>three</article>", "h", "t", "d"),
        (3, "http://a.b/y", "<article><p>One &amp; two<p>three</article>", "h", "t", "d"),
        (4, "http://a.b/z", "<p>" + "long " * 50_000, "h", "t", "d"),
        (5, "http://a.b/w", "<article <p", "h", "t", "d"),
    ]
    df = spark.createDataFrame(rows, page)
    got = wrappers.extract_articles(df).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == 7 and texts[1] == "One & two three" and texts[2] == "" and len(texts[4]) == 249_999
    records = warc.archive_round_trip(df).collect()
    kinds = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in records)
    assert ("3", "revisit", "1") in kinds and ("1", "response", "None") in kinds and len(kinds) == 7
    assert ("None", "revisit", "2") in kinds


def test_vectors(spark):
    schema = "vec_id long, embedding array<float>, label int, key string, vector int, shard int"
    empty = spark.createDataFrame([], schema)
    assert ann.nearest(empty, F.col("vec_id") % 20 == 0).collect() == []
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (20, [0.0, 1.0]), (3, [2.0, 2.0]), (4, None), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [0.0, 0.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (0, [1.0, 0.0]), (9, [1.0, 2.0, 3.0]), (10, [])]
    df = spark.createDataFrame([(i, v, 0, "k", 1, 2) for i, v in rows], schema)
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3, 2.0), (0, 2, 1, 1.0), (0, 3, 2, 1.0), (0, 4, 20, 0.0), (20, 1, 3, 2.0), (20, 2, 0, 0.0), (20, 3, 1, 0.0), (20, 4, 2, 0.0)]
