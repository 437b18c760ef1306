"""The pipeline's stages on odd, repeated and empty tables."""

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

STAGES = dict(corpus_pipeline.STAGES)
LAST = corpus_pipeline.STAGES[-1][0]


def rows_of(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", [n for n in STAGES if n != LAST])
def test_stages_keep_the_columns_of_any_table(spark, odd_docs, no_docs, name):
    """Extra columns whose names the operators use within stay as they are."""
    empty = STAGES[name](spark, no_docs, "")
    assert empty.columns == no_docs.columns and empty.count() == 0
    out = STAGES[name](spark, odd_docs, "")
    assert out.columns == odd_docs.columns
    same = ["lang", "source", "uid", "m", "kept", "node", "place", "key"]
    kept = {tuple(r) for r in out.select("doc_id", *same).collect()}
    assert kept <= {tuple(r) for r in odd_docs.select("doc_id", *same).collect()}


def test_language_id_drops_what_has_no_letter(spark, odd_docs):
    ids = {r.doc_id for r in STAGES["language_id"](spark, odd_docs, "").collect()}
    assert not ids & {3, 4, 6} and {1, 2, 8} <= ids


def test_near_duplicates_keep_one_of_each_and_all_without_words(spark, odd_docs):
    got = [r.doc_id for r in STAGES["near_duplicates"](spark, odd_docs, "").collect()]
    assert got.count(2) == 0 and got.count(1) == 1 and {3, 4, 6} <= set(got)


def test_repeated_passages_and_secrets_leave_the_text(spark, odd_docs):
    before = {r.doc_id: r.text for r in odd_docs.collect()}
    after = {r.doc_id: r for r in STAGES["substring_dedup"](spark, odd_docs, "").collect()}
    assert after[8].text == " ".join(before[8].split()[:40]) and after[2].text == ""
    assert after[1].text == before[1] and after[4].text is None
    assert all(r.n_chars == len(r.text) for r in after.values() if r.text is not None)
    clean = {r.doc_id: r.text for r in STAGES["secret_scan"](spark, odd_docs, "").collect()}
    assert "aaaabbbb" not in clean[9] and "AKIA" not in clean[9] and clean[4] in (None, "")
    assert all(clean[d] == t for d, t in before.items() if d not in (4, 9) and t is not None and not re.search("secret|AKIA", t))


def test_packing_takes_whatever_came_through(spark, odd_docs, no_docs):
    assert STAGES[LAST](spark, no_docs, "").count() == 0
    got = STAGES[LAST](spark, odd_docs, "")
    assert got.where("piece = 0").count() == odd_docs.count()
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_the_whole_pipeline_on_odd_tables(spark, odd_docs, no_docs, tmp_path):
    for name, docs, rows in (("odd", odd_docs, True), ("none", no_docs, False)):
        folder = tmp_path / name
        docs.write.parquet(f"{folder}/documents.parquet")
        assert (corpus_pipeline.run(spark, str(folder)).count() > 0) == rows
