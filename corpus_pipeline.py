"""Corpus pipeline: language ID, near duplicates, repeated passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; its result is written as Parquet and read again as the next one's docs.
All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from partweave.llm.common import stored, table
from partweave.llm.jaccard import keep_one_of_each
from partweave.llm.langid import identify
from partweave.llm.packing import pack_documents
from partweave.llm.secrets import redacted, scan_secrets
from partweave.llm.substring import dedup_substrings

#: A prediction below this is no better than a guess among a few languages.
LEAST_SCORE = 0.3


def _documents(found: DataFrame, text, columns: list[str]) -> DataFrame:
    """The columns of documents, with a new text and its length."""
    new = {"doc_id": F.col("doc_id"), "text": text, "n_chars": F.length(text).cast("long")}
    return found.select(*[new.get(c, F.col("kept")[c]).alias(c) for c in columns])


def _others(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c not in ("doc_id", "text"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no clear language, go.

    A null, empty or letterless text has no language and goes; repeated rows stay or go
    together; without training rows every document goes; an empty table stays empty.
    """
    found = identify(docs, keep=_others(docs))
    held = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return held.select(*[(F.col(c) if c in ("doc_id", "text") else F.col("kept")[c]).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id.

    A text without words (or null) is alone and stays; of a repeated row one stays; a
    null doc_id stays only where its group has no other; an empty table stays empty.
    """
    return keep_one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages leave the texts; documents stay, with what is left of them.

    A null text stays null, a text of repeats only becomes empty; repeated rows are one
    document and all keep the same text; a row without doc_id is left as it is.
    """
    found = dedup_substrings(docs, keep=_others(docs), with_text=True)
    return _documents(found, F.col("kept_text"), docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a marker; documents stay.

    A null text has no secret; repeated rows are scanned each; an empty table stays empty.
    """
    found = scan_secrets(docs, keep=_others(docs)).withColumnRenamed("id", "doc_id")
    return _documents(found, redacted(F.col("text"), F.col("spans")), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, packed into sequences.

    A null or empty text is a piece of the end id alone; repeated rows are packed each.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("substring_dedup", substring_dedup),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: Classifier, components and packing are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
