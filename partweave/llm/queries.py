"""The registered queries of the training-data operators."""

from __future__ import annotations

import public_tokenizers

from pyspark.sql import functions as F

from partweave.llm import oracles
from partweave.llm.ann import nearest
from partweave.llm.codes import code_report
from partweave.llm.common import table
from partweave.llm.jaccard import jaccard_classes
from partweave.llm.langid import identify
from partweave.llm.packing import pack_documents
from partweave.llm.pieces import encode_documents
from partweave.llm.quality import quality_report
from partweave.llm.secrets import secret_report
from partweave.llm.substring import dedup_substrings
from partweave.llm.toxicity import score_toxicity
from partweave.llm.turns import repair_conversations
from partweave.llm.warc import archive_round_trip
from partweave.llm.wrappers import extract_articles


def op7_secret_scan(spark, sf_dir):
    return secret_report(table(spark, sf_dir, "documents"))


def op8_line_frequency(spark, sf_dir):
    return quality_report(table(spark, sf_dir, "documents"))


def op2_substring_dedup(spark, sf_dir):
    return dedup_substrings(table(spark, sf_dir, "documents"))


def op9_jaccard_join(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents")).drop("uid", "keeper")


def op5_best_fit_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op10_prefix_forest(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op4_language_id(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


def op6_sentence_pieces(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op1_warc_round_trip(spark, sf_dir):
    return archive_round_trip(table(spark, sf_dir, "pages"))


def op3_wrapper_extraction(spark, sf_dir):
    return extract_articles(table(spark, sf_dir, "pages"))


def op11_annular_codes(spark, sf_dir):
    return code_report(table(spark, sf_dir, "embeddings"))


def op12_conversation_repair(spark, sf_dir):
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op13_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_warc_round_trip": op1_warc_round_trip,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_wrapper_extraction": op3_wrapper_extraction,
    "op4_language_id": op4_language_id,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_sentence_pieces": op6_sentence_pieces,
    "op7_secret_scan": op7_secret_scan,
    "op8_line_frequency": op8_line_frequency,
    "op9_jaccard_join": op9_jaccard_join,
    "op10_prefix_forest": op10_prefix_forest,
    "op11_annular_codes": op11_annular_codes,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_toxicity": op13_toxicity,
}

#: The others' results (classifiers, a packing, wrappers, pieces, near neighbours)
#: are not expressible in SQL; tests/llm compares them with plain versions.
ORACLE: dict[str, str] = {
    "op1_warc_round_trip": oracles.OP1,
    "op2_substring_dedup": oracles.OP2,
    "op7_secret_scan": oracles.OP7,
    "op8_line_frequency": oracles.OP8,
    "op9_jaccard_join": oracles.OP9,
    "op11_annular_codes": oracles.OP11,
    "op12_conversation_repair": oracles.OP12,
}
