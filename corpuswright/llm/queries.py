"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, conversation_trie, hard_negatives, language_model
from .common import read_table
from .decontaminate import contaminated
from .exact_dedup import exact_groups
from .near_dedup import near_duplicate_classes
from .packing import pack_documents
from .secret_scan import find_secrets
from .substring_dedup import remove_repeats
from .surrogates import replace_personal_data
from .token_counts import count_tokens
from .toxicity import fit, in_training_fold, score


#: Only so that results can be compared between runs; a real run passes a secret of its own.
SURROGATE_KEY = "key of the registered query"


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_pairs(chat_format.whole_pairs(read_table(spark, sf_dir, "conversations")), "conv_id")


def op1_chat_format_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_pairs(chat_format.parroting_pairs(read_table(spark, sf_dir, "conversations")), "conv_id")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_literal")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).drop("kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read_table(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_personal_data(read_table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(read_table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(in_training_fold()))
    scored = score(docs, model)
    return scored.select("doc_id", (~in_training_fold()).alias("held_out"), "score", "predicted")


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language_model.score(docs, language_model.fit(docs.where(language_model.in_training_part())))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(read_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_chat_format, op1_chat_format_last, op2_secrets, op3_token_counts, op4_decontamination, op5_packing, op6_substring_dedup, op7_exact_dedup,
        op8_personal_data, op9_near_dedup, op10_toxicity, op11_lm_scores, op12_prefix_trie, op13_hard_negatives,
    )
}

ORACLES: dict[str, str] = {
    "op1_chat_format": chat_format.ORACLE,
    "op1_chat_format_last": chat_format.ORACLE_LAST,
    "op12_prefix_trie": conversation_trie.ORACLE,
    "op13_hard_negatives": hard_negatives.ORACLE,
    "op7_exact_dedup": r"""
        WITH t AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents
        ), g AS (
          SELECT text_sha256, count(*) AS group_size, arg_min(doc_id, (-n, doc_id)) AS keep_id FROM t GROUP BY 1
        )
        SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, t.text_sha256
        FROM t JOIN g USING (text_sha256)
    """,
}
