"""One query per operator, over its whole table, and the DuckDB SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from . import bpe_codec, chat_format, line_dedup, near_dedup, nearest, packing, quality, substring_dedup, token_counts, toxicity
from .common import table


def _documents(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def op1_chat_format(spark, sf_dir):
    return chat_format.format_chats(table(spark, sf_dir, "conversations"))


def chat_linked_calls(spark, sf_dir):
    """Op 1 over the same conversations, whose turns are made calls and results."""
    return chat_format.format_chats(chat_format.with_calls(table(spark, sf_dir, "conversations")))


def op2_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup_digest(_documents(spark, sf_dir))


def op3_bpe_codec(spark, sf_dir):
    return bpe_codec.codec_digest(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op4_quality_rules(spark, sf_dir):
    return quality.quality_digest(_documents(spark, sf_dir))


def op5_toxicity(spark, sf_dir):
    return toxicity.toxicity_digest(_documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op6_packing(spark, sf_dir):
    return packing.pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op7_nearest_neighbours(spark, sf_dir):
    return nearest.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op8_substring_dedup(spark, sf_dir):
    return substring_dedup.dedup_substrings(_documents(spark, sf_dir))


def op9_token_counts(spark, sf_dir):
    return token_counts.token_count_digest(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_near_dedup(spark, sf_dir):
    return near_dedup.near_duplicates(_documents(spark, sf_dir))


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "chat_linked_calls": chat_linked_calls,
    "op2_line_dedup": op2_line_dedup,
    "op3_bpe_codec": op3_bpe_codec,
    "op4_quality_rules": op4_quality_rules,
    "op5_toxicity": op5_toxicity,
    "op6_packing": op6_packing,
    "op7_nearest_neighbours": op7_nearest_neighbours,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_near_dedup": op10_near_dedup,
}
ORACLES = {
    "op1_chat_format": chat_format.ORACLE,
    "chat_linked_calls": chat_format.LINKED_ORACLE,
    "op2_line_dedup": line_dedup.ORACLE,
    "op4_quality_rules": quality.ORACLE,
    "op8_substring_dedup": substring_dedup.ORACLE,
}
