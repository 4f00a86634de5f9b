"""The corpus pipeline: toxicity, line dedup, near-dedup, substring dedup, packing, in this order.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; ``run`` writes each stage's result as Parquet under the shared folder and
reads it as the next stage's docs.  All stages but the last return the columns of documents; a stage that rewrites texts also rewrites
n_chars.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from margrave.llm import line_dedup, near_dedup, packing, substring_dedup, toxicity
from margrave.llm.common import Scratch, table


def _as_documents(docs: DataFrame, out: DataFrame, text: Column) -> DataFrame:
    """The columns of docs from out, with a new text (a null stays null) and n_chars, where there is one, counted anew."""
    new = F.when(F.col("text").isNotNull(), text)
    own = {"text": new, "n_chars": F.char_length(new)}
    return out.select(*[(own[x].cast(docs.schema[x].dataType) if x in own else F.col(f"`{x}`")).alias(x) for x in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go."""
    return toxicity.keep_clean(docs, table(spark, sf_dir, "labels"))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents share stay in one of them."""
    named = docs.withColumnRenamed("kept", "__kept") if "kept" in docs.columns else docs
    out = _as_documents(named, line_dedup.dedup_lines(named), F.col("kept.text"))
    return out.withColumnRenamed("__kept", "kept")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the least doc_id stays."""
    return near_dedup.keep_one(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in passages of 35 words or more that start elsewhere too go."""
    return _as_documents(docs, substring_dedup.dedup_substrings(docs, with_text=True), F.col("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of a power of two tokens, with no padding."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_common_lines),
    ("MinHash near-dedup", keep_one_of_each_group),
    ("substring dedup", drop_repeated_passages),
    ("packing", pack),
]

#: The learned toxicity grammar and the tokenizer can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        new = scratch.write(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if hasattr(docs, "scratch_path"):
            scratch.drop(docs)
        docs = new
    return STAGES[-1][1](spark, docs, sf_dir)
