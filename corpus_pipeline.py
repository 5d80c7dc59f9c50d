"""Cleaning and packing of a corpus: quality rules, quality classifier, line dedup, near-duplicate removal, packing.

Each stage works on all documents that its predecessor kept, and returns the columns of `documents`; the last one returns packed pieces.
`run` writes every stage to the shared folder and reads it back, so a lost executor costs one stage's tasks at most.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from turnstile.llm import bottomk, line_dedup, packing, quality_model, quality_rules, tokens
from turnstile.llm.common import prepare, read
from turnstile.session import materialise


def quality_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, read(prepare(spark), sf_dir, "labels"))


def quality_by_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_model.keep_good(docs, quality_model.train(docs, read(prepare(spark), sf_dir, "labels")))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A document of which earlier ones hold every line goes: a copy, or one made of passages of several documents."""
    return line_dedup.remove_repeats(docs, drop_emptied=True)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bottomk.keep_one(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN,
                                  added=tokens.added_tokens(public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("quality rules", quality_by_rules), ("quality classifier", quality_by_model), ("line dedup", without_repeated_lines),
          ("near duplicates", without_near_duplicates), ("packing", packed)]

#: SQL cannot express the classifier, the alignment of documents or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(prepare(spark), sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = materialise(docs, f"stage{number}")
    return docs
