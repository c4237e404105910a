"""The corpus pipeline: from raw documents to the token ids of a mixed, deduplicated corpus.

Each stage takes all rows that the one before kept, with the columns of ``documents``, and its
decisions take effect: quality rules and language identification drop what they reject, near
duplicates leave one document of each group, mixing drops and repeats documents, and the last stage
encodes every row, keeps its ids, and proves them by the digest of the text that they decode to.

Nulls: a document with a null text has no words and goes at the first stage; null doc_id, lang and
source stay. Empty texts go like null ones, long texts are worked on whole. Rows that are repeated
are near duplicates of each other, so one of them stays, and mixing may repeat it. Extra columns, of
any name, go along up to the last stage. Without documents every stage has no rows; without labels
the first stage has its base rules only, and without any known language the second drops all.
Ties are settled by doc_id or a hash of it, so that reruns agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crivo.llm import bpe, language_id, mixing, quality_rules, simhash
from crivo.llm.common import remove, scratch, shared_dir, stored, table


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs, table(spark, sf_dir, "labels"))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.keep_known(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """By the settings of ``op10_simhash_components``: three-word shingles, at most 3 of 64 bits apart. Most near
    copies at a similarity of 0.8 differ in more bits and stay; README has the measured share."""
    return simhash.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded_corpus(docs, bpe.default_vocabulary())


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("language_id", language_stage),
    ("simhash_near_dedup", near_duplicate_stage),
    ("source_mixing", mixing_stage),
    ("bpe_round_trip", encoding_stage),
]

#: No SQL has learned rules, a learned language model, or solves the mixture's dual.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage stored on its way, and its input, are deleted once its result is written."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, f"stage-{name}")
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), name, path)
        if before:
            remove(spark, before)
        before = path
    return docs
