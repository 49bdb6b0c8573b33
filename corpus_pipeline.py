"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as
Parquet and read again as the next stage's documents. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vellumine.llm.common import Scratch, temporary
from vellumine.llm.exact_dedup import drop_exact_duplicates
from vellumine.llm.language_id import keep_identified, language_model
from vellumine.llm.ngram_join import drop_near_duplicates
from vellumine.llm.packing import pack_documents
from vellumine.llm.quality import THRESHOLD, keep_quality, quality_model

#: A text whose likeliest language has a lower score goes, as does one without letters.
LEAST_LANGUAGE_SCORE = 0.4
#: Near copies: word five-grams with a Jaccard similarity of so much or more.
SHINGLE_WORDS, LEAST_SIMILARITY = 5, Fraction(4, 5)


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts whose language is told with some confidence."""
    return keep_identified(docs, language_model(docs), LEAST_LANGUAGE_SCORE)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep texts that the quality classifier accepts; it learns from ``labels``."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return keep_quality(docs, quality_model(docs, labels), least=THRESHOLD)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of equal texts."""
    return drop_exact_duplicates(docs)


def different(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of each group of near copies."""
    return drop_near_duplicates(docs, SHINGLE_WORDS, LEAST_SIMILARITY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 4096 tokens."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


STAGES = [("language", identified), ("quality", good), ("exact_dedup", distinct), ("near_dedup", different), ("packing", packed)]

#: The models of the first two stages can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has written goes when the next one is done."""
    scratch = Scratch(spark, "pipeline")
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with temporary():
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        if last is not None:
            scratch.drop(last)
        last = name
    return STAGES[-1][1](spark, docs, sf_dir)
