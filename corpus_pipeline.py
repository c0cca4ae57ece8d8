"""The corpus pipeline: documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns a
DataFrame, which is written as Parquet and read again as the next one's ``docs``. All stages but
the last return the columns of ``documents``; the last returns the packed pieces.

1. quality: documents that the preference ranking scores below 0.5 go.
2. exact_dedup: of equal texts the row with the largest doc_id stays.
3. near_dedup: of documents linked by a five-word Jaccard similarity of 0.8 or more, directly or
   through others, the one with the smallest doc_id stays.
4. decontamination: documents that hold ten consecutive words of a benchmark item (or a whole
   shorter item) go.
5. packing: the rest is tokenised and packed into sequences of at most 4096 tokens.

A null text is an empty one throughout and survives until packing, where it is one end token.
Rows with a null doc_id pass like others. An empty table runs through all stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradewell.llm import decontaminate, exact_dedup, jaccard_join, packing
from gradewell.llm import quality as ranking
from gradewell.llm.common import prepared, written
from gradewell.session import read_table

VOCABULARY = "word_bpe_49k.json"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(prepared(spark), sf_dir, "labels")
    return ranking.accepted(docs, ranking.learn(docs, labels))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicated(prepared(spark), docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(prepared(spark), docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = read_table(prepared(spark), sf_dir, "benchmark")
    return decontaminate.decontaminate(spark, docs, benchmark, remove="documents")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(prepared(spark), docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality", quality),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", clean),
    ("packing", pack),
]

# shingle sets, a trained ranking and a tokenizer are beyond SQL; the tests hold run() against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = read_table(prepared(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(spark, stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
