"""The pipeline operators' queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..session import read_table
from . import chat, decontaminate, exact_dedup, html_extract, jaccard_join, language_id, packing, phrase_mining, pivot_clusters, quality, sharding, token_counts, warc
from .common import prepared
from .oracle import ORACLE as ORACLE

VOCABULARY = "word_bpe_49k.json"
CHAT_VOCABULARY = "byte_bpe_50k.json"


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_report(spark, read_table(prepared(spark), sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepared(spark), sf_dir, "documents")
    return packing.pack(spark, docs, public_tokenizers.path(VOCABULARY), capacity=4096, end_id=1)


def op3_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archived = warc.round_trip(spark, read_table(prepared(spark), sf_dir, "pages"), min_bytes=0)
    return archived.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(prepared(spark), sf_dir, "conversations")
    rows = rows.select("conv_id", "turn", "role", "text").unionByName(chat.hard_case(spark, rows))
    return chat.read_back(chat.format_conversations(rows, public_tokenizers.path(CHAT_VOCABULARY)))


def op5_quality_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (read_table(prepared(spark), sf_dir, t) for t in ("documents", "labels"))
    return quality.scores(spark, docs, quality.learn(docs, labels))


def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(prepared(spark), sf_dir, "pages")
    return html_extract.main_texts(pages, html_extract.learn(pages))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (read_table(prepared(spark), sf_dir, t) for t in ("documents", "benchmark"))
    return decontaminate.contamination(spark, docs, items, size=10)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepared(spark), sf_dir, "documents")
    return token_counts.token_counts(docs, public_tokenizers.path(VOCABULARY), limit=2048)


def op9_label_propagation_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.label_propagation_shards(spark, read_table(prepared(spark), sf_dir, "documents"), shards=40)


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepared(spark), sf_dir, "documents")
    return jaccard_join.near_duplicates(spark, docs).drop("th", "root")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepared(spark), sf_dir, "documents")
    return phrase_mining.collocations(spark, docs, min_count=100, top=2000)


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(prepared(spark), sf_dir, "documents")
    return language_id.languages(spark, docs, language_id.learn(spark, docs))


def op13_pivot_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_clusters.clusters(spark, read_table(prepared(spark), sf_dir, "embeddings"), k=8, rounds=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_exact_dedup,
        op2_best_fit_packing,
        op3_warc_round_trip,
        op4_chat_format,
        op5_quality_ranking,
        op6_main_text,
        op7_decontamination,
        op8_token_counts,
        op9_label_propagation_shards,
        op10_ngram_jaccard_join,
        op11_phrase_collocations,
        op12_language_id,
        op13_pivot_clusters,
    )
}
