"""The queries of this subpackage, by name, and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from nodeloom.llm import jaccard_join, langid, mixing, mtree, pii, piece_bpe, rabitq, token_count, toxicity, url_filter
from nodeloom.llm.common import table


WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), WORD_BPE)


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mtree.top_products(table(spark, sf_dir, "embeddings"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return langid.identify(documents, langid.fit(documents))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabitq.nearest(table(spark, sf_dir, "embeddings"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_bpe.encode_digests(table(spark, sf_dir, "documents"), PIECE_BPE)


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_token_counts": op2_token_counts,
    "op3_exact_top_k": op3_exact_top_k,
    "op4_language_id": op4_language_id,
    "op5_toxicity": op5_toxicity,
    "op6_nearest_neighbours": op6_nearest_neighbours,
    "op7_sentencepiece": op7_sentencepiece,
    "op8_mix_sources": op8_mix_sources,
    "op9_pii": op9_pii,
    "op10_url_filter": op10_url_filter,
}

ORACLES = {
    "op3_exact_top_k": mtree.ORACLE,
    "op8_mix_sources": mixing.ORACLE,
    "op10_url_filter": url_filter.ORACLE,
}
