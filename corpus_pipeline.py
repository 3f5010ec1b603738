"""A corpus pipeline of five stages, each an operator of ``nodeloom.llm`` over all that the stage before it kept.

Every stage takes (spark, docs, sf_dir); all but the last return the columns of ``documents`` and no others: further
columns of ``docs`` are cut. Rows with null or repeated ids pass through each stage as its operator defines: they are
scored each, are near copies of each other, are masked each, and share one decision of the mix if their texts are equal
too. Null and empty texts are clean, alone, and leave at the mix, which takes words. Empty tables give empty ones.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.llm import jaccard_join, mixing, pii, piece_bpe, toxicity
from nodeloom.llm.common import stored, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5 stay; the fit reads labels of documents that are not held out."""
    weights = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, weights).where("toxicity < 0.5").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by a similarity of 0.8 or more on five-word shingles, the smallest id stays."""
    return jaccard_join.deduplicate(docs).select(*COLUMNS)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span of personal data gives way to its kind in angle brackets; n_chars follows."""
    text = pii.masked(F.col("text"), F.col("spans"))
    return pii.find_spans(docs).withColumn("text", text).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed(docs).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, and whether decoding them gives its text back (a literal piece mark decodes to a space)."""
    path = public_tokenizers.path("piece_bpe_32k.model")
    both = piece_bpe.round_trip(docs.select("doc_id", "text", "lang", "source"), path)
    same = F.col("decoded") == F.translate(F.coalesce("text", F.lit("")), piece_bpe.SPACE, " ")
    return both.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("personal_data", mask_personal_data),
    ("mixing", mix),
    ("tokens", tokenize),
]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
