"""The corpus pipeline: quality, line dedup, near-duplicate join, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's documents.  All but the last return the columns
of documents; the last returns what the mix takes of each document.

Defined cases, in every stage: nulls in any column and empty texts are kept unless the stage's rule drops them (the classifier scores
them, near duplicates and leaks they are not); rows that repeat an id are told apart by text; an empty table gives an
empty one; further columns go through unchanged up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shortlane.llm import _spark, decontaminate, lines, mixing, ngram_join, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that the rule ensemble scores under its threshold."""
    return quality.keep_good(docs, _spark.table(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that recur across documents, as they are or as templates."""
    return lines.dedup_lines(docs, exact=True).withColumn("n_chars", F.length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return ngram_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark items, verbatim or with other values."""
    return decontaminate.drop_contaminated(docs, _spark.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix_sources(docs)[0].select("doc_id", "source", "size", "source_size", "target", "taken")


STAGES = [
    ("quality classifier", keep_quality),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix),
]

#: Learnt scores and seeded draws are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = _spark.cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
