"""A training-data pipeline over documents: toxicity, near duplicates, repeats, decontamination, tokens.

Stages take documents (doc_id, text and any other columns) and, but for the last, return their columns. In all of them
null and empty texts stay and are never alike; repeated ids keep their rows unless the texts are alike; empty tables give
empty ones; documents may be of any length and have columns of any further names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm import decontaminate, entry, jaccard_join, suffix_dedup, toxicity
from wattline.llm.text import kept


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on the labels of these documents, does not reject; without labels all stay."""
    scored = toxicity.score(spark, docs.withColumn("_columns", F.struct(*docs.columns)), entry.table(spark, sf_dir, "labels"), carry=True)
    return scored.where("predicted = 0").select("_columns.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts with five-word shingles of Jaccard 0.8 or more, that of the smallest id; rows without id stay."""
    return jaccard_join.drop_near_duplicates(spark, docs, words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a document of a smaller id has too; n_chars, if there, counts what is left."""
    done = suffix_dedup.remove_repeats(spark, docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of ten words of any benchmark item occurs."""
    return decontaminate.drop_contaminated(spark, docs, entry.table(spark, sf_dir, "benchmark"))


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and the decoded bytes of each document left."""
    return entry.coded(spark, docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", drop_near_copies),
    ("suffix_dedup", cut_repeats),
    ("decontaminate", drop_contaminated),
    ("byte_bpe", tokenise),
]

#: Toxicity is a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again by the next."""
    docs = entry.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(spark, stage(spark, docs, sf_dir), f"stage_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
