"""Stages that turn a corpus of documents into a training mix.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, minhash, mixing, pii, toxicity
from tallyforge.llm.common import discard, settled, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score below 0.5, learnt from the labels that are not held out."""
    return toxicity.clean(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8 or more): the one with the smallest id.

    Rows with equal ids are one document; of rows with equal ids and texts all stay or go together.
    """
    found = minhash.near_duplicates(docs, shingle=5)
    gone = found.where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["gone_id"], "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars counted anew."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, and where in its order first: doc_id, source, size, source_size, target, taken, first_slot."""
    mix = mixing.mix_sources(docs).documents
    return mix.select("doc_id", "source", "size", "source_size", F.round("target", 3).alias("target"), "taken", "first_slot")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
]

# The first two stages are a learnt classifier and signatures: no SQL for the whole.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what a stage returns is written to the shared folder and read again by the next. A stage's
    other tables are deleted once its result is there, and that once the next stage's is."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        previous, docs = docs, settled(lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        discard(previous)
    return STAGES[-1][1](spark, docs, sf_dir)
