"""The corpus pipeline: toxicity, near-duplicates, decontamination, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before
kept; all but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtspark.llm import decontaminate, packing, pii, simhash, toxicity
from evtspark.llm.common import STEPS, discard, shared_dir, table
from evtspark.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go; the model is learnt from the labelled documents given. Without labels all stay."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, model, threshold=0.3)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, that of the smallest id."""
    return simhash.drop_near_duplicates(docs, width=5, distance=11, similarity=0.8)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edited by a fifth of its words at most, go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are replaced by their kind; n_chars follows the text."""
    return pii.sanitise(docs, pii.find(docs)).withColumn("n_chars", F.length("text").cast("long"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: a row per piece of a document, with its place."""
    packed = packing.pack(docs, tokenizer_path(), seq_len=2048, end_id=0)
    return packed.withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: Learnt weights, masks and tokens are beyond SQL; the tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next.

    A stage's own steps and its input go as soon as its output is written; what the
    last stage wrote is read by whoever takes its rows. Runs in one driver, each in its
    own thread, know their own steps only.
    """
    docs, before = table(spark, sf_dir, "documents"), []
    base = f"{shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        token = STEPS.set([])
        try:
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs.write.parquet(f"{base}/{name}")
                docs = spark.read.parquet(f"{base}/{name}")
                discard(spark, STEPS.get() + before)
                before = [f"{base}/{name}"]
        finally:
            STEPS.reset(token)
    return docs
