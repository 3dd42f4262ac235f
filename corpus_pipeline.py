"""A corpus made ready for training: five stages over the documents, each an operator of tarnlake.llm.

Each stage takes the documents that the one before it kept, whole, and all but the last return the
columns of documents. The result of a stage is written as Parquet and read again, so a lost executor
costs the running stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.llm.decontam import without_leaks
from tarnlake.llm.mixing import curriculum
from tarnlake.llm.simhash import one_of_each
from tarnlake.llm.tokens import token_report
from tarnlake.llm.toxicity import without_toxic
from tarnlake.session import stored
from tarnlake.sources.tables import read_table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.5 or more go."""
    return without_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id stays."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, but for a fifth of its words at most, go."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are cut or repeated to their targets; rows are in the order of training."""
    return curriculum(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids are written in grammar-compressed blocks and read back for the report."""
    return token_report(docs)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("tokens", tokens)]

#: SQL can't state compression distances, fingerprint components or grammar-compressed files.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
