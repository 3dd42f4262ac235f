"""The queries of this subpackage, by name, and their SQL where SQL can state them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tarnlake.sources.tables import read_table

QUERIES = {}
ORACLES = {}


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.mixing import mix_report

    return mix_report(_documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.toxicity import toxicity_report

    return toxicity_report(_documents(spark, sf_dir), read_table(spark, sf_dir, "labels"))


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.langid import langid_report

    return langid_report(_documents(spark, sf_dir))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.pii import pii_report

    return pii_report(_documents(spark, sf_dir))


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.tokens import token_report

    return token_report(_documents(spark, sf_dir))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.simhash import simhash_report

    return simhash_report(_documents(spark, sf_dir))


def op6_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.decontam import decontam_report

    return decontam_report(_documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.substring import substring_report

    return substring_report(_documents(spark, sf_dir))


def op3_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.ann import nearest

    return nearest(read_table(spark, sf_dir, "embeddings"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tarnlake.llm.line_dedup import line_report

    return line_report(_documents(spark, sf_dir))


def _register() -> None:
    from tarnlake.llm.mixing import mix_sql

    QUERIES["op10_mixing"] = op10_mixing
    ORACLES["op10_mixing"] = mix_sql()
    QUERIES["op7_toxicity"] = op7_toxicity
    QUERIES["op9_langid"] = op9_langid
    QUERIES["op5_pii"] = op5_pii
    QUERIES["op8_tokens"] = op8_tokens
    QUERIES["op1_simhash"] = op1_simhash
    QUERIES["op6_decontam"] = op6_decontam
    QUERIES["op4_substring"] = op4_substring
    QUERIES["op3_ann"] = op3_ann
    QUERIES["op2_line_dedup"] = op2_line_dedup


_register()
