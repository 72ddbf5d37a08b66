"""From raw documents to packed sequences in five stages, each the operator of that name over all its predecessor kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assayloom.llm import language, mixing, packing, simhash, substrings
from assayloom.llm.common import work_dir
from assayloom.runtime import ship


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that are in no language: null texts, texts without a letter, and ones that resemble no language's profile. A null
    lang becomes the language found; the other columns stay."""
    ship(spark)
    return language.keep_identified(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the smallest doc_id, of each group linked by fingerprints at two or fewer differing bits; rows without a doc_id
    come last, rows equal in id and text are one."""
    ship(spark)
    return simhash.keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 35 words or more that start elsewhere too; every document stays, with what is left of its text (null stays null)."""
    ship(spark)
    return substrings.rewrite(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take documents so that sources reach their targets; a document taken k times gives k rows, one without words none."""
    ship(spark)
    return mixing.resample(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens: one row a piece with its ids (little-endian, 32 bits each) and their checksum."""
    ship(spark)
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "ids")


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("mix", mix), ("pack", pack)]

#: Fingerprints, learned languages and token ids have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder and read again. No documents, no rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    home = f"{work_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{name}")
        docs = spark.read.parquet(f"{home}/{name}")
    return docs
