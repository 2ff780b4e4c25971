"""The training-data pipeline over `documents`: stages that each apply one operator of factloom.llm.

Language ID drops what it can't identify; exact dedup and the shingle join keep one document of each group; mixing draws
documents to target weights; packing cuts what is left into windows. Every stage but the last returns the columns of
documents. Very long texts pass whole, an empty table gives empty stages, and extra columns of documents are left out
before the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factloom.llm import exact_dedup, langid, mixing, packing, shingle_join
from factloom.llm.shared import documents, staged

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language is predicted with a score of 0.3 or more; null, empty and letterless texts go. See langid.keep_identified."""
    return langid.keep_identified(docs.select(*COLUMNS), least=0.3)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal up to white space, by smallest doc_id. See exact_dedup.drop_copies."""
    return exact_dedup.drop_copies(docs.select(*COLUMNS))


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of linked texts; rows without words stay. See shingle_join.keep_representatives."""
    return shingle_join.keep_representatives(docs.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows drawn by calibrated probabilities; nulls are sources and languages of their own. See mixing.sample_to_targets."""
    return mixing.sample_to_targets(docs.select(*COLUMNS))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a text in a window; null texts are an end mark alone. See packing.pack_documents."""
    return packing.pack_documents(docs)


STAGES = [
    ("language id", identify_language),
    ("exact dedup", dedup_exact),
    ("near dedup", dedup_near),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The recurrent network and the packer have no SQL form; the tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn, each one's rows written to the shared folder and read again."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return docs
