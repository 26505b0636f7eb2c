"""From raw documents to a mixed corpus: language, exact and near copies, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and read again as the next stage's docs.  Every stage but the last returns
the columns of documents for the rows that it keeps, under whatever names there are
besides; the names that operators use inside step aside for them.

Nulls, empty and very long texts, ties and repeated rows are treated as the stages'
operators say: texts without a letter go with the first stage, of equal texts the largest
doc_id stays (of rows that repeat it, one), of near copies the smallest, very long
texts are read whole, in pieces.  An empty table stays empty through all stages.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from passagework.llm import decontaminate, exact, language, mixing, simhash
from passagework.llm.common import checkpoint_dir, read


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language.keep_identified(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the one with the largest doc_id."""
    return exact.keep_last_copy(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group, the one with the smallest doc_id."""
    return simhash.keep_one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words of each kept document the mix takes."""
    return mixing.mix(docs)


STAGES = [
    ("language", identify_language),
    ("exact", drop_exact_copies),
    ("simhash", drop_near_copies),
    ("benchmark", drop_leaks),
    ("mixing", mix_sources),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = read(spark, sf_dir, "documents")
    folder = f"{checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs


#: Language mixtures, alignments and keyed permutations are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None
