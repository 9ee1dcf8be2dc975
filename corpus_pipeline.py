"""From raw documents to token records, in five stages; each is written as Parquet and reread.

A stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last
return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm import decontam, jaccard, langid, mixing, records
from memloom.llm.textio import crc_mod, shared_path, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the identifier rejects; a null lang is filled in with the one predicted.

    Null texts and texts without a letter are rejected; of repeated rows each stays or goes with its text.
    Rows with a null doc_id or lang teach nothing; with nothing learned, all rows are rejected."""
    identifier = langid.fit(docs.where(crc_mod(F.col("doc_id"), 5) != 0))
    return langid.accepted(docs, identifier)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the least doc_id, of each group linked by shingle similarity. Rows
    whose text is null or has no word are in no group and all stay."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a near copy of a benchmark item. Null and empty texts hold none and
    stay, as do all rows where the benchmark is empty; repeated rows stay or go together."""
    return decontam.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to their sources' target rates and shuffles them globally. A null source is one of
    its own; rows that share a doc_id (null too) are repeated equally often."""
    return mixing.mix(docs).select(*docs.columns)


def token_records(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes token records and returns their index. The stage before has shuffled the rows
    globally and its files hold them in that order, so they are written as they lie.

    Null and empty texts become the end id alone; repeated rows are written each."""
    return records.token_records(docs, as_stored=True)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixing_sources),
    ("token-ID / binary output", token_records),
]

#: SQL can express neither the language models nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, "stage-" + "".join(c if c.isalnum() else "-" for c in name))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
