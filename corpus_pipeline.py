"""The training-corpus pipeline: stages over `documents`, each given what the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's docs.  All but the last return the columns
of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docweave.llm.base import materialize, read_table
from docweave.llm.decontam import drop_contaminated
from docweave.llm.jaccard import first_of_each
from docweave.llm.packing import pack_documents
from docweave.llm.quality import keep_good
from docweave.llm.secrets import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts are scored too; repeated rows have one fate; an empty table gives no rows."""
    return keep_good(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that 5-word shingle sets of similarity 0.8 or more link, the smallest id stays.

    Null and empty texts and null ids have no links and stay; rows of one id stay or go
    together; an empty table gives no rows."""
    return first_of_each(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of `benchmark` go; null and empty texts hold none, repeated rows have one fate."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets become [SECRET], n_chars follows; every document stays."""
    return redact_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, as op1_pack_sequences returns them; null and empty texts
    are the end id alone, repeated rows are packed each, an empty table gives no rows.

    The executors' memory is shared with the stages before, so less is remembered."""
    return pack_documents(docs, remembered=150_000, read=1 << 20)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("secrets", secrets), ("packing", packing)]

#: SQL can express neither the classifier nor the packing; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written to the shared folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
