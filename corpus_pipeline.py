"""The corpus pipeline: each stage applies one operator of ``tessera.llm`` to all that the stage before it kept.

Quality classifier (rejected documents go), exact dedup (one of equal texts stays), near dedup (one document of each
group stays), mixing (documents in as many copies as their source's rate gives) and packing into sequences.

All stages but the last return their rows with all columns of ``docs``, whatever those are called; they read ``doc_id``,
``text`` and (mixing) ``source``. Texts may be of any length; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm.common import scratch_dir, ship, table
from tessera.llm.dedup import deduplicated
from tessera.llm.jaccard import one_of_each
from tessera.llm.mixing import repeated
from tessera.llm.packing import pack
from tessera.llm.quality import kept


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier accepts. A null text is scored as an empty one, equal texts alike. Without a
    positive label there is no model and all stay."""
    return kept(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row for every text, white space aside: the longest, then the one of the smallest ``doc_id``. Null texts equal
    empty ones."""
    ship(spark)
    return deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest ``doc_id`` of every group of near duplicates. Wordless texts and rows without ``doc_id`` all stay; rows
    that repeat one ``doc_id`` stay or go together."""
    ship(spark)
    return one_of_each(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row as often as its source's rate says; a null source is one of its own. Rows that repeat a ``doc_id`` share
    its draw; wordless texts count nothing towards a target."""
    return repeated(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences (see ``packing.pack``); null and empty texts are one end token."""
    ship(spark)
    return pack(docs)


STAGES = [("quality", quality), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mixing), ("packing", packing)]

#: Tokenizing and a trained classifier are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each result is written as Parquet to the shared scratch folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{scratch_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
