"""Sinks (S10, S13-S16). All writes are Spark writers (parallel, task-retry safe);
nothing is gathered on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.catalogue import catalogue_csv
from tessera.sources import fs


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet table; ``mode='append'`` for the append sink, overwrite for snapshots."""
    df.write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Report rows as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_documents(df: DataFrame, path: str) -> None:
    """One JSON document per row (nested trees keep their structure)."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, source: str | None = None) -> None:
    """Rewritten CSV with header, to a new path (never over its own source)."""
    spark = df.sparkSession
    if source and fs.qualified(spark, source) == fs.qualified(spark, path):
        raise ValueError("refusing to write a CSV over its own source")
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_catalogue_csv(catalogue: DataFrame, path: str) -> None:
    """Specification, usage_count, sft_codes, finish_codes (first five + '...')."""
    write_csv(catalogue_csv(catalogue), path)
