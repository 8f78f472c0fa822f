"""One-call jobs for the reference's three text scripts, built from the operators.

* ``finish_codes_from_rtf``: an RTF specification -> one row per finish code with its
  parts, description and JSON step list (X3-X7), in the column layout of the
  finish-codes input file.
* ``with_extracted_specs``: a steps table -> its ``associated_specs`` column recomputed
  from the descriptions (X1, X2).
* ``enrich_step_specs``: a steps table and a spec-type table -> the steps with typed
  specifications, plus the changed rows (X8-X10).
Write the results with ``tessera.sources.sinks.write_csv`` to a new path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import clean_rtf
from tessera.operators import textjobs as X
from tessera.sources.files import whole_text


def finish_codes_from_rtf(spark: SparkSession, path: str) -> DataFrame:
    docs = whole_text(spark, path).select("name", clean_rtf("text").alias("t"))
    seg = X.segment_documents(docs, ["name"], "t")
    return seg.select("finish_code", "substrate_code", "finish_applied_code", "seq_id", "finish_code_description",
                      F.col("sft_steps_json").alias("sft_steps"))


def with_extracted_specs(steps: DataFrame, text_col: str = "description") -> DataFrame:
    return X.extract_spec_column(steps, text_col, "associated_specs")


def enrich_step_specs(steps: DataFrame, spec_types: DataFrame, key: str = "sft_code",
                      field: str = "associated_specs") -> tuple[DataFrame, DataFrame]:
    """Returns (steps with ``field`` enriched, changed rows: key, old, new)."""
    mapping = X.spec_type_map(spec_types)
    enr = X.enrich_lists(steps, [key], field, mapping, out_col="_new")
    out = steps.join(enr.select(key, "_new"), key, "left") \
        .select(*[F.col("_new").alias(c) if c == field else F.col(c) for c in steps.columns])
    changed = X.changed_rows(enr).join(steps.select(key, F.col(field).alias("old")), key) \
        .select(key, "old", F.col("_new").alias("new"))
    return out, changed
