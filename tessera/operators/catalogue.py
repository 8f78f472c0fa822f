"""Specification catalogue and per-code specification lists.

The catalogue is one explode and join for all specifications at once, in two forms: complete
exploded rows with counts, in which no specification's lists gather in one task, and
``catalogue_lists``, the full sorted arrays (the reference's document form), for tables whose
groups are known to be small.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import first_k_with_ellipsis, split_list, strip_ws, truncate_text


def spec_items(steps: DataFrame, step_col: str = "sft_code", spec_col: str = "associated_specs") -> DataFrame:
    """A4 + F4: distinct (step, spec) pairs from non-blank comma lists."""
    s = steps.filter(F.col(spec_col).isNotNull() & (F.col(spec_col) != ""))
    return (s.select(F.col(step_col).alias("step"), F.explode(split_list(F.col(spec_col))).alias("spec"))
             .distinct())


def spec_catalogue(steps: DataFrame, code_steps: DataFrame, step_col: str = "sft_code",
                   spec_col: str = "associated_specs", code_col: str = "finish_code") -> DataFrame:
    """Q4 in exploded form, complete: distinct (spec, kind, value) rows, kind ``step`` for a step
    that lists the specification and ``code`` for a code that reaches it through its steps."""
    items = spec_items(steps, step_col, spec_col)
    cs = code_steps.select(F.col(step_col).alias("step"), F.col(code_col).alias("code")).distinct()
    reached = items.join(cs, "step").select("spec", F.lit("code").alias("kind"), F.col("code").cast("string").alias("value"))
    listed = items.select("spec", F.lit("step").alias("kind"), F.col("step").cast("string").alias("value"))
    return listed.unionByName(reached.filter(F.col("value").isNotNull()).distinct())


def spec_usage(steps: DataFrame, code_steps: DataFrame, step_col: str = "sft_code",
               spec_col: str = "associated_specs", code_col: str = "finish_code") -> DataFrame:
    """Q4 counts: per specification ``usage_count`` (distinct codes reaching it; 0 stays, A6) and
    ``step_count`` (distinct steps listing it), by usage descending and then spec (O5). The rows
    of ``spec_catalogue`` are distinct, so both are partial aggregates."""
    rows = spec_catalogue(steps, code_steps, step_col, spec_col, code_col)
    return (rows.groupBy("spec").agg(F.count_if(F.col("kind") == "code").alias("usage_count"),
                                     F.count_if(F.col("kind") == "step").alias("step_count"))
            .orderBy(F.desc("usage_count"), F.asc("spec")))


def catalogue_lists(steps: DataFrame, code_steps: DataFrame, step_col: str = "sft_code",
                    spec_col: str = "associated_specs", code_col: str = "finish_code") -> DataFrame:
    """Q4 document form: spec, sorted sft_codes, sorted finish_codes, usage_count.

    Collects whole groups; meant for reference-sized tables.
    """
    items = spec_items(steps, step_col, spec_col)
    cs = code_steps.select(F.col(step_col).alias("step"), F.col(code_col).alias("code")).distinct()
    usage = items.join(cs, "step", "left")
    return (usage.groupBy("spec").agg(F.array_sort(F.collect_set("step")).alias("sft_codes"),
                                      F.array_sort(F.collect_set("code")).alias("finish_codes"))
            .select("spec", "sft_codes", "finish_codes", F.size("finish_codes").alias("usage_count"))
            .orderBy(F.desc("usage_count"), F.asc("spec")))


def total_specs(steps: DataFrame, step_col: str = "sft_code", spec_col: str = "associated_specs") -> DataFrame:
    """Number of distinct specifications."""
    return spec_items(steps, step_col, spec_col).agg(F.count_distinct("spec").alias("total_specs"))


def catalogue_csv(catalogue: DataFrame) -> DataFrame:
    """S15 row shape, from ``catalogue_lists``: specification, usage_count, every step code
    ';'-joined, and the first five finish codes plus '...' when there are more."""
    return catalogue.select(F.col("spec").alias("specification"), "usage_count",
                            F.array_join("sft_codes", ";").alias("sft_codes"),
                            first_k_with_ellipsis(F.col("finish_codes"), 5, ";").alias("finish_codes"))


def code_spec_rows(steps: DataFrame, code_steps: DataFrame, step_col: str = "sft_code",
                   spec_col: str = "associated_specs", desc_col: str = "description",
                   code_col: str = "finish_code", order_col: str = "step_order", width: int = 80) -> DataFrame:
    """Q5 rows: one per (code, step with specs): code, sft_code, step_order, associated_specs
    (stripped), associated_specs_list, description (truncated to ``width``: 77 chars + '...').
    One join by step; the lists are row-local."""
    s = steps.filter(F.col(spec_col).isNotNull() & (strip_ws(F.col(spec_col)) != ""))
    cs = code_steps.select(F.col(code_col).alias("code"), F.col(step_col).alias("step"), F.col(order_col))
    j = cs.join(s.select(F.col(step_col).alias("step"), F.col(spec_col).alias("_specs"), F.col(desc_col).alias("_d")),
                "step")
    return j.select("code", F.col("step").alias("sft_code"), F.col(order_col).alias("step_order"),
                    strip_ws(F.col("_specs")).alias("associated_specs"),
                    split_list(F.col("_specs")).alias("associated_specs_list"),
                    truncate_text(F.col("_d"), width).alias("description"))


def code_spec_list(rows: DataFrame) -> DataFrame:
    """Q5 / U2 as rows: the distinct (code, spec) pairs of ``code_spec_rows``."""
    return rows.select("code", F.explode("associated_specs_list").alias("spec")).distinct()


def code_specs(steps: DataFrame, code_steps: DataFrame, step_col: str = "sft_code",
               spec_col: str = "associated_specs", desc_col: str = "description",
               code_col: str = "finish_code", order_col: str = "step_order", width: int = 80) -> DataFrame:
    """Q5 for all codes: ``code_spec_rows`` with the code-level spec_count (distinct specs over all
    the code's steps)."""
    rows = code_spec_rows(steps, code_steps, step_col, spec_col, desc_col, code_col, order_col, width)
    counts = code_spec_list(rows).groupBy("code").agg(F.count(F.lit(1)).alias("spec_count"))
    return rows.join(counts, "code", "left")


def code_spec_sets(code_specs_rows: DataFrame) -> DataFrame:
    """Q5 document form: per code, the sorted unique specifications (U2 + O6)."""
    return (code_specs_rows.select("code", F.explode("associated_specs_list").alias("spec"))
            .groupBy("code").agg(F.array_sort(F.collect_set("spec")).alias("specifications"))
            .select("code", "specifications", F.size("specifications").alias("spec_count")))


def code_specs_lookup(t: dict, requested: DataFrame, available_k: int = 10) -> DataFrame:
    """Q5 for a request list (column ``code``): per requested code its sorted unique
    specifications and count, or ``error`` plus the first codes when it is unknown.
    The per-step rows are ``code_specs`` filtered to the same codes."""
    from tessera.operators.hierarchy import available_codes
    req = requested.select(F.col("code").alias("requested")).distinct()
    codes = t["finish_codes"].select(F.col("code").alias("_c")).distinct()
    cs = t["finish_code_steps"].join(req, F.col("finish_code") == F.col("requested"), "left_semi")
    sets = code_spec_sets(code_specs(t["sft_steps"], cs))
    j = req.join(codes, req["requested"] == codes["_c"], "left").join(sets, F.col("requested") == F.col("code"), "left")
    missing = F.col("_c").isNull()
    return j.select("requested", F.when(missing, F.lit("Finish code not found")).alias("error"),
                    F.when(missing, available_codes(t, available_k)).alias("available_codes"),
                    F.when(~missing, F.coalesce("specifications", F.array().cast("array<string>")))
                    .alias("specifications"),
                    F.when(~missing, F.coalesce("spec_count", F.lit(0))).alias("spec_count"))
