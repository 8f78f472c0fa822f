"""CSV contract reader (S1-S8, X11 companion).

Every column is read as text with the header's names (order free), then normalized:
missing values become '' (S5), whitespace is stripped (F1), required columns are
checked before any action (S6), absent optional columns are added with a default
(S7), an aliased column is picked by presence (S8), typed columns are ``try_cast``
(S2: a non-blank value that does not cast is a reject, a blank one is NULL, D6).

Over-long rows (more fields than the header, S4) are detected with one spare column
plus the corrupt-record column and reported; short rows are kept (padded with NULL).
Each row carries its file order (block start, then a monotonically increasing id) so
last-write-wins can respect file order (H2).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.columns import strip_or_empty, strip_ws
from tessera.schemas import Contract
from tessera.sources import fs

# The cell texts a pandas CSV read treats as missing by default (D11);
# the reference reads every file that way, so such a cell ends up blank.
NA_WORDS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
            "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]

OVERFLOW = "_overflow"
CORRUPT = "_corrupt_record"


class ContractError(ValueError):
    """Raised when a file lacks required columns."""


@dataclass
class Scan:
    """Result of a contract scan: normalized rows, rows dropped as too long, cast rejects,
    and ``counts``: one lazy row (rows, too_long, rejects) computed in a single pass."""
    rows: DataFrame
    too_long: DataFrame
    cast_rejects: DataFrame
    columns: list[str]
    counts: DataFrame


def header(spark: SparkSession, path: str) -> list[str]:
    """Header names, parsed with CSV quoting from the file's first line (read through the
    filesystem, not a Spark job; a UTF-8 BOM is dropped, S3)."""
    import csv as _csv
    line = fs.first_line(spark, path)
    if line is None:
        return []
    return [c.strip() for c in next(_csv.reader([line]))]


def read_csv_text(spark: SparkSession, path: str, multiline: bool = False) -> tuple[DataFrame, list[str]]:
    """S1 + S4: all columns as strings, named by the header, plus ``_too_long`` and a
    file-order column ``_order``."""
    # Malformed-row detection needs every row fully tokenized; with CSV column pruning
    # a count() would parse only the spare columns and flag every row.
    names = header(spark, path)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names]
                          + [T.StructField(OVERFLOW, T.StringType()), T.StructField(CORRUPT, T.StringType())])
    df = (spark.read.schema(schema).option("header", True).option("enforceSchema", True)
          .option("escape", '"').option("columnPruning", False).option("multiLine", multiline).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", CORRUPT).csv(path))
    too_long = F.col(OVERFLOW).isNotNull() | F.col(CORRUPT).isNull()
    order = F.struct(F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    # Raw text of the record (a row with exactly one extra field is not flagged as
    # corrupt, so its fields are joined back).
    raw = F.coalesce(F.col(CORRUPT), F.concat_ws(",", *[F.col(n) for n in names], F.col(OVERFLOW)))
    df = df.select(*[F.col(n) for n in names], too_long.alias("_too_long"), order.alias("_order"), raw.alias("_raw"))
    return df, names


def scan(spark: SparkSession, path: str, contract: Contract, multiline: bool = False,
         na_words: list[str] | None = None) -> Scan:
    """Read ``path`` under ``contract``; raise ``ContractError`` naming missing columns.

    Cells equal to one of ``na_words`` (default ``NA_WORDS``; pass ``[]`` to keep them)
    count as missing and become ''.
    """
    na = NA_WORDS if na_words is None else na_words
    raw, names = read_csv_text(spark, path, multiline)
    present = set(names)
    missing = [c for c in contract.required if c not in present]
    if missing:
        raise ContractError(f"Missing required columns in {path}: {missing}")
    cols = []
    for c in contract.required + contract.optional:
        src = c
        if c in contract.aliases:
            src = next((a for a in contract.aliases[c] if a in present), None)
        if src is not None and src in present:
            v = F.col(src)
            if na:
                v = F.when(v.isin(na), F.lit(None)).otherwise(v)
            cols.append(strip_or_empty(v).alias(c))
        else:
            cols.append(F.lit("").alias(c))
    df = raw.select(*cols, "_too_long", "_order", "_raw")
    too_long = df.filter("_too_long").select("_order", "_raw")
    everything = df
    df = df.filter(~F.col("_too_long"))
    rejects = None
    any_bad = F.lit(False)
    for c, typ in contract.typed.items():
        cast = F.when(F.col(c) == "", F.lit(None).cast(typ)).otherwise(F.col(c).try_cast(typ))
        # A blank required value is a reject too; a blank optional value is NULL.
        bad_when = cast.isNull() if c in contract.required else ((F.col(c) != "") & cast.isNull())
        any_bad = any_bad | bad_when
        bad = df.filter(bad_when).select(F.lit(c).alias("column"), F.col(c).alias("value"), "_order")
        rejects = bad if rejects is None else rejects.unionByName(bad)
        df = df.withColumn(c, cast)
    if rejects is None:
        rejects = spark.createDataFrame([], "column string, value string, _order struct<b:long,i:long>")
    ok = ~F.col("_too_long")
    counts = everything.agg(F.count_if(ok).cast("long").alias("rows"),
                            F.count_if(F.col("_too_long")).cast("long").alias("too_long"),
                            F.count_if(ok & any_bad).cast("long").alias("rejects"))
    return Scan(df.drop("_too_long", "_raw"), too_long, rejects, list(contract.required + contract.optional), counts)


def odd_quote_file_lines(spark: SparkSession, path: str) -> DataFrame:
    """X11 on a text file: lines (after the header) with an odd number of double quotes."""
    lines = spark.read.text(path)  # by lines, so a file of any size is split over tasks
    n_quotes = F.length("value") - F.length(F.regexp_replace("value", '"', ""))
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                         F.monotonically_increasing_id().alias("id"), F.col("value").alias("line"),
                         n_quotes.alias("n_quotes"))
    # Ids rise by one within a block; a block's first line number is what the blocks before hold.
    blocks = lines.groupBy("file", "block").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    odd = lines.filter(F.col("n_quotes") % 2 == 1).join(blocks, ["file", "block"])
    return odd.select(F.element_at(F.split("file", "/"), -1).alias("name"),
                      (F.col("before") + F.col("id") - F.col("first_id") + 1).alias("line_no"), "n_quotes",
                      "line").filter(F.col("line_no") > 1)
