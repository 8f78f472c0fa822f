"""Text extraction and enrichment jobs over a document table.

The reference runs these as per-row Python helpers over one file; here each is a
DataFrame job: row-local regex expressions for extraction and segmentation (no shuffle),
and explode -> join -> regroup for dictionary enrichment, where the regroup key is the
original row id (a group is never larger than the row it came from).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import collapse_ws, split_keep_blanks, strip_ws
from tessera.functions.text import CODE_TOKEN, STEP_TOKEN, code_parts, extract_specs, segments
from tessera.operators.joins import hot_keys, salt, salted
from tessera.operators.upsert import latest_by_key


def extract_spec_column(df: DataFrame, text_col: str = "description", out_col: str = "associated_specs",
                        prefixes: list[str] | None = None, bound: str = "unicode") -> DataFrame:
    """Add ``out_col`` = comma-joined X1 specifications of ``text_col``
    (empty for a NULL text)."""
    return df.withColumn(out_col, F.array_join(extract_specs(F.coalesce(F.col(text_col), F.lit("")), prefixes, bound), ","))


def segment_documents(df: DataFrame, id_cols: Sequence[str], text_col: str, anchor: str = CODE_TOKEN,
                      step_pattern: str = STEP_TOKEN, clean: bool = False) -> DataFrame:
    """X4-X7 (+ U4): one row per anchored segment of each document.

    Columns: id columns, seg_no (1-based), finish_code (the anchor token), its parts
    (substrate_code, finish_applied_code, seq_id), finish_code_description (text before
    the first step token, whitespace collapsed; whole block when none) and sft_steps
    (sorted unique step tokens) with its JSON text.

    ``clean=True`` first collapses whitespace of the input (the reference feeds text that
    has been through ``clean_rtf``).
    """
    text = collapse_ws(F.col(text_col)) if clean else F.col(text_col)
    seg = df.select(*id_cols, F.posexplode(segments(text, anchor)).alias("_i", "_piece"))
    code = F.regexp_extract(F.col("_piece"), rf"^({anchor})", 1)
    seg = seg.select(*id_cols, (F.col("_i") + 1).alias("seg_no"), code.alias("finish_code"), "_piece")
    block = strip_ws(F.substring(F.col("_piece"), F.length(F.col("finish_code")) + 1, 1 << 30))
    seg = seg.select(*id_cols, "seg_no", "finish_code", block.alias("_block"))
    pos = F.regexp_instr(F.col("_block"), F.lit(step_pattern))
    desc = F.when(pos > 0, strip_ws(F.substring(F.col("_block"), 1, pos - 1))).otherwise(F.col("_block"))
    steps = F.array_sort(F.array_distinct(F.regexp_extract_all(F.col("_block"), F.lit(step_pattern), 0)))
    parts = code_parts(F.col("finish_code"))
    return seg.select(*id_cols, "seg_no", "finish_code", parts["substrate"].alias("substrate_code"),
                      parts["finish_applied"].alias("finish_applied_code"), parts["seq"].alias("seq_id"),
                      F.regexp_replace(desc, r"\s+", " ").alias("finish_code_description"),
                      steps.alias("sft_steps"), _py_json_list(steps).alias("sft_steps_json"))


def _py_json_list(arr) -> F.Column:
    """JSON text of a string array with ', ' between elements (Python's default
    separator, which the reference's output files use)."""
    return F.regexp_replace(F.to_json(arr), '","', '", "')


def spec_type_map(types: DataFrame, spec_col: str = "specification", type_col: str = "Type / Class / Grade",
                  order: Sequence[str] | None = None) -> DataFrame:
    """Dictionary spec -> full spec ('spec type'), or spec itself when the type is
    blank or '-'. A repeated spec keeps its last row (``order`` columns, W1)."""
    spec = strip_ws(F.col(spec_col))
    typ = strip_ws(F.coalesce(F.col(type_col), F.lit("")))
    full = F.when((typ != "") & (typ != "-"), F.concat(spec, F.lit(" "), typ)).otherwise(spec)
    d = types.select(spec.alias("spec"), full.alias("full"), *[F.col(o) for o in (order or [])])
    if order:
        return latest_by_key(d, ["spec"], list(order)).select("spec", "full")
    return d.groupBy("spec").agg(F.max("full").alias("full"))


def enrich_lists(df: DataFrame, id_cols: Sequence[str], field: str, mapping: DataFrame,
                 out_col: str = "enriched") -> DataFrame:
    """Replace each comma-list element found in ``mapping`` (spec -> full).

    Elements are stripped and kept in order, unknown and blank elements stay; a NULL or
    blank field is returned unchanged. Returns id columns, ``out_col``, ``n_replaced``
    and ``changed`` (X10: the new text differs from the old).

    One scan, one explode: per-row flags and the element array are computed in a
    projection before the generator, so only ids, small flags and single elements travel
    with exploded rows (never the whole text). Hot elements are joined to the dictionary by
    salted keys (an aggregated dictionary keeps AQE from splitting the join itself); all are
    regrouped by row id - a group is one input row.
    """
    blank = F.col(field).isNull() | (strip_ws(F.col(field)) == "")
    parts = split_keep_blanks(F.col(field))
    pre = df.select(*id_cols, blank.alias("_blank"), F.when(blank, F.col(field)).alias("_keep"),
                    F.when(~blank, parts).alias("_parts"), F.col(field).alias("_f0"))
    # is the text already in stripped, comma-joined form? (row-local, before the explode)
    pre = pre.select(*id_cols, "_blank", "_keep", "_parts",
                     F.coalesce(F.col("_f0") == F.array_join("_parts", ","), F.lit(True)).alias("_norm"))
    ex = pre.select(*id_cols, "_blank", "_keep", "_norm", F.posexplode_outer("_parts").alias("_p", "_e"))
    # A hot element is dealt over several keys by its row, and its dictionary row is repeated for
    # each. Blank elements find nothing: as rows without a key they are one hot key at most.
    ex = ex.withColumn("_key", F.when(F.col("_e") != "", F.col("_e")))
    hot = hot_keys(ex, F.col("_key"))
    ex = ex.withColumn("_salt", salt(ex, hot, F.col("_key"), *id_cols, "_p"))
    m = salted(mapping.select(F.col("spec").alias("_key"), F.col("full").alias("_f")).filter(F.col("_key") != ""),
               hot, F.col("_key"))
    j = ex.join(m, ["_key", "_salt"], "left")
    val = F.coalesce(F.col("_f"), F.col("_e"))
    item = F.when(F.col("_p").isNotNull(), F.struct(F.col("_p"), val.alias("_v")))
    g = j.groupBy(*id_cols).agg(F.array_sort(F.collect_list(item)).alias("_a"),
                                F.count_if(F.col("_f").isNotNull() & (F.col("_f") != F.col("_e"))).alias("_n"),
                                F.min("_norm").alias("_norm"), F.max("_blank").alias("_blank"),
                                F.max("_keep").alias("_keep"))
    joined = F.array_join(F.transform("_a", lambda x: x["_v"]), ",")
    return g.select(*id_cols,
                    F.when(F.col("_blank"), F.col("_keep")).otherwise(joined).alias(out_col),
                    F.col("_n").cast("long").alias("n_replaced"),
                    (~F.col("_blank") & ((F.col("_n") > 0) | ~F.col("_norm"))).alias("changed"))


def changed_rows(enriched: DataFrame) -> DataFrame:
    """Rows whose enriched value differs from the original."""
    return enriched.filter(F.col("changed"))


def quote_counts(df: DataFrame, id_cols: Sequence[str], text_col: str) -> DataFrame:
    """X11 core: every line with its 1-based number and number of double quotes."""
    lines = df.select(*id_cols, F.posexplode(F.split(F.col(text_col), r"\r\n|\r|\n")).alias("_i", "line"))
    n = F.length("line") - F.length(F.regexp_replace("line", '"', ""))
    return lines.select(*id_cols, (F.col("_i") + 1).alias("line_no"), n.alias("n_quotes"), "line")


def quote_profile(df: DataFrame, id_cols: Sequence[str], text_col: str) -> DataFrame:
    """X11 per row, row-local (no shuffle): number of lines, of double quotes, and of
    lines holding an odd number of quotes."""
    lines = F.split(F.col(text_col), r"\r\n|\r|\n")
    per_line = F.transform(lines, lambda l: F.length(l) - F.length(F.regexp_replace(l, '"', "")))
    n_quotes = F.length(F.col(text_col)) - F.length(F.regexp_replace(F.col(text_col), '"', ""))
    return df.select(*id_cols, F.size(lines).cast("long").alias("n_lines"), n_quotes.cast("long").alias("n_quotes"),
                     F.size(F.filter(per_line, lambda n: n % 2 == 1)).cast("long").alias("n_odd_lines"))


def odd_quote_lines(df: DataFrame, id_cols: Sequence[str], text_col: str, skip_header: bool = False) -> DataFrame:
    """X11: lines holding an odd number of double quotes, with 1-based line numbers."""
    out = quote_counts(df, id_cols, text_col)
    if skip_header:
        out = out.filter(F.col("line_no") > 1)
    return out.filter(F.col("n_quotes") % 2 == 1)
