"""Whole trees at code grain (Q1, A11, S14), streamed: no code's tree is ever an array or one row.

A tree is laid out as rows - its header, steps, materials and chemicals - that are dealt out by code and sorted within
their partition in the order of the document (Spark's sort spills). One pass then writes the JSON text, or a digest, row
by row: a task holds one batch, whether a code has ten rows or ten million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import hierarchy as H

#: Columns that order a tree's rows; those below a row's own level are NULL, so a parent comes before its children.
ORDER = ["step_order", "sft_code", "base_spec", "variant", "copy", "hazard_rank", "name", "cas"]

#: What each level's list of children is called.
CHILDREN = ("steps", "materials", "chemicals")


def _json(*cols) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def tree_rows(t: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of all trees, in order within a partition: ``finish_code``, ``program``, ``ORDER``, ``kind`` (0 header, 1
    step, 2 material, 3 chemical) and ``body``, the row's own fields as a JSON object. A material that is linked to a
    step several times is there as often (``copy``)."""
    head = H.code_headers(t)
    heads = head.select("finish_code", "program", F.lit(0).alias("kind"),
                        _json(*[c for c in head.columns]).alias("body"))
    st = t["sft_steps"]
    steps = (t["finish_code_steps"].select("finish_code", "program", "sft_code", "step_order")
             .join(head.select("finish_code", "program"), ["finish_code", "program"], "left_semi").join(st, "sft_code"))
    step = steps.select("finish_code", "program", "step_order", "sft_code", F.lit(1).alias("kind"),
                        _json("sft_code", "step_order", "parent_group", "description", "associated_specs",
                              "source_doc", "last_review", "notes").alias("body"))
    links = t["sft_material_links"].groupBy("sft_code", "base_spec", "variant").agg(F.count(F.lit(1)).alias("n"))
    m = t["materials"].select(F.col("base_spec").alias("_b"), F.col("variant").alias("_v"), "description", "notes")
    mats = (links.join(m, (F.col("base_spec") == F.col("_b")) & F.col("variant").eqNullSafe(F.col("_v")))
            .select("sft_code", "base_spec", "variant", _json("base_spec", "variant", "description", "notes")
                    .alias("body"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy")))
    mats = step.drop("kind", "body").join(mats, "sft_code").withColumn("kind", F.lit(2))
    parsed, valid = H.parsed_hazard(F.col("hazard_flags"))
    ch = t["chemicals"].select("cas", "name", parsed.alias("_p"), valid.alias("hazard_flags_valid"),
                               F.col("hazard_flags").alias("hazard_flags_raw"), "default_hazard_level")
    comp = t["material_chemicals"].join(ch, "cas").select(
        F.col("base_spec").alias("_b"), F.col("variant").alias("_v"),
        H.hazard_level_key(F.col("default_hazard_level"), F.col("name"))["k1"].alias("hazard_rank"), "name", "cas",
        _json("name", "cas", "pct_wt_low", "pct_wt_high", F.col("_p").alias("hazard_flags"), "hazard_flags_valid",
              "hazard_flags_raw", "default_hazard_level", F.col("notes").alias("composition_notes")).alias("body"))
    chems = (mats.drop("kind", "body")
             .join(comp, (F.col("base_spec") == F.col("_b")) & F.col("variant").eqNullSafe(F.col("_v")))
             .drop("_b", "_v").withColumn("kind", F.lit(3)))
    out = heads
    for part in (step, mats, chems):
        out = out.unionByName(part, allowMissingColumns=True)
    return (out.select("finish_code", "program", *ORDER, "kind", "body").repartition("finish_code", "program")
            .sortWithinPartitions("finish_code", "program", *ORDER, "kind"))


def json_pieces(rows: DataFrame) -> DataFrame:
    """``value``: lines of text, which in a partition's order are one JSON document per code after another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        depth, fresh = 0, True  # open lists, and whether the innermost is still empty
        for batch in batches:
            lines = []
            for kind, body in zip(batch.column("kind").to_pylist(), batch.column("body").to_pylist()):
                closing = "]}" * max(0, depth - kind)
                comma = "," if kind and (closing or not fresh) else ""
                if kind < len(CHILDREN):
                    body = f'{body[:-1]},"{CHILDREN[kind]}":['
                    depth, fresh = kind + 1, True
                else:
                    fresh = False
                if closing and not kind:
                    lines.append(closing)
                    closing = ""
                lines.append(closing + comma + body)
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["value"])
        if depth:
            yield pa.RecordBatch.from_arrays([pa.array(["]}" * depth])], ["value"])

    return rows.select("kind", "body").mapInArrow(run, "value string")


def write_trees(t: Mapping[str, DataFrame], path: str) -> None:
    """All trees as JSON text files; a code's document is in one file, on as many lines as its tree has rows."""
    json_pieces(tree_rows(t)).write.mode("overwrite").text(path)


def tree_digests(rows: DataFrame, line: Column) -> DataFrame:
    """One row per code: ``finish_code``, its number of steps, materials and chemicals, and the sha256 of its rows'
    ``line`` texts, each ended by a line feed, in the order of the document."""
    kind = rows.schema["finish_code"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, digest, count = None, None, None

        def closed(done: list) -> pa.RecordBatch:
            cols = list(zip(*done)) or [()] * 5
            arrays = [pa.array(cols[0], code_type), *(pa.array(c, pa.int64()) for c in cols[1:4]),
                      pa.array(cols[4], pa.string())]
            return pa.RecordBatch.from_arrays(arrays, ["finish_code", "n_steps", "n_materials", "n_chemicals",
                                                       "tree_sha"])

        for batch in batches:
            code_type, done = batch.column("finish_code").type, []
            for c, k, text in zip(*(batch.column(x).to_pylist() for x in ("finish_code", "kind", "line"))):
                if k == 0:
                    if digest:
                        done.append((code, *count[1:], digest.hexdigest()))
                    code, digest, count = c, hashlib.sha256(), [0] * 4
                count[k] += 1
                digest.update(text.encode() + b"\n")
            yield closed(done)
        if digest:
            yield closed([(code, *count[1:], digest.hexdigest())])

    return rows.select("finish_code", "kind", line.alias("line")).mapInArrow(
        run, f"finish_code {kind}, n_steps long, n_materials long, n_chemicals long, tree_sha string")
