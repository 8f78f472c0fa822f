"""Domain ingest (S9-S13, J7-J11, W1-W3, Q13) and audit entry (Q14).

Order-independent (D1): all files are scanned first; parent tables are upserted, then
child rows are resolved against the *new* parent snapshots. Each file is atomic (D5):
if it has a contract error, a cast reject, a strict resolution reject or invalid JSON
hazard text, none of its rows is published and the previous snapshot of its table is
kept. Keyed tables are upserted last-write-wins (current rows, then this run's rows
in file order); link tables are replaced per source file (D4), so a re-ingest is
idempotent.

Every run writes a complete snapshot under ``out_dir/<table>`` (parquet) and reads it
back, which also cuts lineage before the audit. Only per-file facts (nine rows) reach
the driver, to build the run report.
"""

from __future__ import annotations

import datetime as _dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import blank_to_null, digits_or_zero, json_is_valid, strip_ws
from tessera.operators import audit as A
from tessera.operators.joins import resolve
from tessera.operators.upsert import list_positions, upsert
from tessera.schemas import COLUMNS, CONTRACTS, DDL, KEYS, domain_rules
from tessera.sources import fs
from tessera.sources.csv import ContractError, scan
from tessera.sources.files import file_hashes

LOAD_ORDER = [c.file for c in CONTRACTS]


@dataclass
class IngestResult:
    tables: dict[str, DataFrame]
    files: DataFrame      # source_name, status, rows, sha256, error
    warnings: DataFrame   # source_name, row_key, reason
    issues: DataFrame     # audit issues (ISSUE_COLUMNS)
    report: DataFrame     # one row: status, files_loaded, files_failed, audit fields, timestamp
    status: str


def _empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], DDL[table])


def read_snapshot(spark: SparkSession, snap_dir: str | None) -> dict[str, DataFrame]:
    """Published tables of a snapshot directory (empty tables when absent)."""
    out = {}
    for t in DDL:
        p = f"{snap_dir}/{t}" if snap_dir else None
        out[t] = spark.read.parquet(p) if p and fs.exists(spark, p) else _empty(spark, t)
    return out


def _with_created(df: DataFrame, ts) -> DataFrame:
    return df.withColumn("created_at", F.lit(ts).cast("timestamp"))


def _ord(df: DataFrame, seq: int) -> DataFrame:
    """Attach (load sequence, file block, row id) as upsert order columns."""
    return df.select("*", F.lit(seq).alias("_s"), F.col("_order.b").alias("_b"), F.col("_order.i").alias("_i")) \
        .drop("_order")


def _prev_ord(df: DataFrame) -> DataFrame:
    return df.select("*", F.lit(0).alias("_s"), F.lit(0).cast("long").alias("_b"), F.lit(0).cast("long").alias("_i"))


def _upsert(prev: DataFrame, incoming: DataFrame, table: str) -> DataFrame:
    cols = COLUMNS[table]
    merged = upsert(_prev_ord(prev.select(*cols)), incoming.select(*cols, "_s", "_b", "_i"), KEYS[table],
                    ["_s", "_b", "_i"], created_col="created_at")
    return merged.select(*cols)


def ingest(spark: SparkSession, in_dir: str, out_dir: str, prev_dir: str | None = None,
           run_ts: _dt.datetime | None = None, multiline: bool = False) -> IngestResult:
    """Q13: ingest the nine CSVs of ``in_dir`` on top of snapshot ``prev_dir`` and publish
    the new snapshot to ``out_dir``."""
    if prev_dir and fs.qualified(spark, prev_dir) == fs.qualified(spark, out_dir):
        raise ValueError("out_dir must be a new snapshot directory, not the previous one")
    run_ts = run_ts or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
    prev = read_snapshot(spark, prev_dir)
    new = dict(prev)
    facts: dict[str, dict] = {}
    warnings: list[DataFrame] = []
    scans = {}
    for c in CONTRACTS:
        path = fs.join(in_dir, c.file)
        if not fs.exists(spark, path):
            facts[c.file] = {"status": "failed", "error": "File not found", "rows": None}
            continue
        try:
            s = scan(spark, path, c, multiline)
        except ContractError as e:
            facts[c.file] = {"status": "failed", "error": str(e), "rows": None}
            continue
        scans[c.file] = s
        cnt = s.counts.first()  # one pass: rows read, over-long rows, cast rejects
        facts[c.file] = {"status": "loaded", "error": None, "rows": cnt["rows"]}
        if cnt["rejects"]:
            facts[c.file].update(status="failed", error=f"{cnt['rejects']} values do not cast to the column type")
        if cnt["too_long"]:
            warnings.append(s.too_long.select(F.lit(c.file).alias("source_name"),
                                              F.col("_raw").alias("row_key"), F.lit("too_many_fields").alias("reason")))

    def ok(f):
        return f in scans and facts[f]["status"] == "loaded"

    def fail(f, msg):
        facts[f].update(status="failed", error=msg)

    # Parents first: plain keyed upserts.
    if ok("substrates.csv"):
        r = scans["substrates.csv"].rows
        new["substrates"] = _upsert(prev["substrates"], _ord(_with_created(r, run_ts), 1), "substrates")
    if ok("finish_applied.csv"):
        r = scans["finish_applied.csv"].rows
        new["finish_applied"] = _upsert(prev["finish_applied"], _ord(_with_created(r, run_ts), 1), "finish_applied")
    if ok("sft_steps.csv"):
        r = scans["sft_steps.csv"].rows
        for col in ("parent_group", "associated_specs", "source_doc", "last_review", "notes"):
            r = r.withColumn(col, blank_to_null(col))
        new["sft_steps"] = _upsert(prev["sft_steps"], _ord(_with_created(r, run_ts), 1), "sft_steps")
    if ok("materials_map.csv"):
        r = scans["materials_map.csv"].rows.withColumn("variant", blank_to_null("variant"))
        new["materials"] = _upsert(prev["materials"], _ord(_with_created(r, run_ts), 1), "materials")
    if ok("chemicals.csv"):
        r = scans["chemicals.csv"].rows.withColumn("cas", blank_to_null("cas")) \
            .withColumn("hazard_flags", blank_to_null("hazard_flags"))
        bad_json = r.filter(F.col("hazard_flags").isNotNull() & ~json_is_valid("hazard_flags")).count()
        if bad_json:
            fail("chemicals.csv", f"{bad_json} rows have invalid JSON in hazard_flags")
        else:
            r = r.withColumn("chem_key", F.coalesce(F.col("cas"), F.concat(F.lit("name:"), F.col("name"))))
            new["chemicals"] = _upsert(prev["chemicals"], _ord(_with_created(r, run_ts), 1), "chemicals")

    # Persist parents so children resolve against materialized snapshots.
    for t in ("substrates", "finish_applied", "sft_steps", "materials", "chemicals"):
        new[t] = _publish(spark, new[t], out_dir, t)

    # finish_codes: strict dimension resolution by (code, program).
    fcs_embedded = None
    if ok("finish_codes.csv"):
        r = scans["finish_codes.csv"].rows
        r = r.select(F.col("finish_code").alias("code"), "program", "substrate_code", "finish_applied_code",
                     digits_or_zero("seq_id").alias("seq_id"), "description", "notes", "source_doc",
                     "associated_specs", "sft_steps", "_order")
        r1, rej1 = resolve(r, new["substrates"], [("substrate_code", "code"), ("program", "program")],
                           row_key=["code", "program"])
        r2, rej2 = resolve(r1, new["finish_applied"], [("finish_applied_code", "code"), ("program", "program")],
                           row_key=["code", "program"])
        n_rej = _count(rej1, rej2)
        if n_rej:
            fail("finish_codes.csv", f"{n_rej} rows reference unknown substrate or finish_applied codes")
        else:
            new["finish_codes"] = _upsert(prev["finish_codes"], _ord(_with_created(r2, run_ts), 1), "finish_codes")
            # Embedded ordered step lists (F9, W2, W3), resolved leniently.
            emb = r2.filter((strip_ws("sft_steps") != "") & (strip_ws("sft_steps") != "[]"))
            # Every row's list is applied in file order: per (code, step) the latest row,
            # and within a list the last position, wins (W3); steps of an earlier row that
            # a later row does not repeat stay.
            pos = list_positions(emb, "sft_steps", ["code", "program", "_order"], "sft_code", "pos")
            pos = pos.groupBy("code", "program", "sft_code").agg(
                F.max_by("pos", F.struct("_order", "pos")).alias("pos"), F.max("_order").alias("_order"))
            good, missing = resolve(pos, new["sft_steps"], [("sft_code", "sft_code")], row_key=["code", "sft_code"])
            warnings.append(missing.select(F.lit("finish_codes.csv").alias("source_name"), "row_key",
                                           F.lit("unknown_step_skipped").alias("reason")))
            fcs_embedded = good.select(F.col("code").alias("finish_code"), "program", "sft_code",
                                       F.col("pos").cast("int").alias("step_order"), "_order")
    new["finish_codes"] = _publish(spark, new["finish_codes"], out_dir, "finish_codes")

    # finish_code_steps: embedded rows, then the file's rows (later in load order).
    steps_in = []
    if fcs_embedded is not None:
        steps_in.append(_ord(_with_created(fcs_embedded, run_ts), 1))
    if ok("finish_code_steps.csv"):
        r = scans["finish_code_steps.csv"].rows
        codes = new["finish_codes"].select("code", "program")
        r1, rej1 = resolve(r, codes, [("finish_code", "code")], take=[("program", "program")],
                           row_key=["finish_code", "sft_code"])
        r2, rej2 = resolve(r1, new["sft_steps"], [("sft_code", "sft_code")], row_key=["finish_code", "sft_code"])
        n_rej = _count(rej1, rej2)
        if n_rej:
            fail("finish_code_steps.csv", f"{n_rej} rows reference unknown or ambiguous codes")
        else:
            steps_in.append(_ord(_with_created(r2.select("finish_code", "program", "sft_code", "step_order",
                                                         "_order"), run_ts), 2))
    if steps_in:
        inc = steps_in[0]
        for s in steps_in[1:]:
            inc = inc.unionByName(s)
        new["finish_code_steps"] = _upsert(prev["finish_code_steps"], inc, "finish_code_steps")

    # Link tables: strict resolution, snapshot replace per file.
    if ok("sft_material_links.csv"):
        r = scans["sft_material_links.csv"].rows.withColumn("variant", blank_to_null("variant")) \
            .withColumn("note", blank_to_null("note"))
        r1, rej1 = resolve(r, new["sft_steps"], [("sft_code", "sft_code")], row_key=["sft_code", "base_spec"])
        r2, rej2 = resolve(r1, new["materials"], [("base_spec", "base_spec"), ("variant", "variant")],
                           null_safe=["variant"], row_key=["sft_code", "base_spec", "variant"])
        n_rej = _count(rej1, rej2)
        if n_rej:
            fail("sft_material_links.csv", f"{n_rej} rows reference unknown steps or materials")
        else:
            new["sft_material_links"] = _with_created(r2, run_ts).select(*COLUMNS["sft_material_links"])
    if ok("material_chemicals.csv"):
        r = scans["material_chemicals.csv"].rows.withColumn("variant", blank_to_null("variant")) \
            .withColumn("notes", blank_to_null("notes"))
        r1, rej1 = resolve(r, new["materials"], [("base_spec", "base_spec"), ("variant", "variant")],
                           null_safe=["variant"], row_key=["base_spec", "variant", "cas"])
        r2, rej2 = resolve(r1, new["chemicals"].filter(F.col("cas").isNotNull()), [("cas", "cas")],
                           row_key=["base_spec", "variant", "cas"])
        n_rej = _count(rej1, rej2)
        if n_rej:
            fail("material_chemicals.csv", f"{n_rej} rows reference unknown materials or chemicals")
        else:
            new["material_chemicals"] = _with_created(r2, run_ts).select(*COLUMNS["material_chemicals"])

    for t in ("finish_code_steps", "sft_material_links", "material_chemicals"):
        new[t] = _publish(spark, new[t], out_dir, t)

    # Manifest (S11): upsert one row per loaded file.
    hashes = file_hashes(spark, in_dir, "*.csv")
    loaded = [(f, facts[f]["rows"]) for f in LOAD_ORDER if facts[f]["status"] == "loaded"]
    man_in = spark.createDataFrame(loaded, "source_name string, rows_loaded long").join(
        hashes.select("source_name", "sha256"), "source_name")
    man_in = man_in.select("source_name", "sha256", "rows_loaded", F.lit(run_ts).cast("timestamp").alias("loaded_at"))
    man = upsert(prev["metadata_versions"].select(*COLUMNS["metadata_versions"], F.lit(0).alias("_s")),
                 man_in.select("*", F.lit(1).alias("_s")), ["source_name"], ["_s"])
    new["metadata_versions"] = _publish(spark, man.select(*COLUMNS["metadata_versions"]), out_dir,
                                        "metadata_versions")

    # Audit (Q14) over the published snapshot.
    rules = domain_rules()
    issues_df = A.issues(spark, new, rules)  # lazy: built only if the caller reads it
    rep = A.report_from_counts(A.issue_counts(spark, new, rules))
    audit_row = rep.first()  # one row
    n_fail = sum(1 for f in LOAD_ORDER if facts[f]["status"] == "failed")
    if n_fail:
        status = "failed" if n_fail == len(LOAD_ORDER) else "partial"
    elif audit_row["status"] == "errors":
        status = "failed"
    elif audit_row["status"] == "warnings":
        status = "success_with_warnings"
    else:
        status = "success"
    file_rows = [(f, facts[f]["status"], facts[f]["rows"], facts[f]["error"]) for f in LOAD_ORDER]
    files = spark.createDataFrame(file_rows, "source_name string, status string, rows long, error string") \
        .join(hashes.select("source_name", "sha256"), "source_name", "left")
    report = rep.select(F.lit(status).alias("status"), F.lit(len(LOAD_ORDER) - n_fail).alias("files_loaded"),
                        F.lit(n_fail).alias("files_failed"), F.col("status").alias("validation_status"),
                        "error_count", "warning_count", "summary", F.lit(run_ts).cast("timestamp").alias("timestamp"))
    warn = spark.createDataFrame([], "source_name string, row_key string, reason string")
    for w in warnings:
        warn = warn.unionByName(w)
    return IngestResult(new, files, warn, issues_df, report, status)


def _count(*rejects: DataFrame) -> int:
    """Total rows of several reject frames in one job."""
    u = rejects[0].select("row_key")
    for r in rejects[1:]:
        u = u.unionByName(r.select("row_key"))
    return u.count()


def _publish(spark: SparkSession, df: DataFrame, out_dir: str, table: str) -> DataFrame:
    """Write the table snapshot and return it read back (a written table cuts lineage)."""
    path = f"{out_dir}/{table}"
    df.select(*COLUMNS[table]).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def audit(spark: SparkSession, snap_dir: str) -> tuple[DataFrame, DataFrame]:
    """Q14: (issues, report) for a published snapshot."""
    tables = read_snapshot(spark, snap_dir)
    iss = A.issues(spark, tables, domain_rules())
    return iss, A.report(iss)
