"""Rule-driven data-quality audits (V1-V13) producing one issues DataFrame.

Each rule reads its table(s) from a ``dict[str, DataFrame]``; a missing child table
skips the rule and a missing parent table is itself an issue (S21, V2). Every rule
becomes a small plan whose output follows ``ISSUE_SCHEMA``; the report (A12) is a
single aggregate over the union (U1). Counting rules reduce map-side, row rules emit
one issue per offending row; nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import json_is_valid, zero_pad
from tessera.operators.joins import common_type

ISSUE_COLUMNS = ["type", "severity", "table", "column", "issue", "row_key", "n", "details"]
ISSUE_DDL = ("type string, severity string, table string, column string, issue string, "
             "row_key string, n long, details string")


@dataclass(frozen=True)
class ForeignKey:
    child: str
    child_cols: tuple[str, ...]
    parent: str
    parent_cols: tuple[str, ...]
    null_safe: tuple[str, ...] = ()


@dataclass(frozen=True)
class Required:
    table: str
    columns: tuple[str, ...]
    blank_is_null: bool = False  # D7: also count '' as missing


@dataclass(frozen=True)
class Unique:
    table: str
    key: tuple[str, ...]


@dataclass(frozen=True)
class RowCheck:
    """Per-row rule: ``violates(df)`` is a boolean Column, true for offending rows."""
    table: str
    column: str
    issue: str
    severity: str
    violates: Callable[[DataFrame], Column]
    row_key: tuple[str, ...]
    kind: str = "format"
    value: Callable[[DataFrame], Column] | None = None


@dataclass(frozen=True)
class SumLimit:
    table: str
    group: tuple[str, ...]
    value: str
    limit: float
    issue: str = "exceeds_100_percent"
    severity: str = "warning"


@dataclass(frozen=True)
class Composition:
    """V9: ``code`` must equal concat(parts) + zero-padded seq, or + unpadded seq."""
    table: str
    code: str
    parts: tuple[str, ...]
    seq: str
    row_key: tuple[str, ...]
    width: int = 2


@dataclass(frozen=True)
class StepSequence:
    """Documented rule: within each group the order values are exactly 1..n."""
    table: str
    group: tuple[str, ...]
    order: str


@dataclass
class Rules:
    foreign_keys: list[ForeignKey] = field(default_factory=list)
    required: list[Required] = field(default_factory=list)
    unique: list[Unique] = field(default_factory=list)
    row_checks: list[RowCheck] = field(default_factory=list)
    sum_limits: list[SumLimit] = field(default_factory=list)
    compositions: list[Composition] = field(default_factory=list)
    sequences: list[StepSequence] = field(default_factory=list)


def _row_key(cols: Sequence[str]) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("<null>")) for c in cols])


def _issue(kind: str, severity: str, table: str, column: str, issue: str,
           row_key: Column, n: Column, details: Column) -> list[Column]:
    return [F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.lit(table).alias("table"),
            F.lit(column).alias("column"), F.lit(issue).alias("issue"), row_key.cast("string").alias("row_key"),
            n.cast("long").alias("n"), details.cast("string").alias("details")]


def _empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], ISSUE_DDL)


class KeyProfile:
    """All rules that count rows or keys, in one scan per table and one aggregate.

    Every table's row is expanded to the (tag, key) items that the rules take from it; a tag stands for one child key
    column set, one unique key or one row-local check. A key's columns keep their types: each goes to a slot of its
    type. Child rows count (``n``), parent rows set the bit of their rule (``bits``), so a child key's orphans are its
    rows under keys without that bit: no join, and a hot key is one row per task after the map side's aggregate.
    """

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables: Mapping[str, DataFrame] = tables
        self.slots: dict[str, str] = {}  # name -> type
        self.items: dict[str, list[tuple]] = {}
        self.n_tags = self.n_bits = 0

    def _item(self, table: str, tag: int, cols: Sequence[tuple[str, str]], wanted: Column, n: int, bit: int) -> None:
        used: dict[str, Column] = {}
        for c, t in cols:
            slot = next(s for s in (f"k{i}_{t}" for i in range(len(cols) + 1)) if s not in used)
            self.slots[slot] = t
            used[slot] = F.col(c).cast(t)
        self.items.setdefault(table, []).append((tag, used, wanted, n, bit))

    def check(self, table: str, wanted: Column) -> int:
        """Counts the rows for which ``wanted`` is true."""
        self.n_tags += 1
        self._item(table, self.n_tags, [], F.coalesce(wanted, F.lit(False)), 1, 0)
        return self.n_tags

    def key(self, table: str, cols: Sequence[str], types: Sequence[str] | None = None,
            null_safe: Sequence[str] | None = None) -> int:
        """Counts the rows of each key; rows with NULL in a column that isn't ``null_safe`` (default: all are) take no
        part."""
        self.n_tags += 1
        schema = self.tables[table].schema
        types = types or [schema[c].dataType.simpleString() for c in cols]
        self._item(table, self.n_tags, list(zip(cols, types)), _present(cols, null_safe), 1, 0)
        return self.n_tags

    def parent(self, table: str, cols: Sequence[str], types: Sequence[str], null_safe: Sequence[str], tag: int,
               bit: int) -> None:
        """Marks the keys of ``tag`` that ``table`` holds."""
        self.n_bits = max(self.n_bits, bit + 1)
        self._item(table, tag, list(zip(cols, types)), _present(cols, null_safe), 0, 1 << bit)

    def result(self) -> DataFrame:
        """Per tag with rows: ``tag``, ``total`` rows, ``duplicate_keys``, ``surplus_rows``, and ``without_<bit>``, the
        rows under keys that the bit's parent lacks."""
        out = None
        for table, items in self.items.items():
            structs = [F.when(wanted, F.struct(
                F.lit(tag).alias("tag"),
                *[used.get(s, F.lit(None).cast(t)).alias(s) for s, t in self.slots.items()],
                F.lit(n).cast("long").alias("n"), F.lit(bits).cast("long").alias("bits")))
                for tag, used, wanted, n, bits in items]
            rows = self.tables[table].select(F.explode(F.filter(F.array(*structs), lambda x: x.isNotNull())).alias("k"))
            out = rows.select("k.*") if out is None else out.unionAll(rows.select("k.*"))
        keys = out.groupBy("tag", *self.slots).agg(F.sum("n").alias("n"), F.bit_or("bits").alias("bits"))
        return keys.groupBy("tag").agg(
            F.sum("n").alias("total"), F.count_if(F.col("n") > 1).alias("duplicate_keys"),
            F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("surplus_rows"),
            *[F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(1 << b) == 0, F.col("n"))), F.lit(0))
              .alias(f"without_{b}") for b in range(self.n_bits)])


def _present(cols: Sequence[str], null_safe: Sequence[str] | None) -> Column:
    out = F.lit(True)
    for c in cols:
        if null_safe is not None and c not in null_safe:
            out = out & F.col(c).isNotNull()
    return out


def profile_foreign_keys(profile: KeyProfile, fks: Sequence[ForeignKey]) -> list[tuple[int, int]]:
    """Adds ``fks`` and returns each one's tag and bit. Keys that several rules look up are counted once."""
    tables, tags, out = profile.tables, {}, []
    for fk in fks:
        child, parent = tables[fk.child], tables[fk.parent]
        types = tuple(common_type(child.sparkSession, [child.schema[c].dataType.simpleString(),
                                                       parent.schema[p].dataType.simpleString()])
                      for c, p in zip(fk.child_cols, fk.parent_cols))
        key = fk.child, fk.child_cols, types, tuple(sorted(fk.null_safe))
        if key not in tags:
            tags[key] = [profile.key(fk.child, fk.child_cols, types, fk.null_safe), 0]
        tag, bit = tags[key]
        tags[key][1] += 1
        safe = [p for c, p in zip(fk.child_cols, fk.parent_cols) if c in fk.null_safe]
        profile.parent(fk.parent, fk.parent_cols, types, safe, tag, bit)
        out.append((tag, bit))
    return out


def _per_rule(result: DataFrame, tags: Sequence[tuple[int, Column]], name: str) -> DataFrame:
    """``rule`` (place in ``tags``) and the value that each rule reads from its tag's row of a profile."""
    items = [F.when(F.col("tag") == tag, F.struct(F.lit(i).alias("rule"), value.cast("long").alias(name)))
             for i, (tag, value) in enumerate(tags)]
    return result.select(F.explode(F.filter(F.array(*items), lambda x: x.isNotNull())).alias("r")).select("r.*")


def orphan_counts(tables: Mapping[str, DataFrame], fks: Sequence[ForeignKey]) -> DataFrame:
    """V1 + A1 for many foreign keys at once: ``rule`` (place in ``fks``) and ``orphan_count``, for those with orphans.
    Keys are compared in the common type of their two columns; one scan per table and one aggregate for all rules."""
    profile = KeyProfile(tables)
    at = profile_foreign_keys(profile, fks)
    found = _per_rule(profile.result(), [(tag, F.col(f"without_{bit}")) for tag, bit in at], "orphan_count")
    return found.filter(F.col("orphan_count") > 0)


def unique_counts(tables: Mapping[str, DataFrame], uniques: Sequence[Unique]) -> DataFrame:
    """V10 for many keys at once: ``rule`` (place in ``uniques``), ``duplicate_keys`` and ``surplus_rows`` of tables
    with rows. One scan per table, one aggregate for all keys."""
    profile = KeyProfile(tables)
    tags = [profile.key(u.table, u.key) for u in uniques]
    result = profile.result()
    return _per_rule(result, [(t, F.col("duplicate_keys")) for t in tags], "duplicate_keys").join(
        _per_rule(result, [(t, F.col("surplus_rows")) for t in tags], "surplus_rows"), "rule")


def _of_rule(values: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("rule"))


def fk_issues(spark: SparkSession, tables: Mapping[str, DataFrame], fks: Sequence[ForeignKey]) -> list[DataFrame]:
    """V1 + V2: one ``orphan_fk`` issue per foreign key with orphans (count in ``n``)."""
    out = missing_parents(spark, tables, fks)
    fks = [fk for fk in fks if fk.child in tables and fk.parent in tables]
    if fks:
        targets = _of_rule([f"{fk.parent}.{', '.join(fk.parent_cols)}" for fk in fks])
        out.append(orphan_counts(tables, fks).select(
            F.lit("referential_integrity").alias("type"), F.lit("error").alias("severity"),
            _of_rule([fk.child for fk in fks]).alias("table"),
            _of_rule([", ".join(fk.child_cols) for fk in fks]).alias("column"), F.lit("orphan_fk").alias("issue"),
            F.lit(None).cast("string").alias("row_key"), F.col("orphan_count").alias("n"),
            F.format_string("%d rows reference non-existent %s values", F.col("orphan_count"), targets)
            .alias("details")))
    return out


def missing_parents(spark: SparkSession, tables: Mapping[str, DataFrame], fks: Sequence[ForeignKey]) -> list[DataFrame]:
    """V2: an issue per foreign key whose parent table is absent."""
    return [spark.range(1).select(*_issue(
        "referential_integrity", "error", fk.child, ", ".join(fk.child_cols), "missing_parent_table",
        F.lit(None), F.lit(None), F.lit(f"Parent table '{fk.parent}' does not exist")))
        for fk in fks if fk.child in tables and fk.parent not in tables]


def _missing(c: str, blank_is_null: bool) -> Column:
    m = F.col(c).isNull()
    return (m | (F.col(c).cast("string") == "")) if blank_is_null else m


def null_counts(df: DataFrame, columns: Sequence[str], blank_is_null: bool = False) -> DataFrame:
    """A2: (column, null_count) for all ``columns`` of one table in a single pass."""
    wide = df.agg(*[F.count_if(_missing(c, blank_is_null)).alias(c) for c in columns])
    return wide.unpivot([], list(columns), "column", "null_count")


def required_issues(tables: dict[str, DataFrame], reqs: Sequence[Required]) -> list[DataFrame]:
    """``null_value`` per (table, column) with missing values."""
    out = []
    for r in reqs:
        if r.table not in tables:
            continue
        nc = null_counts(tables[r.table], r.columns, r.blank_is_null)
        out.append(nc.filter(F.col("null_count") > 0).select(
            F.lit("completeness").alias("type"), F.lit("error").alias("severity"), F.lit(r.table).alias("table"),
            F.col("column"), F.lit("null_value").alias("issue"), F.lit(None).cast("string").alias("row_key"),
            F.col("null_count").cast("long").alias("n"),
            F.format_string("%d rows have NULL %s", F.col("null_count"), F.col("column")).alias("details")))
    return out


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """V10 core: keys that occur more than once, with their row counts."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def unique_issues(tables: dict[str, DataFrame], uniques: Sequence[Unique]) -> list[DataFrame]:
    """One ``duplicate_key`` issue per duplicated key value (n = its row count)."""
    out = []
    for u in uniques:
        if u.table not in tables:
            continue
        d = duplicate_keys(tables[u.table], u.key)
        out.append(d.select(*_issue("uniqueness", "error", u.table, ", ".join(u.key), "duplicate_key",
                                    _row_key(u.key), F.col("rows"),
                                    F.format_string("%d rows share this key", F.col("rows")))))
    return out


def sum_limit_issues(tables: dict[str, DataFrame], rules: Sequence[SumLimit]) -> list[DataFrame]:
    """V8 / A3: groups whose non-null total exceeds a limit (compared exactly; the total
    is shown rounded to 2 places)."""
    out = []
    for r in rules:
        if r.table not in tables:
            continue
        tot = (tables[r.table].filter(F.col(r.value).isNotNull()).groupBy(*r.group)
               .agg(F.sum(r.value).alias("total")).filter(F.col("total") > r.limit))
        out.append(tot.select(*_issue("format", r.severity, r.table, r.value, r.issue, _row_key(r.group), F.lit(1),
                                      F.concat(F.lit("total "), F.round("total", 2).cast("string")))))
    return out


def composed_expectation(code: Column, parts: Sequence[Column], seq: Column, width: int = 2) -> Column:
    """V9 core: NULL when ``code`` equals the padded or the unpadded composition,
    otherwise the padded expectation (what the issue reports)."""
    seq_s = seq.cast("string")
    padded = F.concat(*[p.cast("string") for p in parts], zero_pad(seq_s, width))
    plain = F.concat(*[p.cast("string") for p in parts], seq_s)
    return F.when((code == padded) | (code == plain), F.lit(None)).otherwise(padded)


def composition_issues(tables: dict[str, DataFrame], rules: Sequence[Composition]) -> list[DataFrame]:
    """V9: ``code_mismatch`` warnings."""
    out = []
    for r in rules:
        if r.table not in tables:
            continue
        df = tables[r.table]
        exp = composed_expectation(F.col(r.code), [F.col(p) for p in r.parts], F.col(r.seq), r.width)
        bad = df.select("*", exp.alias("_expected")).filter(F.col("_expected").isNotNull())
        out.append(bad.select(*_issue("format", "warning", r.table, r.code, "code_mismatch", _row_key(r.row_key),
                                      F.lit(1), F.concat(F.lit("expected: "), F.col("_expected")))))
    return out


def batched_row_check_issues(tables: dict[str, DataFrame], checks: Sequence[RowCheck]) -> list[DataFrame]:
    """V4-V7, V11 batched per table: one pass evaluates every check of the table and
    emits an issue per (row, failed check)."""
    out = []
    by_table: dict[str, list[RowCheck]] = {}
    for ck in checks:
        if ck.table in tables:
            by_table.setdefault(ck.table, []).append(ck)
    for table, cks in by_table.items():
        df = tables[table]
        items = []
        for ck in cks:
            val = ck.value(df) if ck.value is not None else F.col(ck.column).cast("string")
            item = F.struct(*_issue(ck.kind, ck.severity, ck.table, ck.column, ck.issue, _row_key(ck.row_key),
                                    F.lit(1), F.concat(F.lit("value: "), F.coalesce(val, F.lit("<null>")))))
            items.append(F.when(F.coalesce(ck.violates(df), F.lit(False)), item))
        hits = F.filter(F.array(*items), lambda x: x.isNotNull())
        out.append(df.select(F.explode(hits).alias("_i")).select("_i.*"))
    return out


def step_sequence_issues(tables: dict[str, DataFrame], rules: Sequence[StepSequence]) -> list[DataFrame]:
    """``non_sequential_steps`` warnings: groups whose orders are not exactly 1..n.

    Decided from four partial aggregates per group (count, distinct count, min, max),
    so no group is sorted or collected.
    """
    out = []
    for r in rules:
        if r.table not in tables:
            continue
        g = tables[r.table].groupBy(*r.group).agg(
            F.count(F.lit(1)).alias("_n"), F.count_distinct(r.order).alias("_d"),
            F.min(r.order).alias("_lo"), F.max(r.order).alias("_hi"))
        bad = g.filter(~((F.col("_lo") == 1) & (F.col("_hi") == F.col("_n")) & (F.col("_d") == F.col("_n"))))
        out.append(bad.select(*_issue("format", "warning", r.table, r.order, "non_sequential_steps",
                                      _row_key(r.group), F.col("_n"),
                                      F.format_string("%d steps, orders %d..%d", F.col("_n"), F.col("_lo"),
                                                      F.col("_hi")))))
    return out


def issues(spark: SparkSession, tables: dict[str, DataFrame], rules: Rules) -> DataFrame:
    """All issues of all rules as one DataFrame (``ISSUE_COLUMNS``)."""
    # Unique-key rules stay one plan per rule: each reads only its key columns (columnar scan)
    # and reduces them map-side before its shuffle.
    parts = (fk_issues(spark, tables, rules.foreign_keys) + unique_issues(tables, rules.unique)
             + required_issues(tables, rules.required)
             + batched_row_check_issues(tables, rules.row_checks)
             + sum_limit_issues(tables, rules.sum_limits) + composition_issues(tables, rules.compositions)
             + step_sequence_issues(tables, rules.sequences))
    out = _empty(spark)
    for p in parts:
        out = out.unionByName(p)
    return out


COUNT_KEYS = ["type", "severity", "table", "column", "issue"]


def issue_counts(spark: SparkSession, tables: Mapping[str, DataFrame], rules: Rules) -> DataFrame:
    """Number of issues per rule key (``COUNT_KEYS`` + ``n_issues``) without building the issue rows: foreign and
    unique keys, missing values, row checks and composed codes are one ``KeyProfile``, a scan per table; over-limit
    groups and step sequences are counted after their own partial aggregates.
    Equal to ``issues(...).groupBy(COUNT_KEYS).count()``."""
    profile = KeyProfile(tables)
    named: list[tuple[int, tuple, Column]] = []  # tag, rule key, number of issues
    one_if_any = F.least(F.lit(1), F.col("total"))
    fks = [fk for fk in rules.foreign_keys if fk.child in tables and fk.parent in tables]
    for fk, (tag, bit) in zip(fks, profile_foreign_keys(profile, fks)):
        named.append((tag, ("referential_integrity", "error", fk.child, ", ".join(fk.child_cols), "orphan_fk"),
                      F.least(F.lit(1), F.col(f"without_{bit}"))))
    for u in rules.unique:
        if u.table in tables:
            named.append((profile.key(u.table, u.key),
                          ("uniqueness", "error", u.table, ", ".join(u.key), "duplicate_key"),
                          F.col("duplicate_keys")))
    for r in rules.required:
        for c in r.columns if r.table in tables else ():
            named.append((profile.check(r.table, _missing(c, r.blank_is_null)),
                          ("completeness", "error", r.table, c, "null_value"), one_if_any))
    for ck in rules.row_checks:
        if ck.table in tables:
            named.append((profile.check(ck.table, ck.violates(tables[ck.table])),
                          (ck.kind, ck.severity, ck.table, ck.column, ck.issue), F.col("total")))
    for r in rules.compositions:
        if r.table in tables:
            exp = composed_expectation(F.col(r.code), [F.col(p) for p in r.parts], F.col(r.seq), r.width)
            named.append((profile.check(r.table, exp.isNotNull()),
                          ("format", "warning", r.table, r.code, "code_mismatch"), F.col("total")))
    parts = [df.select(*COUNT_KEYS, F.lit(1).cast("long").alias("n_issues"))
             for df in missing_parents(spark, tables, rules.foreign_keys)]
    if named:
        found = _per_rule(profile.result(), [(tag, n) for tag, _, n in named], "n_issues")
        parts.append(found.select(*[_of_rule([key[i] for _, key, _ in named]).alias(c)
                                    for i, c in enumerate(COUNT_KEYS)], "n_issues"))
    for df in sum_limit_issues(tables, rules.sum_limits) + step_sequence_issues(tables, rules.sequences):
        parts.append(df.groupBy(*COUNT_KEYS).agg(F.count(F.lit(1)).alias("n_issues")))
    out = spark.createDataFrame([], "type string, severity string, table string, column string, issue string, "
                                    "n_issues long")
    for p in parts:
        out = out.unionByName(p)
    return (out.groupBy(*COUNT_KEYS).agg(F.sum("n_issues").cast("long").alias("n_issues"))
            .filter(F.col("n_issues") > 0))


def report_from_counts(counts: DataFrame) -> DataFrame:
    """A12 from ``issue_counts``: same row as ``report`` over the issue rows."""
    e = F.coalesce(F.sum(F.when(F.col("severity") == "error", F.col("n_issues"))), F.lit(0)).cast("long")
    w = F.coalesce(F.sum(F.when(F.col("severity") == "warning", F.col("n_issues"))), F.lit(0)).cast("long")
    return _report(counts.agg(e.alias("error_count"), w.alias("warning_count")))


def report(issue_df: DataFrame) -> DataFrame:
    """One row with status (pass / warnings / errors), counts and summary text."""
    agg = issue_df.agg(F.count_if(F.col("severity") == "error").cast("long").alias("error_count"),
                       F.count_if(F.col("severity") == "warning").cast("long").alias("warning_count"))
    return _report(agg)


def _report(agg: DataFrame) -> DataFrame:
    # The report's status words and sentences.
    e, w = F.col("error_count"), F.col("warning_count")
    status = F.when(e > 0, "errors").when(w > 0, "warnings").otherwise("pass")
    summary = (F.when(e > 0, F.format_string("Validation FAILED: %d error(s), %d warning(s)", e, w))
               .when(w > 0, F.format_string("Validation passed with %d warning(s)", w))
               .otherwise(F.lit("Validation passed: no errors or warnings")))
    return agg.select(status.alias("status"), e, w, summary.alias("summary"))


# --- ready-made row checks -------------------------------------------------------

CAS_PATTERN = r"^\d{4,7}-\d{2}-\d$"  # fixed value: CAS registry number format


def regex_check(table: str, column: str, pattern: str, issue: str, severity: str,
                row_key: Sequence[str]) -> RowCheck:
    """Non-null values that do not match ``pattern``."""
    return RowCheck(table, column, issue, severity,
                    lambda df: F.col(column).isNotNull() & ~F.col(column).rlike(pattern), tuple(row_key))


def json_check(table: str, column: str, row_key: Sequence[str]) -> RowCheck:
    """Non-null values that are not JSON."""
    return RowCheck(table, column, "invalid_json", "error",
                    lambda df: ~json_is_valid(F.col(column)), tuple(row_key))


def range_check(table: str, column: str, lo: float, hi: float, row_key: Sequence[str],
                issue: str = "out_of_range", severity: str = "error") -> RowCheck:
    """Non-null values outside [lo, hi]."""
    return RowCheck(table, column, issue, severity,
                    lambda df: F.col(column).isNotNull() & ~F.col(column).between(lo, hi), tuple(row_key))


def inverted_range_check(table: str, low: str, high: str, row_key: Sequence[str]) -> RowCheck:
    """Both bounds present and low > high."""
    return RowCheck(table, f"{low}, {high}", "invalid_range", "error",
                    lambda df: F.col(low).isNotNull() & F.col(high).isNotNull() & (F.col(low) > F.col(high)),
                    tuple(row_key),
                    value=lambda df: F.concat_ws(" > ", F.col(low).cast("string"), F.col(high).cast("string")))
