"""Join building blocks: key resolution that stands hot keys, orphan detection.

Orphan checks reduce the child to (key, rows) before any shuffle, so a hot key is one row
per task. Resolution needs every child row. There a sketch over the child's keys finds those
that hold a good part of its rows, and only these are salted: their child rows go to
``SALTS`` join keys and their parent row is repeated for all of them. All other keys, and a
child without hot keys, are joined as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

#: A key is hot from a share of 1 / HOT of all rows on, so there are at most HOT of them. The sketch's error is far
#: below that share. A key below it is a task's load of at most that share.
HOT, TRACKED = 64, 4096

#: Join keys that a hot key's rows are dealt over.
SALTS = 16


def hot_keys(df: DataFrame, key: Column) -> Column:
    """Hashes (``xxhash64``) of the hot values of ``key`` in ``df``, as a scalar subquery: one aggregate over that
    column alone, a sketch of bounded size per task."""
    seen = df.select(F.xxhash64(key).alias("k")).agg(
        F.expr(f"approx_top_k(k, {HOT}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n"))
    hot = F.filter("top", lambda x: x["count"] * HOT >= F.col("n"))
    return seen.select(F.transform(hot, lambda x: x["item"])).scalar()


def is_hot(hot: Column, key: Column) -> Column:
    return F.coalesce(F.array_contains(hot, F.xxhash64(key)), F.lit(False))


def salt(df: DataFrame, hot: Column, key: Column, *by: str) -> Column:
    """Salt of a row: by the hash of the columns ``by`` (the same for a retried task) under a hot key, else 0. Columns
    that can't be hashed are left out."""
    by = [c for c in by if _hashable(df.schema[c].dataType)]
    dealt = F.pmod(F.xxhash64(*by), F.lit(SALTS)).cast("int") if by else F.lit(0)
    return F.when(is_hot(hot, key), dealt).otherwise(F.lit(0))


def salted(df: DataFrame, hot: Column, key: Column) -> DataFrame:
    """``df`` with column ``_salt``: rows of hot keys once for every salt, others once."""
    every = F.when(is_hot(hot, key), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    return df.withColumn("_salt", F.explode(every))


def _hashable(t) -> bool:
    if isinstance(t, ArrayType):
        return _hashable(t.elementType)
    if isinstance(t, StructType):
        return all(_hashable(f.dataType) for f in t.fields)
    return not isinstance(t, (MapType, VariantType))


def common_type(spark, types: Sequence[str]) -> str:
    """The type in which values of ``types`` are compared: Spark's own common type, or text where only some are text."""
    several = sorted(set(types))
    if len(several) == 1:
        return several[0]
    if "string" in several:
        return "string"
    nulls = ", ".join(f"CAST(NULL AS {t})" for t in several)
    return spark.sql(f"SELECT coalesce({nulls}) AS c").schema["c"].dataType.simpleString()


def key_condition(left: DataFrame, right: DataFrame, pairs: Sequence[tuple[str, str]],
                  null_safe: Sequence[str] = ()) -> Column:
    """Equi-join condition; columns named in ``null_safe`` (left names) use ``<=>``."""
    cond = None
    for lc, rc in pairs:
        term = left[lc].eqNullSafe(right[rc]) if lc in null_safe else (left[lc] == right[rc])
        cond = term if cond is None else (cond & term)
    return cond


def resolve(child: DataFrame, parent: DataFrame, pairs: Sequence[tuple[str, str]],
            take: Sequence[tuple[str, str]] = (), null_safe: Sequence[str] = (),
            row_key: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Resolve child rows to a parent by (possibly composite, null-safe) key.

    ``take`` lists (parent column, output name) pairs copied onto resolved rows.
    Returns ``(resolved, rejects)``. A child row is rejected when no parent row has its
    key (``missing_parent``) or more than one does (``ambiguous_key``, D2). Rejects
    carry ``reason`` and a text ``row_key`` built from ``row_key`` (default: the key).
    Strict callers fail a file when ``rejects`` is non-empty; lenient callers report the
    rejects as warnings and keep ``resolved``.
    """
    pkeys = [p for _, p in pairs]
    types = [common_type(child.sparkSession, [child.schema[c].dataType.simpleString(),
                                              parent.schema[p].dataType.simpleString()]) for c, p in pairs]
    # One row per parent key: count for ambiguity, payload of a fixed row (the minimum
    # payload struct, so the choice is deterministic). Partial aggregation map-side.
    agg = [F.count(F.lit(1)).alias("_n_parent")]
    if take:
        agg.append(F.min(F.struct(*[F.col(p).alias(o) for p, o in take])).alias("_take"))
    pk = parent.groupBy(*[F.col(p).cast(t).alias(f"_pk_{i}") for i, (p, t) in enumerate(zip(pkeys, types))]).agg(*agg)
    # A NULL in a column that isn't NULL-safe finds no parent: such rows count as one key, which may be hot, too.
    child_key = F.struct(*[F.col(c).cast(t) for (c, _), t in zip(pairs, types)])
    hot = hot_keys(child, child_key)
    pk = salted(pk, hot, F.struct(*[f"_pk_{i}" for i in range(len(pairs))])).withColumnRenamed("_salt", "_pk_salt")
    dealt = child.withColumn("_salt", salt(child, hot, child_key, *child.columns))
    renamed = [(lc, f"_pk_{i}") for i, (lc, _) in enumerate(pairs)]
    on = key_condition(dealt, pk, renamed, null_safe) & (dealt["_salt"] == pk["_pk_salt"])
    joined = dealt.join(pk, on, "left").drop("_salt", "_pk_salt", *[r for _, r in renamed])
    out_cols = list(child.columns)
    resolved = joined.filter(F.col("_n_parent") == 1)
    if take:
        resolved = resolved.select(*out_cols, *[F.col(f"_take.{o}").alias(o) for _, o in take])
    else:
        resolved = resolved.select(*out_cols)
    rk = list(row_key) or [lc for lc, _ in pairs]
    rejects = (joined.filter(F.col("_n_parent").isNull() | (F.col("_n_parent") > 1))
               .select(*out_cols,
                       F.when(F.col("_n_parent").isNull(), F.lit("missing_parent"))
                       .otherwise(F.lit("ambiguous_key")).alias("reason"),
                       F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("<null>")) for k in rk])
                       .alias("row_key")))
    return resolved, rejects


def orphan_count(child: DataFrame, child_cols: Sequence[str], parent: DataFrame,
                 parent_cols: Sequence[str], null_safe: Sequence[str] = ()) -> DataFrame:
    """J12 + A1: number of child rows whose key is absent from the parent.

    A row takes part when its non-NULL-safe key columns are all non-NULL; columns named
    in ``null_safe`` (child names) match NULL to NULL. The child is first reduced to
    (key, rows) so each distinct key crosses the shuffle once; ``left_anti`` (not
    ``NOT IN``) keeps NULL parent keys from hiding orphans. Returns one row:
    ``orphan_count``.
    """
    nn = F.lit(True)
    for c in child_cols:
        if c not in null_safe:
            nn = nn & F.col(c).isNotNull()
    keyed = child.filter(nn).groupBy(*child_cols).agg(F.count(F.lit(1)).alias("_rows"))
    par = parent.select(*[F.col(p).alias(f"_p{i}") for i, p in enumerate(parent_cols)])
    cond = None
    for i, c in enumerate(child_cols):
        t = keyed[c].eqNullSafe(par[f"_p{i}"]) if c in null_safe else (keyed[c] == par[f"_p{i}"])
        cond = t if cond is None else (cond & t)
    orphans = keyed.join(par, cond, "left_anti")
    return orphans.agg(F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("orphan_count"))
