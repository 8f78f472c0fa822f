"""Keyed last-write-wins upsert (S9, W1), snapshot replace (S10, D4) and embedded
ordered lists (F9, W2, W3).

Last-write-wins is an aggregate, not a window: ``max_by(struct(payload), struct(order))``
per key is partially aggregated map-side, so a hot key never gathers all of its rows in
one task. (Spark runs it as a sort aggregate, as a struct has no fixed-width buffer: each task
sorts its rows by key before it combines them.)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import array_text


def latest_by_key(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                  first_seen: str | None = None, first_seen_as: str = "created_at") -> DataFrame:
    """Keep, per key, the row with the greatest ``order`` tuple.

    Keys group NULL-safely (NULL equals NULL, D3). ``order`` must be unique within a
    key (e.g. load sequence, file offset, row id). When ``first_seen`` is given, the
    output also carries ``min(first_seen)`` over the key as ``first_seen_as``: an
    upserted row keeps the time it was first created.
    """
    payload = [c for c in df.columns if c not in keys]
    aggs = [F.max_by(F.struct(*[F.col(c) for c in payload]), F.struct(*[F.col(o) for o in order])).alias("_w")]
    if first_seen:
        aggs.append(F.min(first_seen).alias("_first"))
    out = df.groupBy(*keys).agg(*aggs)
    keep = [c for c in payload if not (first_seen and c == first_seen_as)]
    cols = [F.col(k) for k in keys] + [F.col(f"_w.{c}").alias(c) for c in keep]
    if first_seen:
        cols.append(F.col("_first").alias(first_seen_as))
    return out.select(*cols)


def upsert(current: DataFrame | None, incoming: DataFrame, keys: Sequence[str], order: Sequence[str],
           created_col: str | None = None) -> DataFrame:
    """New snapshot = last write per key over (current rows, then incoming rows).

    ``order`` columns must exist on both sides and rank incoming rows after current rows
    (e.g. a load sequence number). ``created_col`` survives from the first version.
    """
    if current is None:
        merged = incoming
    else:
        merged = current.unionByName(incoming, allowMissingColumns=True)
    if created_col:
        return latest_by_key(merged, keys, order, first_seen=created_col, first_seen_as=created_col) \
            .select(*merged.columns)
    return latest_by_key(merged, keys, order).select(*merged.columns)


def list_positions(df: DataFrame, text_col: str, keep: Sequence[str], item_as: str = "item",
                   pos_as: str = "pos") -> DataFrame:
    """F9 + W2: one row per element of an embedded list, with its 1-based position.

    JSON arrays keep blank elements in the numbering (then drop them); the bracket-text
    path removes blanks before numbering.
    """
    arr = array_text(F.col(text_col))
    ex = df.select(*keep, F.posexplode(arr).alias("_p", item_as))
    return (ex.filter(F.col(item_as) != "")
              .select(*keep, F.col(item_as), (F.col("_p") + 1).alias(pos_as)))


def last_position(positions: DataFrame, keys: Sequence[str], item_col: str = "item",
                  pos_col: str = "pos") -> DataFrame:
    """An element repeated within one list keeps its last position."""
    return positions.groupBy(*keys, item_col).agg(F.max(pos_col).alias(pos_col))


def list_last_positions(df: DataFrame, text_col: str, keep: Sequence[str], item_as: str = "item",
                        pos_as: str = "pos") -> DataFrame:
    """F9 + W2 + W3 within each row: every distinct element of its list with its last 1-based position. Row-local: sorted
    within the row's array, no shuffle. (Lists of several rows of one key are put together by ``last_position``.)"""
    arr = array_text(F.col(text_col))
    placed = F.filter(F.transform(arr, lambda x, i: F.struct(x.alias("item"), (i + 1).alias("pos"))),
                      lambda p: p["item"] != "")
    # One-element array: the sorted list is computed once, and the lambda's variable stands for it.
    last = F.transform(F.array(F.array_sort(placed)), lambda s: F.filter(
        s, lambda p, i: F.coalesce(F.get(s, i + 1)["item"] != p["item"], F.lit(True))))
    rows = df.select(*keep, F.explode(F.get(last, F.lit(0))).alias("_e"))
    return rows.select(*keep, F.col("_e.item").alias(item_as), F.col("_e.pos").alias(pos_as))
