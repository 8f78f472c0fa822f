"""Scalar column functions (row-local, JVM-side, inside whole-stage codegen).

Each function takes and returns ``Column`` objects so it composes inside any
``select``/``withColumn``/``filter``. None of them is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

# White space of strip and collapse: Unicode White_Space and the four separators U+001C to
# U+001F, the set that Python's str.strip and ``\s`` use (Java's own ``\s`` is ASCII only).
_WS = r"[\s\x1c-\x1f]"


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: ColumnOrName) -> Column:
    """remove all leading and trailing whitespace (``trim`` only removes spaces)."""
    return F.regexp_replace(_c(c), rf"(?U)^{_WS}+|{_WS}+$", "")


def blank_to_null(c: ColumnOrName) -> Column:
    """empty text becomes NULL."""
    return F.nullif(_c(c), F.lit(""))


def strip_or_empty(c: ColumnOrName) -> Column:
    """S5 + F1: missing value becomes '' and the rest is stripped."""
    return strip_ws(F.coalesce(_c(c), F.lit("")))


def digits_or_zero(c: ColumnOrName) -> Column:
    """a digits-only text becomes its integer value (``07`` -> 7), anything else 0."""
    s = strip_ws(_c(c))
    return (F.when(s.rlike(r"^[0-9]+$"), s.try_cast("long")).otherwise(F.lit(0))).cast("long")


def split_list(c: ColumnOrName, sep: str = ",") -> Column:
    """split on a separator, strip every element, drop blank elements."""
    parts = F.split(_c(c), sep)
    return F.filter(F.transform(parts, lambda x: strip_ws(x)), lambda x: x != F.lit(""))


def split_keep_blanks(c: ColumnOrName, sep: str = ",") -> Column:
    """X9 variant of F4: split and strip, blank elements are kept in place."""
    return F.transform(F.split(_c(c), sep), lambda x: strip_ws(x))


def truncate_text(c: ColumnOrName, width: int = 80, ellipsis: str = "...") -> Column:
    """texts longer than ``width`` become their first width-len(ellipsis) chars + ellipsis."""
    col = _c(c)
    keep = width - len(ellipsis)
    return F.when(F.length(col) > width,
                  F.concat(F.substring(col, 1, keep), F.lit(ellipsis))).otherwise(col)


def zero_pad(c: ColumnOrName, width: int = 2) -> Column:
    """left-pad with zeros to ``width`` but never truncate (bare lpad cuts '123' to '12')."""
    s = _c(c).cast("string")
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)


def compose_code(*parts: ColumnOrName) -> Column:
    """concatenation of code parts."""
    return F.concat(*[_c(p).cast("string") for p in parts])


def json_is_valid(c: ColumnOrName) -> Column:
    """NULL stays NULL, otherwise true when the text parses as JSON."""
    col = _c(c)
    return F.when(col.isNull(), F.lit(None).cast("boolean")).otherwise(F.try_parse_json(col).isNotNull())


def array_text(c: ColumnOrName) -> Column:
    """a JSON array of strings, else strip ``[ ] \" '`` and split on commas.

    On the JSON path blank elements are kept (they still take a position, W2); on the
    text path blanks are removed before numbering. Only a JSON *array* counts (D13).
    """
    col = strip_ws(_c(c))
    as_json = F.from_json(col, "array<string>")
    as_json = F.when(col.startswith("["), F.transform(as_json, lambda x: F.coalesce(strip_ws(x), F.lit(""))))
    fallback = split_list(F.regexp_replace(col, r"[\[\]\"']", ""))
    return F.coalesce(as_json, fallback)


def short_hash(c: ColumnOrName, n: int = 16) -> Column:
    """first n characters of a hex digest."""
    return F.substring(_c(c), 1, n)


def join_list(c: ColumnOrName, sep: str = ",") -> Column:
    """join an array of strings."""
    return F.array_join(_c(c), sep)


def first_k_with_ellipsis(arr: ColumnOrName, k: int = 5, sep: str = ";", more: str = "...") -> Column:
    """O7 + S15: first k elements joined, plus an ellipsis when the list is longer."""
    a = _c(arr)
    return F.concat(F.array_join(F.slice(a, 1, k), sep), F.when(F.size(a) > k, F.lit(more)).otherwise(F.lit("")))


def upper_collapse(c: ColumnOrName) -> Column:
    """collapse whitespace runs to one space and upper-case."""
    return F.upper(F.regexp_replace(_c(c), rf"(?U){_WS}+", " "))


def collapse_ws(c: ColumnOrName) -> Column:
    """Whitespace runs to one space, then strip (F13 without the case change)."""
    return strip_ws(F.regexp_replace(_c(c), rf"(?U){_WS}+", " "))


def base_name(c: ColumnOrName) -> Column:
    """last path element."""
    return F.element_at(F.split(_c(c), "/"), -1)


def is_hex64(c: ColumnOrName) -> Column:
    """S20 guard: 64 hexadecimal characters."""
    return _c(c).rlike(r"^[0-9a-fA-F]{64}$")
