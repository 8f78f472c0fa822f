"""Regex text functions: specification extraction, RTF cleanup, code segmentation.

All are built-in ``regexp_*`` expressions over a column, so a document table is processed
row-locally inside the scan stage (no shuffle, no Python).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.columns import ColumnOrName, _c, strip_ws, upper_collapse

# Fixed values that must equal the reference's for equal results.
# Specification prefix families, in the reference's order:
SPEC_PREFIXES = ["MIL", "AMS", "ASTM", "LMA", "QQ", "SAE", "ISO", "IEC", "NAVAIR",
                 "NAVSEA", "NAS", "MS", "AN", "BAC", "FED-STD"]
# Upper-case words that act as barriers during extraction:
BARRIER_WORDS = ["IAW", "OR", "AND"]
# Bare part specification: P followed by 4 to 6 digits.
P_SPEC_BODY = r"P\d{4,6}"
# Finish-code token: one or two capital letters and two digits, or 0000.
CODE_TOKEN = r"[A-Z]{1,2}\d{2}|0000"
# Process-step token: SFT followed by four digits (matched case-insensitively).
STEP_TOKEN = r"(?i)\bSFT\d{4}\b"
# RTF cleanup: hex escapes, control words with the space that ends them, group marks.
RTF_HEX = r"\\'[0-9a-fA-F]{2}"
RTF_WORD = r"\\[a-zA-Z]+-?\d*(?:\s|)"
RTF_GROUP = r"[{}\\]"

# Word boundaries. ``unicode``: Java's \b (letters like ä count as word characters, as in
# Python). ``ascii``: only [A-Za-z0-9_] are word characters (what RE2/DuckDB use).
_ASCII_W = "[A-Za-z0-9_]"


def boundary(kind: str = "unicode") -> tuple[str, str]:
    """(left, right) boundary regex fragments for ``kind`` in {'unicode', 'ascii'}."""
    if kind == "ascii":
        return rf"(?<!{_ASCII_W})", rf"(?!{_ASCII_W})"
    if kind == "unicode":
        return r"\b", r"\b"
    raise ValueError(f"unknown boundary kind: {kind}")


def extract_specs(c: ColumnOrName, prefixes: list[str] | None = None, bound: str = "unicode") -> Column:
    """Specification identifiers of a text, deduplicated in first-seen order.

    1. Barrier words (upper-case only) are wrapped in underscores so they cannot start or
       end a match.
    2. Bare P-codes in order of appearance (case-insensitive), then prefix families with
       their following token; hits ending in '-' or '_' are dropped.
    3. Upper-case, remove whitespace, keep the first occurrence of each spec.
    """
    lb, rb = boundary(bound)
    prefixes = prefixes or SPEC_PREFIXES
    text = _c(c)
    barrier = "|".join(BARRIER_WORDS)
    guarded = F.regexp_replace(text, rf"{lb}({barrier}){rb}", "___$1___")
    p_hits = F.regexp_extract_all(guarded, F.lit(rf"(?i){lb}{P_SPEC_BODY}{rb}"), 0)
    prefix_re = "(?:" + "|".join(prefixes) + ")"
    fam_hits = F.regexp_extract_all(guarded, F.lit(rf"(?i){lb}{prefix_re}{rb}[-\s]*[A-Za-z0-9-]*"), 0)
    fam_hits = F.filter(fam_hits, lambda x: ~(x.endswith("_") | x.endswith("-")))
    cleaned = F.transform(F.concat(p_hits, fam_hits), lambda x: F.regexp_replace(F.upper(x), r"\s+", ""))
    return F.array_distinct(cleaned)


def clean_rtf(c: ColumnOrName) -> Column:
    """Drop RTF hex escapes and control words, braces and backslashes; collapse
    whitespace; upper-case; strip."""
    s = F.regexp_replace(_c(c), RTF_HEX, " ")
    s = F.regexp_replace(s, RTF_WORD, " ")
    s = F.regexp_replace(s, RTF_GROUP, " ")
    return strip_ws(upper_collapse(s))


def segment_boundary(anchor: str = CODE_TOKEN) -> str:
    """Zero-width split point before every anchor token standing alone."""
    return rf"(?<!\S)(?=(?:{anchor})(?!\S))"


def segments(c: ColumnOrName, anchor: str = CODE_TOKEN) -> Column:
    """X4+X5: array of text pieces, each starting with an anchor token.

    Text before the first anchor is dropped. Row-local ``split`` on a lookahead.
    """
    pieces = F.split(_c(c), segment_boundary(anchor))
    return F.filter(pieces, lambda p: p.rlike(rf"^(?:{anchor})(?!\S)"))


def code_parts(code: ColumnOrName) -> Column:
    """struct(substrate, finish_applied, seq) of a code token.

    ``0000`` -> ('0','0','00'); two letters -> (first, second); otherwise (first, '0');
    seq = last two digits.
    """
    cd = _c(code)
    letters = F.regexp_replace(cd, r"[^\p{L}]", "")
    digits = F.regexp_replace(cd, r"[^\p{Nd}]", "")
    seq = F.when(F.length(digits) >= 2, F.substring(digits, -2, 2)).otherwise(digits)
    two = F.length(letters) == 2
    return (F.when(cd == "0000", F.struct(F.lit("0").alias("substrate"), F.lit("0").alias("finish_applied"),
                                          F.lit("00").alias("seq")))
            .otherwise(F.struct(F.substring(letters, 1, 1).alias("substrate"),
                                F.when(two, F.substring(letters, 2, 1)).otherwise(F.lit("0")).alias("finish_applied"),
                                seq.alias("seq"))))
