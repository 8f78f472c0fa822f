"""Secret scan: fixed patterns plus sliding-window entropy, as DataFrame expressions.

Spark returns the texts of all matches but not their places. Splitting a text at the same pattern gives what lies
between them, so the lengths of both, added up, are the places. Only texts in which a pattern occurs are split.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The base patterns of the contract. For access and hex the least length is part of the pattern, which
#: gives the same spans since their matches are maximal runs; for assign it is tested afterwards.
ASSIGN = (r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|"""
          r"""[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"

#: Candidates for the entropy test, and the least entropy in bits a character of some window of ``WINDOW`` characters,
#: by the classes of characters that the window holds.
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
LEAST_ENTROPY = {"hex": 3.0, "alphanumeric": 3.6, "mixed": 3.8}

#: Candidates that look random but are known not to be secrets: words of letters alone in one case or capitalised,
#: repeats of one character, digits alone (numbers, dates), examples.
ALLOWED = r"^(?:[A-Z]?[a-z]+|[A-Z]+|[0-9]+|(.)\1*|[A-Za-z]+(?:[-_/][A-Za-z]+)+|.*(?:EXAMPLE|example|xxxx|XXXX).*)$"

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

SPAN = "array<struct<start:bigint,end:bigint,match:string>>"


#: Matches whose lengths are added up one by one; whole blocks of them are added up once.
BLOCK = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once, however often and in whatever lambda ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(lengths: Column, start: Column, n: Column) -> Column:
    """Sum of ``n`` entries from place ``start`` (from 0)."""
    return F.aggregate(F.slice(lengths, start + 1, n), F.lit(0).cast("long"), lambda a, x: a + x)


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as ``(start, end, match)``, in code points; none without a match."""
    def spans(gaps: Column, found: Column) -> Column:
        return let(F.zip_with(gaps, found, lambda g, m: (F.length(g) + F.length(m)).cast("long")),
                   lambda lengths: let(blocks(lengths), lambda before: F.transform(
                       found, lambda m, i: span(m, F.get(before, F.floor(i / BLOCK).cast("int"))
                                                + total(lengths, i - i % BLOCK, i % BLOCK + 1)))))

    def blocks(lengths: Column) -> Column:
        """What comes before each block of ``BLOCK`` entries."""
        starts = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int"))
        return let(F.transform(starts, lambda b: total(lengths, b * BLOCK, F.lit(BLOCK))),
                   lambda sums: F.transform(sums, lambda _, b: total(sums, F.lit(0), b)))

    def span(match: Column, end: Column) -> Column:
        return F.struct((end - F.length(match)).alias("start"), end.alias("end"), match.alias("match"))

    found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: let(
        F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found)), lambda gaps: spans(gaps, found)))
    return F.coalesce(F.when(F.regexp_like(text, F.lit(pattern)), found.cast(SPAN)), F.array().cast(SPAN))


def _term(n: Column) -> Column:
    """``n * log2(n)`` of a count, 0 for 0."""
    return F.when(n > 0, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def best_window(candidate: Column, window: int = WINDOW) -> Column:
    """For every class of window, the highest entropy (bits a character) of a window of ``window`` characters.

    One walk over the characters: counts per character change by the one that comes in and the one that goes out, and
    with them the sum of ``n log2 n``; entropy is ``log2(window) - sum / window``. A window's class comes from counts
    of its digits, letters a-f, and others, kept likewise.
    """
    size = len(ALPHABET)

    def step(codes, state, i):
        new = F.get(codes, i - 1)
        old = F.when(i > window, F.get(codes, i - 1 - window)).otherwise(F.lit(-1))
        counts = state["counts"]
        n_in = F.get(counts, new)
        n_out = F.when(old >= 0, F.get(counts, F.greatest(old, F.lit(0)))).otherwise(F.lit(1))
        total = F.when(new == old, state["total"]).otherwise(
            state["total"] + _term(n_in + 1) - _term(n_in) + _term(n_out - 1) - _term(n_out))
        after = F.transform(counts, lambda n, k: n + (k == new).cast("int") - (k == old).cast("int"))
        return let(F.struct(after.alias("counts"), total.alias("total")), lambda now: F.struct(
            now["counts"].alias("counts"), now["total"].alias("total"), best(state, now, i).alias("best")))

    def best(state, now, i):
        def held(first, n):
            return F.aggregate(F.slice(now["counts"], first, n), F.lit(0), lambda a, n: a + n)

        entropy = F.when(i >= window, F.lit(math.log2(window)) - now["total"] / window).otherwise(F.lit(0.0))
        counted = F.struct(held(53, 10).alias("digits"), held(27, 6).alias("low_af"), held(63, 5).alias("marks"))
        return let(F.struct(entropy.alias("entropy"), counted.alias("c")), lambda w: let(
            F.when(w["c"]["digits"] + w["c"]["low_af"] == window, F.lit("hex"))
            .when((w["c"]["marks"] == 0) & (w["c"]["digits"] > 0), F.lit("alphanumeric"))
            .when(w["c"]["digits"] > 0, F.lit("mixed")).otherwise(F.lit("letters")),
            lambda kind: F.struct(*[F.greatest(state["best"][c], F.when(kind == c, w["entropy"]).otherwise(F.lit(0.0)))
                                    .alias(c) for c in LEAST_ENTROPY])))

    zero = F.struct(F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("total"),
                    F.struct(*[F.lit(0.0).alias(c) for c in LEAST_ENTROPY]).alias("best"))
    places = F.transform(F.split(candidate, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1)
    return let(places, lambda codes: F.aggregate(F.sequence(F.lit(1), F.length(candidate)), zero,
                                                 lambda state, i: step(codes, state, i), lambda s: s["best"]))


def entropy_spans(text: Column) -> Column:
    """Spans of candidates with a window of high entropy for its class that the allow-list doesn't know."""
    def odd(span):
        def high(best):
            return F.greatest(*[best[kind] >= least for kind, least in LEAST_ENTROPY.items()])

        return ~F.regexp_like(span["match"], F.lit(ALLOWED)) & let(best_window(span["match"]), high)

    return F.filter(matches(text, CANDIDATE), odd)


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: ``doc_id``, ``n_assign``, ``n_access``, ``n_hex``, ``base_sha256`` (of the base spans
    ``kind:start:end`` by start and then kind, comma-joined), ``spans`` (those and the ``entropy`` ones).

    Places are code points, the end exclusive. Null and empty texts have no spans. Repeated rows are scanned alike;
    an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    d = docs.select("doc_id", text.alias("_t")).select(
        "doc_id",
        F.filter(matches(F.col("_t"), ASSIGN),
                 lambda s: F.length(F.regexp_extract(s["match"], ASSIGN, 1)) >= 6).alias("a0"),
        matches(F.col("_t"), ACCESS).alias("a1"), matches(F.col("_t"), HEX).alias("a2"),
        entropy_spans(F.col("_t")).alias("a3"))

    def named(n, kind):
        return F.transform(f"a{n}", lambda s: F.struct(
            s["start"].alias("start"), F.lit(n).alias("n"),
            F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("x")))

    def listed(*kinds):
        spans = F.array_sort(F.concat(*[named(n, kind) for n, kind in enumerate(kinds)]))
        return F.array_join(F.transform(spans, lambda s: s["x"]), ",")

    return d.select("doc_id", *[F.size(f"a{n}").cast("long").alias(f"n_{k}")
                                for n, k in enumerate(("assign", "access", "hex"))],
                    F.sha2(listed("assign", "access", "hex").cast("binary"), 256).alias("base_sha256"),
                    listed("assign", "access", "hex", "entropy").alias("spans"))
