"""Periodic run detection by internal pattern matching.

A run is a longest stretch of words in which words ``q`` apart are equal, ``q`` the smallest such number, and which is
at least ``max(6, 4 q)`` words long. Documents are independent, so Spark only deals them out; within a task:

* Prefix doubling names the repeated blocks of 2, 4, 8, ... words of every document and yields their intervals in its
  suffix array (children in order of word codes). Blocks that occur once in their document leave at once.
* A run of period ``q`` holds a block at a multiple of its length ``L`` that occurs again ``q`` words on, for the power
  of two with ``2 L - 1 <= 3 q``. So every such dyadic block is looked up in its neighbouring window: a wavelet tree over
  the suffix array answers "next occurrence from here on" (range successor) for all blocks at once.
* Occurrences of a block in so short a window form one progression. One or two of them are candidate periods as they
  are; of three or more, with difference ``r``, only the distance between the ends of the two ``r``-periodic stretches
  around the block and around the progression can be one.
* A candidate is extended word by word to both sides; of several periods of one stretch the smallest stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import WORD, rows_of, slices, split_words

#: A run is at least so many words and so many periods long.
LEAST_WORDS, LEAST_PERIODS = 6, 4

RUNS = "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class RangeSuccessor:
    """Wavelet tree over numbers from 0: the smallest number from a bound on within a range of positions."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(values.max()).bit_length()) if len(values) else 1
        self.planes, now = [], values.astype(np.int64)
        for level in range(self.bits - 1, -1, -1):
            bit = (now >> level & 1).astype(bool)
            ones = np.concatenate((np.zeros(1, np.int64), np.cumsum(bit)))
            self.planes.append((level, ones, len(now) - int(ones[-1])))
            now = np.concatenate((now[~bit], now[bit]))

    def _down(self, plane: tuple, a: np.ndarray, b: np.ndarray):
        level, ones, zeros = plane
        one_a, one_b = ones[a], ones[b]
        return level, (a - one_a, b - one_b), (zeros + one_a, zeros + one_b)

    def after(self, low: np.ndarray, high: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Per query the smallest number >= ``least`` at the positions ``low`` to ``high`` - 1; -1 if there is none."""
        a, b, smaller = low, high, np.zeros(len(low), np.int64)
        for plane in self.planes:
            level, zero, one = self._down(plane, a, b)
            right = (least >> level & 1).astype(bool)
            smaller += np.where(right, zero[1] - zero[0], 0)
            a, b = np.where(right, one[0], zero[0]), np.where(right, one[1], zero[1])
        there = (smaller < high - low) & (least >> self.bits == 0)
        a, b, k = low[there], high[there], smaller[there]
        value = np.zeros(len(k), np.int64)
        for plane in self.planes:
            level, zero, one = self._down(plane, a, b)
            left = zero[1] - zero[0]
            right = k >= left
            k = np.where(right, k - left, k)
            a, b = np.where(right, one[0], zero[0]), np.where(right, one[1], zero[1])
            value |= right.astype(np.int64) << level
        out = np.full(len(low), -1, np.int64)
        out[there] = value
        return out


def dyadic_blocks(words: np.ndarray, offsets: np.ndarray) -> tuple[RangeSuccessor, np.ndarray]:
    """The wavelet tree over the suffix array, and the blocks to look up in it: rows of first position, its interval's
    bounds in the tree, and the smallest and largest period that the block's length answers for."""
    n, row = int(offsets[-1]), rows_of(offsets)
    end = offsets[1:][row]
    name = np.zeros(n, np.int64)

    def regroup(key: np.ndarray, at: np.ndarray, base: np.ndarray | int) -> np.ndarray:
        """Names the positions ``at`` (whole groups, which start at ``base``) by ``key``; returns those whose name
        recurs, with the size of their group."""
        order = np.argsort(key, kind="stable")
        at, key = at[order], key[order]
        heads = np.flatnonzero(np.diff(key, prepend=key[0] - 1) != 0)
        size = np.diff(np.append(heads, len(key)))
        if isinstance(base, np.ndarray):
            base = base[order]
            first = np.flatnonzero(np.diff(base, prepend=base[0] - 1) != 0)
            place = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key)))) + base
        else:
            place = np.arange(len(key))
        name[at] = np.repeat(place[heads], size)
        size = np.repeat(size, size)
        return np.stack((at[size > 1], size[size > 1]))

    empty = RangeSuccessor(np.zeros(0, np.int64)), np.zeros((5, 0), np.int64)
    if n == 0:
        return empty
    active, length, looked, twice = regroup(row * (int(words.max()) + 1) + words, np.arange(n), 0), 1, [], None
    while active.shape[1]:
        at = active[0]
        follow = at + length
        second = np.where(follow < end[at], name[np.minimum(follow, n - 1)], -1)
        base = name[at]
        active, length = regroup(base * (n + 1) + second + 1, at, base), 2 * length
        if twice is None:
            twice = active[0]  # two words that recur: only these suffixes can lie in an interval
        low, high = -(-(2 * length - 1) // 3), -(-(4 * length - 1) // 3) - 1
        at = active[0]
        active = active[:, (offsets[1:] - offsets[:-1])[row[at]] >= LEAST_PERIODS * low]
        block = active[:, active[0] % length == 0]
        k = block.shape[1]
        looked.append(np.stack((block[0], name[block[0]], block[1], np.full(k, low), np.full(k, high))))
    blocks = np.concatenate(looked, axis=1) if looked else empty[1]
    if not blocks.shape[1]:
        return empty
    suffixes = twice[np.lexsort((twice, name[twice]))]
    start = np.searchsorted(name[suffixes], blocks[1])
    return RangeSuccessor(suffixes), np.stack((blocks[0], start, start + blocks[2], blocks[3], blocks[4]))


def alike(words: np.ndarray, a: int, b: int, end: int) -> int:
    """How many words from ``a`` on equal those from ``b`` > ``a`` on, up to ``end``."""
    done, step = 0, 32
    while b + done < end:
        m = min(step, end - b - done)
        odd = words[a + done:a + done + m] != words[b + done:b + done + m]
        if odd.any():
            return done + int(odd.argmax())
        done, step = done + m, step * 4
    return done


def alike_before(words: np.ndarray, a: int, b: int, start: int) -> int:
    """How many words before ``a`` equal those before ``b`` > ``a``, back to ``start``."""
    done, step = 0, 32
    while a - done > start:
        m = min(step, a - done - start)
        odd = words[a - done - m:a - done] != words[b - done - m:b - done]
        if odd.any():
            return done + int(odd[::-1].argmax())
        done, step = done + m, step * 4
    return done


def candidates(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Distinct (period, position) candidates in ascending order."""
    tree, (at, low, high, least, most) = dyadic_blocks(words, offsets)
    hits = np.full((3, len(at)), -1, np.int64)  # distances of the next three occurrences in the window
    alive, bound = np.arange(len(at)), at + least
    for k in range(3):
        distance = tree.after(low[alive], high[alive], bound[alive]) - at[alive]
        inside = (distance >= 0) & (distance <= most[alive])
        alive, distance = alive[inside], distance[inside]
        hits[k, alive] = distance
        bound[alive] = at[alive] + distance + 1
    few = hits[2] < 0
    out = [np.stack((hits[k, m], at[m])) for k in (0, 1) for m in (few & (hits[k] >= 0),)]
    many = np.flatnonzero(~few)
    if len(many):
        stretch: dict[int, tuple[int, int]] = {}

        def periodic_to(x: int, r: int, end: int) -> int:
            """End of the stretch of period ``r`` around the block at ``x``."""
            known = stretch.get(r, (0, 0))
            if not known[0] <= x < known[1] - r:
                known = stretch[r] = x, x + r + alike(words, x, x + r, end)
            return known[1]

        ends = offsets[np.searchsorted(offsets, at[many], side="right")]
        far = []
        for i, d, r, end in zip(at[many].tolist(), hits[0, many].tolist(), (hits[1] - hits[0])[many].tolist(),
                                ends.tolist()):
            far.append(periodic_to(i + d, r, end) - periodic_to(i, r, end))
        q = np.array(far, np.int64)
        fits = (q >= least[many]) & (q <= most[many])
        out.append(np.stack((q[fits], at[many][fits])))
    return np.unique(np.concatenate(out, axis=1), axis=1)


def find_runs(words: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows of start, length and period of all runs, by start and period; positions count over all documents, whose
    words lie one after another, cut at ``offsets``."""
    pairs = candidates(words, offsets)
    out, k, n = [], 0, pairs.shape[1]
    periods, places = pairs
    bounds = np.searchsorted(offsets, places, side="right")
    while k < n:
        q, i, doc = int(periods[k]), int(places[k]), int(bounds[k])
        s = i - alike_before(words, i, i + q, int(offsets[doc - 1]))
        same = i + alike(words, i, i + q, int(offsets[doc]))
        if same + q - s >= max(LEAST_WORDS, LEAST_PERIODS * q):
            out.append((s, same + q - s, q))
        stop = int(np.searchsorted(periods, q, side="right"))
        k = max(k + 1, k + int(np.searchsorted(places[k:stop], same)))  # the rest of this stretch says the same
    runs = np.array(out, np.int64).reshape(-1, 3).T
    runs = runs[:, np.lexsort(runs[[2, 1, 0]])]
    new = (np.diff(runs[0], prepend=-1) != 0) | (np.diff(runs[1], prepend=-1) != 0)
    runs = runs[:, new]
    return runs[:, np.lexsort(runs[[2, 0]])]


def periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``runs`` (start, length, period in words, by start and period) and
    ``collapsed``: the words, joined by one space, without those that a run holds after its first period.

    Null, empty and wordless texts give no runs and an empty text; null and repeated ``doc_id`` are carried along, each
    row on its own. A text longer than a slice is handled alone in memory in proportion to its length, in time
    ``n log n``. Other columns are not read, whatever their names. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                words, offsets, vocab = split_words(part.column("text"))
                words = words.astype(np.int64)
                runs = find_runs(words, offsets)
                change = np.zeros(len(words) + 1, np.int64)
                np.add.at(change, runs[0] + runs[2], 1)
                np.add.at(change, runs[0] + runs[1], -1)
                kept = np.cumsum(change[:-1]) == 0
                ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(kept)))[offsets]
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), vocab.take(pa.array(words[kept])))
                row = np.searchsorted(offsets, runs[0], side="right") - 1
                items = pa.StructArray.from_arrays(
                    [pa.array(runs[0] - offsets[row]), pa.array(runs[1]), pa.array(runs[2])],
                    ["start", "length", "period"])
                heads = np.searchsorted(row, np.arange(part.num_rows + 1))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(pa.array(heads, pa.int32()), items),
                     pc.binary_join(lists, " ")], ["doc_id", "runs", "collapsed"])

    return docs.select("doc_id", F.col(text).alias("text")).mapInArrow(run, RUNS)


def with_planted_tails(doc_id: Column, text: Column) -> Column:
    """``text`` with the contract's periodic tail: for a document whose ``crc32`` of its decimal id is a multiple of
    10, ``g`` that number without its last digit, the ``n`` words from ``a = g % n`` on repeat the first
    ``1 + (n - a) div (3 + g % 8)`` of them. All other texts, null ids included, stay as they are."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    words = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))

    def tail(w: Column) -> Column:
        n = F.size(w)
        a = (g % n).cast("int")
        p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
        again = F.flatten(F.array_repeat(F.slice(w, a + 1, p), F.ceil((n - a) / p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(w, F.lit(1), a), F.slice(again, F.lit(1), n - a)), " "))

    # One-element array: the words are split once, and the lambda's variable stands for them.
    planted = F.coalesce(F.transform(F.array(words), tail)[0], F.lit(""))
    return F.when((h % 10 == 0) & text.isNotNull(), planted).otherwise(text)


def described(runs: DataFrame) -> DataFrame:
    """The contract's columns of ``periodic_runs``: number of runs, the longest one, and digests of all runs and of the
    collapsed text."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"),
                                                              (-r["start"]).alias("start"),
                                                              (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = runs.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"))
