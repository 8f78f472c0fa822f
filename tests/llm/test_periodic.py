"""Periodic runs against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm.periodic import RangeSuccessor, described, find_runs, periodic_runs, with_planted_tails
from tests.llm.cases import SCHEMA, corpus, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(w):
    """All (start, length, period) by trying every period; the smallest period of a stretch stands for it."""
    n, out = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            if i + q - s >= max(6, 4 * q):
                out.setdefault((s, i + q - s), q)
    return sorted((s, k, q) for (s, k), q in out.items())


def found(w):
    codes = {x: k for k, x in enumerate(dict.fromkeys(w))}
    return [tuple(r) for r in find_runs(np.array([codes[x] for x in w], np.int64), np.array([0, len(w)])).T.tolist()]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.text("ab", min_size=1, max_size=9), st.integers(1, 9)), max_size=8))
def test_runs_of_small_alphabets(pieces):
    w = list("".join(p * k for p, k in pieces))
    assert found(w) == brute(w)


@pytest.mark.parametrize("w", [
    "a" * 5, "a" * 6, "ab" * 3, "ab" * 4, "a" * 40 + "b" + "a" * 40, ("aaab" * 9 + "c") * 5, "abcabcabcabcab" * 6,
    ("a" * 30 + "b") * 5, ("a" * 30 + "b" + "a" * 17 + "c") * 4 + "a" * 20])
def test_nested_and_overlapping_runs(w):
    assert found(list(w)) == brute(list(w))


def test_long_runs():
    rng = random.Random(1)
    for n, p in ((4000, 1), (4000, 37), (3000, 700), (6000, 999)):
        unit = [rng.randrange(50) for _ in range(p)]
        w = [-k for k in range(1, 60)] + [unit[k % p] for k in range(n)] + [-1, -2]
        assert (59, n, p) in found(w)


def test_documents_do_not_touch():
    w, off = np.zeros(40, np.int64), np.array([0, 0, 5, 11, 40])
    assert find_runs(w, off).T.tolist() == [[5, 6, 1], [11, 29, 1]]


def test_range_successor():
    rng = np.random.default_rng(3)
    values = rng.permutation(500)
    tree = RangeSuccessor(values)
    low = rng.integers(0, 500, 300)
    high = np.minimum(500, low + rng.integers(0, 60, 300))
    least = rng.integers(0, 1200, 300)
    want = [min((v for v in values[a:b] if v >= x), default=-1) for a, b, x in zip(low, high, least)]
    assert tree.after(low, high, least).tolist() == want


def planted(i, t):
    w = WORD.findall(t or "")
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def expected(i, t):
    w = planted(i, t)
    runs, keep = brute(w), [True] * len(w)
    for s, n, q in runs:
        keep[s + q:s + n] = [False] * (n - q)
    top = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(runs), *top, 1000 * top[1] // top[2] if runs else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for x, k in zip(w, keep) if k)))


def test_contract_rows(spark):
    pairs = [(i, t) for i, t in corpus() if i != 406]
    pairs += [(i, f"x {i} " + "la la la ho " * (i % 7) + "end") for i in range(1000, 1150)] + [(406, "word " * 800)]
    docs = spark.createDataFrame(rows(pairs), SCHEMA).repartition(3)
    out = described(periodic_runs(docs.withColumn("text", with_planted_tails(F.col("doc_id"), F.col("text"))))).collect()
    want = collections.Counter(expected(i, t) for i, t in pairs)
    assert collections.Counter(tuple(r) for r in out) == want
    assert sum(r.n_runs for r in out) > 50
    assert described(periodic_runs(spark.createDataFrame([], SCHEMA))).count() == 0


def test_operator_gives_texts(spark):
    docs = spark.createDataFrame([(1, "say ho ho ho ho ho ho now"), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in periodic_runs(docs).collect()}
    assert out[1].collapsed == "say ho now" and [tuple(x) for x in out[1].runs] == [(1, 6, 1)]
    assert out[2].collapsed == "" and out[2].runs == []
