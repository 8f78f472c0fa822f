"""Exact dedup and mixing against brute force."""

import collections
import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tessera.llm.dedup import deduplicated, exact_duplicates
from tessera.llm.mixing import mix, repeated, targets
from tests.llm.cases import SCHEMA, corpus, rows


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


@pytest.mark.parametrize("chunk_hash", [F.xxhash64, lambda c: F.length(c).cast("long") % 3])
def test_exact_duplicates(spark, chunk_hash):
    pairs = corpus()
    groups = collections.defaultdict(list)
    for i, t in pairs:
        groups[norm(t)].append((-len(t or ""), i is None, i or 0))
    want = collections.Counter()
    for i, t in pairs:
        g = groups[norm(t)]
        first = min(g)
        want[i, None if first[1] else first[2], len(g), hashlib.sha256(norm(t).encode()).hexdigest()] += 1
    got = exact_duplicates(spark.createDataFrame(rows(pairs), SCHEMA), chunk_hash).collect()
    assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert collections.Counter(r.text_sha256 for r in got if r.kept) == {hashlib.sha256(k.encode()).hexdigest(): 1
                                                                       for k in groups}


def test_deduplicated_keeps_one_row_of_each_text_and_all_columns(spark):
    pairs = corpus()
    docs = spark.createDataFrame(rows(pairs), SCHEMA)
    out = deduplicated(docs)
    assert out.columns == docs.columns
    assert sorted(norm(r.text) for r in out.collect()) == sorted({norm(t) for _, t in pairs})


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_duplicates(none).count() == deduplicated(none).count() == mix(none).count() == 0
    assert repeated(none).count() == 0


def fill(sizes, weights=(5, 2, 1), most=3):
    """Targets by resharing the excess until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % 3] for k, s in enumerate(names)}
    full, left = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        share = {s: left * weight[s] / max(1, sum(weight[x] for x in free)) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 1}, {"a": 5, None: 100, "B": 3, "é": 7, "z": 0},
                                   {"x": 0}, {"a": 1, "b": 1, "c": 1, "d": 10000}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in targets(df).collect()}
    want = fill(sizes)
    assert got.keys() == want.keys()
    for s in got:
        assert got[s] == pytest.approx(want[s])


def test_mix_is_near_its_targets_and_repeats_rows(spark):
    pairs = [(i, "w " * (1 + i % 17)) for i in range(900)] + [(1000, None), (1001, ""), (None, "a b")]
    docs = spark.createDataFrame(rows(pairs, lambda k: [None, "a", "b", "c"][min(3, k % 11)]), SCHEMA)
    out = mix(docs).collect()
    assert len(out) == len(pairs) and out[0].asDict().keys() >= {"doc_id", "size", "source_size", "target", "taken"}
    taken, target = collections.Counter(), {}
    by_id = {i: len((t or "").split()) for i, t in pairs}
    for r in out:
        assert r.size == by_id[r.doc_id] and r.taken <= 3 * r.size
        taken[r.target] += r.taken
        target[r.target] = r.target
    for t in target:
        assert abs(taken[t] - t) <= max(20, 0.02 * t)
    again = {(r.doc_id, r.taken) for r in mix(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.taken) for r in out}
    copies = repeated(docs)
    assert copies.columns == docs.columns
    want = {r.doc_id: r.copies for r in out if r.copies}
    assert dict(collections.Counter(r.doc_id for r in copies.collect())) == want
