"""MinHash with tensored banding against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import tensored
from tessera.llm.groups import hubs_of
from tessera.llm.tensored import SIDE, half_keys, near_duplicates, table_pairs, width
from tests.llm.cases import SCHEMA, corpus, rows
from tests.llm.test_text_joins import near_group, shingles


def brute(pairs, percent):
    """Component of each id; rows that repeat an id are one document."""
    sets = [(i, shingles(t)) for i, t in pairs if i is not None]
    sets = [(i, s) for i, s in sets if s]
    parent = {i: i for i, _ in pairs if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, s) in enumerate(sets):
        for b, u in sets[k + 1:]:
            both = len(s & u)
            if both and 100 * both >= percent * len(s | u):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in parent}


def families(seed=2):
    """Originals with chains and stars of edits, some of them between originals only; every size of difference."""
    rng, out, at = random.Random(seed), [], 5000
    for f in range(12):
        words = [f"f{f}w{k}" for k in range(rng.choice([12, 40, 90, 200]))]
        line = [words]
        for _ in range(14):
            w = list(rng.choice(line))
            for _ in range(rng.choice([1, 1, 2, 3, 6])):
                k = rng.randrange(len(w))
                w[k:k + 1] = rng.choice([[f"x{rng.randrange(4)}"], [], [w[k], "new"]])
            line.append(w)
        rng.shuffle(line)
        for w in line[:-1] if f % 2 else line:
            out.append((at, " ".join(w)))
            at += 1
    rng.shuffle(out)
    return out


def test_components(spark):
    """One run over everything: families of edits, edge cases, and ids that repeat with other texts."""
    a, b = (" ".join(f"{x}{k}" for k in range(60)) for x in "ab")
    pairs = corpus() + near_group(40) + families()
    pairs += [(9001, a), (9002, b), (9002, a + " one"), (9003, b + " two"), (9003, None), (9004, "else")]
    want = brute(pairs, 85)
    out = near_duplicates(spark.createDataFrame(rows(pairs), SCHEMA).repartition(3)).collect()
    assert len(out) == len(pairs)
    for r in out:
        if r.doc_id is None:
            assert (r.component_id, r.class_id, r.kept) == (None, None, True)
        elif (r.doc_id, r.n_shingles) == (9003, 0):
            assert r.component_id == 9003  # a wordless row stands alone
        else:
            assert (r.component_id, r.kept) == (want[r.doc_id], want[r.doc_id] == r.doc_id), r
    assert {want[i] for i in (9001, 9002, 9003)} == {9001}
    assert sorted(r.n_shingles for r in out) == sorted(len(shingles(t)) for _, t in pairs)
    assert len(set(want.values())) < len(want) - 60


def test_tables_without_words(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    docs = spark.createDataFrame([(1, None), (2, " "), (None, "a b")], "doc_id long, text string")
    out = sorted(((r.doc_id or 0, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(docs).collect()))
    assert out == [(0, 1, None, True), (1, 0, 1, True), (2, 0, 2, True)]


def test_half_keys_meet_as_often_as_they_should():
    rng = np.random.default_rng(4)
    sets, k = [], width(0.85)
    for _ in range(400):
        x = rng.integers(0, 1 << 63, 370, dtype=np.uint64)
        sets += [np.sort(x[:340]), np.sort(np.concatenate((x[:310], x[340:])))]  # 310 of 370 in common
    keys = half_keys(sets, k).reshape(400, 2, 2 * SIDE)
    meet = (keys[:, 0] == keys[:, 1]).mean()
    assert abs(meet - (310 / 370) ** k) < 0.03
    assert ((keys[:, 0] == keys[:, 1])[:, :SIDE].any(1) & (keys[:, 0] == keys[:, 1])[:, SIDE:].any(1)).all()
    assert [width(t) for t in (0.5, 0.75, 0.85, 0.95, 1)] == [1, 2, 4, 13, 16]
    assert 2 * (1 - 0.85 ** k) ** SIDE < 1e-6


def test_a_task_makes_a_bounded_number_of_table_rows(spark, monkeypatch):
    """Sets are few bytes until they become a row for each table: 300 of them 120,000 rows."""
    made = []
    monkeypatch.setattr(tensored, "TABLE_ROWS", 10_000, raising=False)
    monkeypatch.setattr(tensored, "hubs_of", lambda tables, keys: made.append(tables) or hubs_of(tables, keys))
    halves = {x: ([x % 150 * 100 + k for k in range(SIDE)], [-x % 150 * 100 - k - 1 for k in range(SIDE)])
              for x in range(300)}
    mine = spark.createDataFrame([(x, 50 + x // 150, a, b) for x, (a, b) in halves.items()],
                                 "x long, n long, a array<long>, b array<long>")
    left = spark.createDataFrame([(x, 60) for x in halves if x != 7], "x long, most long")
    pairs = table_pairs(mine, left).select("x", "hub").collect()
    assert sorted(map(tuple, pairs)) == [(x + 150, x) for x in range(150) if x != 7]
    rows = [r["count"] for r in made[0].groupBy(F.spark_partition_id()).count().collect()]
    assert sum(rows) == 299 * SIDE * SIDE and max(rows) < 30_000


def test_no_set_that_others_may_link_with(spark):
    empty = spark.createDataFrame([], "x long, n long, a array<long>, b array<long>")
    assert table_pairs(empty, spark.createDataFrame([], "x long, most long")).count() == 0
