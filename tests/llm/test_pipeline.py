"""The pipeline's stages, each against brute force on its own input."""

import os
import re

import pytest

import corpus_pipeline as P
from tests.llm.cases import SCHEMA, corpus, rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    columns, got = docs.columns, {}
    before = {r.doc_id: r.text for r in docs.collect()}
    for name, stage in P.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got[name] = docs.collect()
        assert name == "packing" or docs.columns == columns
    assert [n for n, _ in P.STAGES] == ["quality", "exact_dedup", "near_dedup", "mixing", "packing"]
    ids = {n: {r.doc_id for r in got[n]} for n in got}
    right = sum((i in ids["quality"]) == (q == 1) for i, q in labels.items())
    assert right >= 0.95 * len(labels)
    texts = {norm(before[i]) for i in ids["quality"]}
    assert sorted(norm(r.text) for r in got["exact_dedup"]) == sorted(texts)
    sets = {r.doc_id: shingles(r.text) for r in got["exact_dedup"]}
    parent = {i: i for i in sets}
    for a in sorted(sets):
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]) > 0:
                ra, rb = a, b
                while parent[ra] != ra:
                    ra = parent[ra]
                while parent[rb] != rb:
                    rb = parent[rb]
                parent[max(ra, rb)] = min(ra, rb)
    assert ids["near_dedup"] == {i for i in parent if parent[i] == i}
    assert ids["mixing"] <= ids["near_dedup"] == ids["packing"] | (ids["near_dedup"] - ids["mixing"])
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in got["near_dedup"])
    mixed = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in got["mixing"])
    assert abs(mixed - words) <= 0.1 * words
    assert len({(r.sequence_id >> 32, r.row_in_split) for r in got["packing"]}) == len(got["mixing"])
    assert P.run(spark, SF).columns == [f for f in got["packing"][0].asDict()]


def test_stages_on_awkward_rows(spark, tmp_path):
    """Nulls, empty and long texts, ties, repeats, missing ids and clashing columns, through all stages."""
    docs, got = spark.createDataFrame(rows(corpus()), SCHEMA), {}
    columns = docs.columns
    given = docs.collect()
    for name, stage in P.STAGES[1:]:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == columns
        got[name] = docs.collect()
    assert sorted(norm(r.text) for r in got["exact_dedup"]) == sorted({norm(r.text) for r in given})
    named = {r.doc_id: shingles(r.text) for r in got["exact_dedup"] if r.doc_id is not None}
    least = {i: i for i in named}
    for _ in named:  # the smallest id that links reach
        old = dict(least)
        for a in named:
            for b in named:
                if 100 * len(named[a] & named[b]) >= 75 * len(named[a] | named[b]) > 0:
                    least[a] = min(least[a], least[b])
        if old == least:
            break
    nameless = sum(r.doc_id is None for r in got["exact_dedup"])
    assert sorted(r.doc_id for r in got["near_dedup"] if r.doc_id is not None) == sorted(
        i for i in least if least[i] == i)
    assert sum(r.doc_id is None for r in got["near_dedup"]) == nameless
    near = {tuple(r) for r in got["near_dedup"]}
    assert {tuple(r) for r in got["mixing"]} <= near
    assert len({(r.sequence_id >> 32, r.row_in_split) for r in got["packing"]}) == len(got["mixing"])
    assert {r.doc_id for r in got["packing"]} == {r.doc_id for r in got["mixing"]}


@pytest.mark.parametrize("n", range(1, 5))
def test_stages_on_no_rows(spark, n):
    docs = spark.createDataFrame([], SCHEMA)
    assert P.STAGES[n][1](spark, docs, SF).count() == 0
