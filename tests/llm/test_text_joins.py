"""Substring dedup and the n-gram Jaccard join against brute force."""

import collections
import hashlib
import random
import re

import pyarrow as pa
import pytest

from tessera.llm import groups, jaccard
from tessera.llm.graph import components
from tessera.llm.jaccard import near_duplicates, one_of_each
from tessera.llm.shingles import ngram_sets
from tessera.llm.substrings import remove_duplicate_spans
from tests.llm.cases import SCHEMA, corpus, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_remove_duplicate_spans(spark):
    pairs = corpus()
    first = {}
    for i, t in pairs:
        w = WORD.findall(t or "")
        for k in range(len(w) - 12):
            if i is not None:
                key = tuple(w[k:k + 13])
                first[key] = min(first.get(key, i), i)
    want = collections.Counter()
    for i, t in pairs:
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 12):
            if i is not None and first.get(tuple(w[k:k + 13]), i) < i:
                gone[k:k + 13] = [True] * 13
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        want[i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    out = remove_duplicate_spans(spark.createDataFrame(rows(pairs), SCHEMA).repartition(3)).collect()
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in out) == want
    assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in out)
    assert sum(r.n_removed for r in out) > 0
    assert remove_duplicate_spans(spark.createDataFrame([], SCHEMA)).count() == 0


def shingles(t):
    w = WORD.findall((t or "").translate(ASCII_LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(pairs):
    sets = {i: shingles(t) for i, t in pairs if i is not None}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: (len(sets[i]), root(i)) for i in sets}


def near_group(n):
    """A text and copies with some words changed: many are alike only through the original."""
    words = [f"w{i}" for i in range(80)]
    out = [(1000, " ".join(words))]
    for k in range(1, n):
        w = list(words)
        w[(7 * k) % 78] = f"n{k}"
        w[(7 * k + 31) % 78] = f"m{k}"
        out.append((1000 + k, " ".join(w)))
    return out


def test_near_duplicates(spark):
    pairs = corpus() + near_group(40)
    docs = spark.createDataFrame(rows(pairs), SCHEMA)
    want = brute(pairs)
    out = near_duplicates(docs.repartition(3)).collect()
    assert len(out) == len(pairs)
    for r in out:
        if r.doc_id is None:
            assert r.component_id is None
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id], r
    assert len({c for _, c in want.values()}) < len(want) - 40
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} - {None} == {i for i, (_, c) in want.items() if i == c}
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def loose_group(n):
    """Copies of a text with one to eight of 110 words changed: some link with many, some with none."""
    r = random.Random(3)
    out = []
    for k in range(n):
        words = [f"v{i}" for i in range(110)]
        for i in r.sample(range(110), r.randint(1, 8)):
            words[i] = f"{k}x{i}"
        out.append((5000 + k, " ".join(words)))
    return out


def test_a_large_loose_group_takes_few_comparisons(spark, monkeypatch):
    pairs, compared, made = loose_group(300), groups.compared, []

    def counted(found, *rest):
        made.append(found.count())
        return compared(found, *rest)

    for module in (groups, jaccard):
        monkeypatch.setattr(module, "compared", counted, raising=False)
    out = near_duplicates(spark.createDataFrame(rows(pairs), SCHEMA)).collect()
    want = brute(pairs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == want
    assert 20 < len({c for _, c in want.values()}) < 200
    assert len(made) <= 2 and sum(made) <= 2 * jaccard.SKETCHES * len(pairs) / 2, made


@pytest.mark.parametrize("few", [jaccard.FEW, 2])
def test_the_prefix_join_needs_no_sketch(spark, monkeypatch, few):
    """All links are found where the MinHash keys find none, whether sets of a bucket meet each other or a hub."""
    sketched = jaccard.sketch_pairs
    monkeypatch.setattr(jaccard, "sketch_pairs", lambda *a: sketched(*a).limit(0))
    monkeypatch.setattr(jaccard, "FEW", few)
    pairs = loose_group(60) + near_group(30) + corpus()[:40]
    out = near_duplicates(spark.createDataFrame(rows(pairs), SCHEMA)).collect()
    want = brute(pairs)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in out if r.doc_id is not None)


@pytest.mark.parametrize("extra, short, words", [(0, 40, 1), (10, 6, 1 << 18), (40, 64, 1), (90, 40, 3)])
def test_no_link_is_lost_before_whole_sets_are_made(spark, monkeypatch, extra, short, words):
    """Longer prefixes, hashes that fall together and a full table of bits only change how many candidates are left."""
    for name, value in (("EXTRA", extra), ("SHORT", short), ("WORDS", words)):
        monkeypatch.setattr(jaccard, name, value)
    pairs = loose_group(50) + near_group(20) + corpus()[:40]
    out = near_duplicates(spark.createDataFrame(rows(pairs), SCHEMA)).collect()
    want = brute(pairs)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in out if r.doc_id is not None)


@pytest.mark.parametrize("p", [1, 5, 50, 75, 85, 100])
def test_prefixes_hold_what_linked_sets_share(p):
    """The worst case: the common n-grams come last in both sets."""
    for small in range(1, 120):
        for large in range(small, min(120, 100 * small // p) + 1):
            common = -(-p * (small + large) // (100 + p))  # of Jaccard p percents
            if common <= small:
                left_out = max(n - jaccard.prefix_size(n, p) for n in (small, large))
                assert common - left_out >= max(1, min(jaccard.EXTRA, p) * large // 100)


def test_texts_that_share_little_are_left_out_at_once(spark, monkeypatch):
    """Pairs with a passage in common, which is much less than a link takes: no n-grams and no texts are written."""
    made, settled = [], jaccard.settled

    def counted(df, *more, **named):
        out = settled(df, *more, **named)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "settled", counted)
    r = random.Random(4)
    pairs = [(i, " ".join([f"{i}x{r.random()}" for _ in range(110)] + [f"p{i // 2}x{k}" for k in range(8)]))
             for i in range(60)]
    out = near_duplicates(spark.createDataFrame(rows(pairs), SCHEMA)).collect()
    assert {(x.doc_id, x.component_id) for x in out} == {(i, i) for i, _ in pairs}
    assert max(made) <= 4 * len(pairs) and 0 in made, made


def test_sets_of_short_texts_differ_from_long_ones():
    got = ngram_sets(pa.array(["a b c", "A B C", "a b c d e", "a b c d e f", None, " \t"]), 5)
    assert got[0].tolist() == got[1].tolist() != got[2].tolist()
    assert [len(g) for g in got] == [1, 1, 1, 2, 0, 0]


@pytest.mark.parametrize("links, want", [
    ([(i, i + 1) for i in range(60)], {i: 0 for i in range(61)}),
    ([(5, 2), (2, 9), (7, 7), (30, 20), (20, 30)], {5: 2, 2: 2, 9: 2, 30: 20, 20: 20}),
    ([], {})])
def test_components(spark, links, want):
    df = spark.createDataFrame(links, "a long, b long")
    assert {r.node: r.component for r in components(df).collect()} == want
