"""Source divergence against brute force."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm import divergence
from tessera.llm.divergence import lettered, share, source_divergence
from tests.llm.cases import SCHEMA, corpus

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=10, top=10):
    """``docs``: (text, lang, source)."""
    count, seen, groups = collections.Counter(), collections.Counter(), set()
    for t, lang, source in docs:
        w = TERM.findall((t or "").translate(LOWER))
        groups.add((lang or "", source or ""))
        count.update((lang or "", source or "", x) for x in w)
        seen.update((lang or "", x) for x in set(w))
    out = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = [x for (g, x), n in seen.items() if g == lang and n >= least]
        names = sorted(s for g, s in groups if g == lang)

        def shares(n):
            whole = sum(n.values()) + 2 * len(kept)
            return {x: 1 + 10 ** 9 * (n[x] + 2) // whole for x in kept}

        own = {s: {x: count[lang, s, x] for x in kept} for s in names}
        p = {s: shares(own[s]) for s in names}
        q = shares({x: sum(own[s][x] for s in names) for x in kept})
        for s in names:
            pair = sorted(((-sum(f(p[s][x], p[o][x]) for x in kept), o.encode(), o) for o in names if o != s))
            out += [(lang, s, "pair", o, -v, k + 1) for k, (v, _, o) in enumerate(pair)]
            term = sorted((-f(p[s][x], q[x]), x.encode(), x) for x in kept if own[s][x] and p[s][x] > q[x])[:top]
            out += [(lang, s, "term", x, -v, k + 1) for k, (v, _, x) in enumerate(term)]
    return out


def table():
    rng = random.Random(11)
    docs = [(i, t, rng.choice(["en", "de", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "é", None, "S1"]))
            for i, t in corpus()]
    docs += [(900 + i, "Rare Words é日本 x-ray it's A1b2 " + "zeta " * (i % 5), "fr", f"f{i % 4}") for i in range(60)]
    docs += [(2000, "lonely", "it", "only"), (2001, None, "xx", "a"), (2002, "", "xx", "b"), (None, "few", "xx", "c")]
    return [(i, t, lang, source, 0, "x", "y", 9, "z") for i, t, lang, source in docs]


def test_source_divergence(spark):
    data = table()
    out = source_divergence(spark.createDataFrame(data, SCHEMA).repartition(5)).collect()
    assert sorted(map(tuple, out)) == sorted(brute([r[1:4] for r in data]))
    assert {r.part for r in out} == {"pair", "term"}


def test_runs_and_corrections_in_small_blocks(monkeypatch):
    """Full blocks, terms that go on over batches and full sums change nothing."""
    data = table()
    batch = pa.RecordBatch.from_pydict({c: pa.array([r[k] for r in data], pa.string())
                                        for k, c in ((1, "text"), (2, "lang"), (3, "source"))})

    def index():
        made = pa.Table.from_batches([x for k in range(0, len(data), 7) for x in divergence.runs([batch.slice(k, 7)])])
        made = made.sort_by([(c, "ascending") for c in ("lang", "term", "source")])
        out = pa.Table.from_batches(list(divergence.merged(3)(made.to_batches(max_chunksize=5))))
        t = out.filter(pc.not_equal(out["term"], ""))
        t = t.append_column("whole", pa.array(np.full(len(t), 977))).append_column(
            "lang_whole", pa.array(np.full(len(t), 2211)))
        found = pa.Table.from_batches(list(divergence.corrections(4)(t.to_batches(max_chunksize=9))))
        pairs = collections.Counter()
        for r in found.to_pylist():
            if r["part"] == "pair":
                pairs[r["lang"], r["a"], r["b"]] += r["value"]
        return sorted(map(tuple, (r.values() for r in out.to_pylist()))), {k: v for k, v in pairs.items() if v}

    want = index()
    for name, value in (("BLOCK", 30), ("SUMS", 6), ("AT_ONCE", 3)):
        monkeypatch.setattr(divergence, name, value)
    assert index() == want and want[1]


def test_empty_and_exact_arithmetic(spark):
    assert source_divergence(spark.createDataFrame([], SCHEMA)).count() == 0
    for n, whole in ((0, 1), (10 ** 13, 10 ** 13 + 7), (123456789, 987654321), (9 * 10 ** 13, 9 * 10 ** 14 - 1)):
        assert share(np.array([n]), np.array([whole]))[0] == 1 + 10 ** 9 * (n + 2) // whole
    got = lettered(pa.array(["skip", "Ab-c\x00É[z", None, ""]).slice(1))
    assert got.to_pylist() == ["ab c É z", "", ""]
