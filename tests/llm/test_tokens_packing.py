"""Bulk encoding, packing and token files against the plain library and brute force."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.packing import assign, pack
from tessera.llm.tokens import WordTable
from tessera.llm.wavelet import Shard, build, combined_crc, read_documents, write_tokens

ODD = ["", " ", "  a", "a  b", "a \nb", "a\n b c", "x  y z", " lead", "trail ", "it 's o'clock  's, don't.",
       "　 a", "é é́x y", "a\x1c b", "a \x85b", "<|endoftext|> hi", "A " * 50, "a  b ​ c", None,
       "\x01a \x01 b\x01", "word.\x01 next,", "İ Σas Σ ﻿ k", "a" * 5000, "1 22 333 4,5."]


@pytest.mark.parametrize("file, drops_space", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_bulk_encoding_equals_the_library(file, drops_space):
    rng = random.Random(3)
    alphabet = [" ", " ", "a", "b", "\n", " ", "'s", "1", "!", ".", "é", "́", "\x1c", "　", "\x0b", "ß"]
    texts = ODD + ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 25))) for _ in range(2000)]
    t = WordTable(file, drops_space)
    ids, at = t.encode(pa.array(texts), 7)
    for i, x in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == t.tokenizer.encode(x or "", add_special_tokens=False).ids + [7], x


def test_assign_is_whole_gapless_and_balanced():
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 9000, 300)
    pieces = assign(lengths, 2048, 0.5)
    per_doc, per_seq = {}, {}
    for d, a, n, s in pieces:
        per_doc.setdefault(d, []).append((a, n))
        per_seq[s] = per_seq.get(s, 0) + n
    for d, n in enumerate(lengths):
        at = 0
        for a, k in sorted(per_doc[d]):
            assert a == at
            at += k
        assert at == n
    assert max(per_seq.values()) <= 2048 and sum(2048 - v for v in per_seq.values()) < 2048


def rows(spark, data, schema="doc_id long, text string"):
    return spark.createDataFrame(data, schema)


def test_pack_edge_rows(spark):
    docs = rows(spark, [(1, None, "x"), (2, "", "y"), (None, "word " * 5000, "z"), (3, "same text", "a"),
                        (3, "same text", "a")], "doc_id long, text string, length string")
    out = pack(docs, seq_len=256).collect()
    assert sum(r["length"] for r in out) == sum({(r["sequence_id"] >> 32, r["row_in_split"]): r["doc_tokens"]
                                                 for r in out}.values())
    assert {r["doc_id"]: r["doc_tokens"] for r in out}[1] == 1
    by_seq = {}
    for r in out:
        by_seq.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in by_seq.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 256
    assert pack(rows(spark, [])).count() == 0


@pytest.mark.parametrize("n, top", [(0, 1), (1, 5), (511, 3), (512, 70000), (5000, 49408)])
def test_wavelet_matrix_against_lists(n, top):
    ids = np.random.default_rng(n).integers(0, top, n).astype(np.uint32)
    s = Shard(n, **build(ids))
    assert s.decode().tolist() == ids.tolist()
    if n:
        at = np.random.default_rng(1).integers(0, n, 60)
        assert s.access(at).tolist() == ids[at].tolist()
        for token in {*ids[:5].tolist(), 0, top + 9}:
            assert s.count(token) == (ids == token).sum()
            assert s.rank(token, n // 2) == (ids[:n // 2] == token).sum()
            assert s.occurrences(token) == np.flatnonzero(ids == token).tolist()


def test_combined_crc():
    a, b = b"some bytes", b"more of them" * 99
    assert combined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert combined_crc(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


def test_token_files_round_trip(spark, tmp_path):
    data = [(9, "the last one"), (4, None), (None, "no id"), (2, "long words here " * 900), (7, ""), (4, "again")]
    docs = rows(spark, data)
    write_tokens(docs, str(tmp_path / "t"), shard_tokens=1000)
    got = sorted((tuple(r) for r in read_documents(spark, str(tmp_path / "t")).collect()), key=lambda r: r[1])
    t, start, want = WordTable("word_bpe_49k.json", True).tokenizer, 0, []
    for doc_id, text in sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    write_tokens(rows(spark, []), str(tmp_path / "e"))
    assert read_documents(spark, str(tmp_path / "e")).count() == 0
