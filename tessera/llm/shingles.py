"""Sets of word n-grams as sorted 64-bit hashes, and 128-bit digests of such sets."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tessera.llm.common import hash_words, mixed, split_words, window_hashes


def ngram_sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``n``-word sequences; of the whole text if it has fewer words; empty
    without words. A-Z count as lower case."""
    codes, offsets, vocab = split_words(pc.ascii_lower(pc.fill_null(texts, "")))
    words = hash_words(vocab)[codes]
    grams = window_hashes(words, n)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:]):
        if b - a >= n:
            g = np.sort(grams[a:b - n + 1])
            out.append(g[np.diff(g, prepend=~g[:1]) != 0])
        else:  # hashed with its length, so as not to equal any sequence of n words
            out.append(mixed(window_hashes(words[a:b], b - a) + np.uint64(b - a)) if b > a else words[:0])
    return out


def digests(grams: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set in two numbers: sums over its hashes of two different mixings of them."""
    size = np.array([len(g) for g in grams])
    flat = np.concatenate(grams) if len(grams) else np.zeros(0, np.uint64)
    ends = np.concatenate(([0], np.cumsum(size)))
    out = []
    for salt in (0x1B873593, 0x85EBCA6B):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(flat + np.uint64(salt)), dtype=np.uint64)))
        out.append((total[ends[1:]] - total[ends[:-1]]).view(np.int64))
    return out[0], out[1]
