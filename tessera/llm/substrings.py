"""Substring dedup by relative Lempel-Ziv parsing of documents against an indexed reference.

The reference is the whole corpus, indexed as blocks: the hash space of all ``window``-word sequences is cut into equal
ranges and block ``f`` holds the sequences of range ``f`` with the smallest ``doc_id`` in which each begins. Every
document is factored against every block: at each of its words the longest run of words that an earlier document has
is followed window by window, and where it ends the next factor is checked from the first window across that boundary
on. Factors of at least ``window`` words are the duplicate spans; the words they cover are removed.

How it runs: a task hashes the windows of a slice of documents, keeps each distinct one once, with the slice's smallest
document, and packs them by block, so a passage that a third of all documents share crosses the network once per slice
and not once per document. Blocks are then joined by sorting arrays. The windows found to be duplicates go back to
their documents by ``doc_id``. Hashes have 64 bits; two different windows of a corpus of a billion windows share one
with a probability of about 0.03.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_words, settled, slices, split_words, text_bytes, window_hashes

#: Text bytes whose windows make a reference block (about 4 million of them).
BLOCK_BYTES = 24 << 20

#: Text bytes that a task hashes at once.
SLICE = 4 << 20

_ENTRIES = "block int, hashes binary, docs binary, counts binary, known_hashes binary, known_docs binary"
_FOUND = "doc_id long, hashes binary"


def windows_of(texts: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and row of every window within one text, and the word offsets of the texts."""
    codes, offsets, vocab = split_words(texts)
    hashes = window_hashes(hash_words(vocab)[codes], window)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = rows[:len(hashes)] == rows[window - 1:] if len(hashes) else np.zeros(0, bool)
    return hashes[inside], rows[:len(hashes)][inside], offsets


def _by_doc(docs: np.ndarray, hashes: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(docs, kind="stable")
    docs, hashes = docs[order], hashes[order]
    heads = np.flatnonzero(np.diff(docs, prepend=docs[0] - 1 if len(docs) else 0))
    for a, b in zip(heads, np.append(heads[1:], len(docs))):
        yield int(docs[a]), hashes[a:b].tobytes()


def _cut(width: np.uint64, blocks: int, hashes: np.ndarray, owner: np.ndarray):
    """Both arrays, ascending in ``hashes``, cut into the blocks."""
    at = np.searchsorted(hashes // width, np.arange(blocks + 1))
    return ((hashes[a:b], owner[a:b]) for a, b in zip(at[:-1], at[1:]))


def duplicate_windows(docs: DataFrame, window: int = 13) -> DataFrame:
    """Per document and block: hashes (8 bytes each) of its windows that also begin in a document of smaller id."""
    blocks = max(24, math.ceil(text_bytes(docs) / BLOCK_BYTES))
    width = np.uint64((1 << 64) // blocks + 1)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.filter(pc.is_valid(batch.column("doc_id"))), limit=SLICE):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                hashes, rows, _ = windows_of(part.column("text"), window)
                owner = ids[rows]
                order = np.lexsort((owner, hashes))
                hashes, owner = hashes[order], owner[order]
                first = np.diff(hashes, prepend=~hashes[:1]) != 0
                smallest = owner[np.maximum.accumulate(np.where(first, np.arange(len(owner)), 0))]
                known = owner > smallest  # duplicates within the slice
                columns = [[], [], []]
                for block_hashes, block_docs in _cut(width, blocks, hashes[first], owner[first]):
                    # by document, each id once with its number of windows: 8 bytes a window and little more
                    order = np.argsort(block_docs, kind="stable")
                    listed, count = np.unique(block_docs, return_counts=True)
                    for column, x in zip(columns, (block_hashes[order], listed, count.astype("<u4"))):
                        column.append(x.tobytes())
                columns += zip(*((h.tobytes(), d.tobytes())
                                 for h, d in _cut(width, blocks, hashes[known], owner[known])))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks, dtype=np.int32)),
                                                  *(pa.array(c, pa.binary()) for c in columns)],
                                                 [c.split()[0] for c in _ENTRIES.split(", ")])

    def found(table: pa.Table) -> pa.Table:
        def column(name, kind):
            return np.concatenate([np.frombuffer(x, kind) for x in table.column(name).to_pylist()])

        hashes, owner = column("hashes", np.uint64), np.repeat(column("docs", np.int64), column("counts", "<u4"))
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        heads = np.flatnonzero(np.diff(hashes, prepend=~hashes[:1]) != 0)
        smallest = np.minimum.reduceat(owner, heads) if len(heads) else owner
        known = owner > np.repeat(smallest, np.diff(np.append(heads, len(owner))))
        rows = list(_by_doc(np.concatenate((owner[known], column("known_docs", np.int64))),
                            np.concatenate((hashes[known], column("known_hashes", np.uint64)))))
        return pa.table([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                        ["doc_id", "hashes"])

    return (docs.select("doc_id", "text").mapInArrow(entries, _ENTRIES)
            .groupBy("block").applyInArrow(found, _FOUND))


def remove_duplicate_spans(docs: DataFrame, window: int = 13) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``n_removed``, ``kept_sha256`` of the ``kept`` words joined by
    one space, and ``spans``, the duplicate factors as first and last word (from 0, the end exclusive).

    Null and empty texts have no words. A document without id neither gives nor loses words; rows with one id are
    judged alike, none being earlier than the other. An empty table gives no rows; other columns are not read.
    """
    found = settled(duplicate_windows(docs, window), large=True)
    per_doc = found.groupBy("doc_id").agg(F.collect_list("hashes").alias("_found"))  # at most the document's windows

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                texts = part.column("text")
                hashes, rows, offsets = windows_of(texts, window)
                codes, _, vocab = split_words(texts)
                starts = np.searchsorted(rows, np.arange(part.num_rows + 1))
                removed = np.zeros(len(codes) + 1, np.int64)
                for i, listed in enumerate(part.column("_found").to_pylist()):
                    if listed:
                        mine = hashes[starts[i]:starts[i + 1]]
                        hits = np.flatnonzero(np.isin(mine, np.frombuffer(b"".join(listed), np.uint64)))
                        np.add.at(removed, offsets[i] + hits, 1)
                        np.add.at(removed, offsets[i] + hits + window, -1)
                gone = np.cumsum(removed[:-1]) > 0
                words = vocab.take(pa.array(codes[~gone]))
                kept_at = np.concatenate(([0], np.cumsum(~gone)))[offsets]
                lists = pa.ListArray.from_arrays(pa.array(kept_at.astype(np.int32)), words)
                kept = pc.binary_join(lists, " ")
                sha = [hashlib.sha256(x.encode()).hexdigest() for x in kept.to_pylist()]
                spans = []
                for a, b in zip(offsets[:-1], offsets[1:]):
                    edge = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                n_words = np.diff(offsets)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n_words), pa.array(n_words - np.diff(kept_at)),
                     pa.array(sha, pa.string()), kept.cast(pa.string()),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
                    ["doc_id", "n_words", "n_removed", "kept_sha256", "kept", "spans"])

    return docs.select("doc_id", "text").join(per_doc, "doc_id", "left").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string, "
             "spans array<struct<start:long,end:long>>")
