"""Cost-balanced packing of documents into training sequences.

Every task tokenizes the documents of its own input split and packs them in blocks of about ``block_tokens`` tokens,
so nothing is shuffled, a lost task is redone from its split alone, and memory follows the block. In a block each
document longer than a sequence first gives off full sequences; what is left of the documents (at most one sequence
long) is assigned by estimated cost: descending, each to the sequence of lowest cost so far that has room for all of
it. A piece that fits in no sequence is cut and its first part fills the sequence of lowest cost that has any room.
A block opens exactly ``ceil(tokens / seq_len)`` sequences, so its padding is below one sequence.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import slices
from tessera.llm.tokens import SLICE, word_table

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "seq_tokens long, padded long, cost double, row_in_split long")


def attention_cost(length, seq_len: int, quadratic: float):
    """Estimated cost of a piece: linear in its tokens plus quadratic for attention within it; ``quadratic`` is the
    attention share of the cost of one piece as long as a sequence, relative to the linear part."""
    return length + quadratic * length * length / seq_len


def assign(lengths: np.ndarray, seq_len: int, quadratic: float) -> list[tuple[int, int, int, int]]:
    """Pieces ``(document, start, length, sequence)`` for documents of the given numbers of tokens."""
    out, sequence = [], 0
    rest = []
    for doc, n in enumerate(lengths.tolist()):
        full = n // seq_len
        for k in range(full):
            out.append((doc, k * seq_len, seq_len, sequence))
            sequence += 1
        if n % seq_len:
            rest.append((doc, full * seq_len, n % seq_len))
    count = -(-sum(r[2] for r in rest) // seq_len)
    room = np.full(count, seq_len, np.int64)
    cost = np.zeros(count)
    rest.sort(key=lambda r: (-r[2], r[0]))
    for doc, start, n in rest:
        while n:
            open_cost = np.where(room >= n, cost, np.inf)
            s = int(open_cost.argmin())
            take = n
            if not np.isfinite(open_cost[s]):
                s = int(np.where(room > 0, cost, np.inf).argmin())
                take = int(room[s])
            out.append((doc, start, take, sequence + s))
            room[s] -= take
            cost[s] += attention_cost(take, seq_len, quadratic)
            start += take
            n -= take
    return out


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", drops_space: bool = False, end_id: int = 1,
         seq_len: int = 2048, quadratic: float = 0.5, block_tokens: int = 2_000_000) -> DataFrame:
    """One row per piece of a document: its place in the document (``start``, ``length``), in its sequence
    (``sequence_id``, ``offset``), the crc32 of its ids, and what its sequence holds (``seq_tokens``; ``padded``:
    tokens after padding to ``seq_len``, or none at a power of two) and costs.

    Null and empty texts are one end token. Rows that repeat are packed like any others; ``row_in_split`` tells them
    apart within a split. An empty table gives no rows. A sequence id is the split's number times 2^32 plus a count.
    Columns besides ``doc_id`` and ``text`` are not read.
    """

    def block(ids: list[np.ndarray], doc_ids: list, first_row: int, first_seq: int) -> tuple[pa.RecordBatch, int]:
        lengths = np.array([len(x) for x in ids])
        pieces = assign(lengths, seq_len, quadratic)
        doc, start, length, seq = (np.array(c, np.int64) for c in zip(*pieces))
        order = np.lexsort((start, doc, seq))  # within a sequence by document
        doc, start, length, seq = doc[order], start[order], length[order], seq[order]
        before = np.cumsum(length) - length
        heads = np.flatnonzero(np.diff(seq, prepend=-1))
        offset = before - np.repeat(before[heads], np.diff(np.append(heads, len(seq))))
        used = np.bincount(seq, weights=length).astype(np.int64)
        cost = np.bincount(seq, weights=attention_cost(length, seq_len, quadratic))
        padded = np.where(used & (used - 1) == 0, used, seq_len)
        crc = [zlib.crc32(ids[d][a:a + n].astype("<u4").tobytes()) for d, a, n in zip(doc, start, length)]
        columns = [pa.array([doc_ids[d] for d in doc], pa.int64()), start, length, pa.array(crc, pa.int64()),
                   lengths[doc], seq + first_seq, offset, used[seq], padded[seq], cost[seq], doc + first_row]
        names = [c.split()[0] for c in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names), first_seq + int(seq.max()) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        table = word_table(tokenizer, drops_space)
        seq, row, held, ids, doc_ids = TaskContext.get().partitionId() << 32, 0, 0, [], []
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                got, at = table.encode(part.column("text"), end_id)
                ids += [got[a:b].astype(np.uint32) for a, b in zip(at[:-1], at[1:])]
                doc_ids += part.column("doc_id").to_pylist()
                held += len(got)
                if held >= block_tokens:
                    out, seq = block(ids, doc_ids, row, seq)
                    yield out
                    row, held, ids, doc_ids = row + len(ids), 0, [], []
        if ids:
            yield block(ids, doc_ids, row, seq)[0]

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)
