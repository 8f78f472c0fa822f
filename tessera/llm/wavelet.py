"""Token files: every shard is a wavelet matrix, a stack of bit planes with rank support.

``write_tokens`` deals the documents out by ranges of ``doc_id``, tokenizes them in ascending order and writes one row
per shard of at most ``shard_tokens`` ids to a zstd-compressed Parquet folder (Spark's committer keeps a lost task's
files out). A document may span shards. ``read_documents`` decodes the folder again; ``Shard`` gives random access,
counting and occurrence lookup on one row without decoding it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import slices
from tessera.llm.tokens import word_table

BLOCK = 512  # bits between two stored ranks

#: Text bytes that a task encodes at once, and distinct pieces that a worker remembers between its tasks.
SLICE, PIECES = 8 << 20, 1_000_000

SHARDS = ("part int, shard int, part_offset long, first_row long, n_tokens long, zeros array<long>, planes binary, "
          "ranks binary, doc_ids array<long>, doc_starts array<long>, doc_lengths array<long>")


def build(ids: np.ndarray) -> dict:
    """Bit planes of ``ids`` from the highest bit down: each plane holds one bit of the ids in their present order,
    then those with 0 go before those with 1. ``ranks``: ones before each block of ``BLOCK`` bits."""
    n = len(ids)
    now = ids.astype(np.uint16 if n and ids.max() < 1 << 16 else np.uint32)
    levels = max(1, int(now.max()).bit_length()) if n else 1
    zeros, planes, ranks = [], [], []
    for level in range(levels - 1, -1, -1):
        bit = (now >> level) & 1 == 1
        packed = np.packbits(bit, bitorder="little")
        planes.append(np.pad(packed, (0, -len(packed) % (BLOCK // 8))))
        ones = np.bitwise_count(planes[-1].view(np.uint64)).reshape(-1, BLOCK // 64).sum(1)
        ranks.append((np.cumsum(ones) - ones).astype("<u4"))
        zeros.append(int(n - bit.sum()))
        now = np.concatenate((now[~bit], now[bit]))
    return {"zeros": zeros, "planes": np.concatenate(planes).tobytes(), "ranks": np.concatenate(ranks).tobytes()}


class Shard:
    """Access to one shard's ids; positions count from 0 within the shard."""

    def __init__(self, n_tokens: int, zeros, planes: bytes, ranks: bytes):
        self.n, self.zeros, self.levels = n_tokens, list(zeros), len(zeros)
        self.planes = np.frombuffer(planes, np.uint8).reshape(self.levels, -1)
        self.ranks = np.frombuffer(ranks, "<u4").reshape(self.levels, -1)

    def _bit(self, level: int, at: np.ndarray) -> np.ndarray:
        return self.planes[level][at >> 3] >> (at & 7) & 1

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each position: the block's stored rank and a count within the block."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        block = np.minimum(at // BLOCK, max(self.ranks.shape[1] - 1, 0))
        if not self.n:
            return np.zeros_like(at)
        bits = np.unpackbits(self.planes[level].reshape(-1, BLOCK // 8)[block], axis=1, bitorder="little")
        inside = np.arange(BLOCK) < (at - block * BLOCK)[:, None]
        return self.ranks[level][block].astype(np.int64) + (bits * inside).sum(1, dtype=np.int64)

    def access(self, at) -> np.ndarray:
        """Ids at the given positions."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.uint32)
        for level in range(self.levels):
            bit, ones = self._bit(level, at), self._ones(level, at)
            out = out << 1 | bit
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones).astype(np.int64)
        return out

    def rank(self, token: int, at: int) -> int:
        """Occurrences of ``token`` before a position."""
        low, high = self._range(token, at)
        return high - low

    def count(self, token: int) -> int:
        return self.rank(token, self.n)

    def select(self, token: int, k: int) -> int:
        """Position of the occurrence number ``k`` of ``token``, from 0."""
        low, high = self._range(token, self.n)
        if not 0 <= k < high - low:
            raise IndexError(f"token {token} occurs {high - low} times")
        at = low + k
        for level in range(self.levels - 1, -1, -1):
            one = token >> (self.levels - 1 - level) & 1
            at = self._find(level, at - (self.zeros[level] if one else 0), one)
        return at

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.count(token))]

    def _range(self, token: int, at: int) -> tuple[int, int]:
        if token >> self.levels:
            return 0, 0
        low, high = 0, at
        for level in range(self.levels):
            ones = self._ones(level, np.array([low, high]))
            if token >> (self.levels - 1 - level) & 1:
                low, high = (int(x) + self.zeros[level] for x in ones)
            else:
                low, high = low - int(ones[0]), high - int(ones[1])
        return low, high

    def _find(self, level: int, k: int, one: int) -> int:
        """Position of the bit number ``k`` (from 0) that equals ``one``: its block by binary search, then within."""
        ranks = self.ranks[level].astype(np.int64)
        before = ranks if one else np.arange(len(ranks)) * BLOCK - ranks
        block = int(np.searchsorted(before, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level][block * BLOCK // 8:(block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.flatnonzero(bits == one)[k - before[block]])

    def decode(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = np.uint16 if self.levels <= 16 else np.uint32
        now = np.zeros(self.n, kind)
        for level in range(self.levels - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            up = np.empty(self.n, kind)
            up[~bit] = now[:self.zeros[level]]
            up[bit] = now[self.zeros[level]:] | kind(1 << (self.levels - 1 - level))
            now = up
        return now.astype("<u4")


def write_tokens(docs: DataFrame, path: str, tokenizer: str = "word_bpe_49k.json", drops_space: bool = True,
                 end_id: int = 2, shard_tokens: int = 1 << 20) -> None:
    """Tokenizes ``docs`` (``doc_id``, ``text``; null text as empty, null ids first, equal ids by text; other columns
    are not read) and writes the shards to ``path``. An empty table gives an empty folder of the same schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        table, part = word_table(tokenizer, drops_space, PIECES), TaskContext.get().partitionId()
        schema = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("part_offset", pa.int64()),
                            ("first_row", pa.int64()), ("n_tokens", pa.int64()), ("zeros", pa.list_(pa.int64())),
                            ("planes", pa.binary()), ("ranks", pa.binary()), ("doc_ids", pa.list_(pa.int64())),
                            ("doc_starts", pa.list_(pa.int64())), ("doc_lengths", pa.list_(pa.int64()))])
        shard = offset = row = held = 0
        ids: list[np.ndarray] = []
        here: list[tuple] = []  # doc_id, start in the document, length

        def closed() -> pa.RecordBatch:
            nonlocal shard, offset, row, held, ids, here
            flat = np.concatenate(ids)
            out = {"part": part, "shard": shard, "part_offset": offset, "first_row": row, "n_tokens": held,
                   **build(flat), "doc_ids": [h[0] for h in here], "doc_starts": [h[1] for h in here],
                   "doc_lengths": [h[2] for h in here]}
            shard, offset, row = shard + 1, offset + held, row + len(here) - 1
            held, ids, here = 0, [], []
            return pa.RecordBatch.from_pylist([out], schema)

        for batch in batches:
            for piece in slices(batch, limit=SLICE):
                got, at = table.encode(piece.column("text"), end_id)
                for doc_id, a, b in zip(piece.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    start, first = a, True
                    while a < b:
                        if held == shard_tokens:
                            yield closed()
                            row += first  # this document begins in the next shard
                        take = min(b - a, shard_tokens - held)
                        ids.append(got[a:a + take])
                        here.append((doc_id, a - start, take))
                        held, a, first = held + take, a + take, False
        if here:
            yield closed()

    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = docs.select("doc_id", "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(run, SHARDS).write.option("compression", "zstd").parquet(path)


def combined_crc(first: int, second: int, length: int) -> int:
    """crc32 of two byte strings joined, from theirs and the length of the second (linear over GF(2))."""
    def times(m, v):
        out = 0
        for row in m:
            if v & 1:
                out ^= row
            v >>= 1
        return out

    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit
    for _ in range(3):
        step = [times(step, r) for r in step]  # one zero byte
    while length:
        if length & 1:
            first = times(step, first)
        step, length = [times(step, r) for r in step], length >> 1
    return first ^ second


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document from the files: ``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``
    (with the end id), ``ids_crc32``. Parts of a document that spans shards are joined by its row in its range."""
    shards = spark.read.schema(SHARDS).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                (r,) = batch.slice(i, 1).to_pylist()  # one shard's planes at a time
                ids = Shard(r["n_tokens"], r["zeros"], r["planes"], r["ranks"]).decode()
                ends = np.cumsum(r["doc_lengths"])
                starts = ends - r["doc_lengths"]
                crc = [zlib.crc32(ids[a:b].tobytes()) for a, b in zip(starts, ends)]
                k = len(crc)
                yield pa.RecordBatch.from_arrays([
                    pa.array([r["part"]] * k, pa.int32()), pa.array(r["first_row"] + np.arange(k)),
                    pa.array(r["doc_ids"], pa.int64()), pa.array(r["part_offset"] + starts - r["doc_starts"]),
                    pa.array(r["doc_starts"], pa.int64()), pa.array(r["doc_lengths"], pa.int64()),
                    pa.array(crc, pa.int64())], ["part", "row", "doc_id", "at", "doc_start", "length", "crc"])

    rows = shards.mapInArrow(run, "part int, row long, doc_id long, at long, doc_start long, length long, crc long")
    docs = rows.groupBy("part", "row").agg(
        F.min("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("length").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("doc_start", "length", "crc"))).alias("parts"))
    sizes = shards.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))  # one row per range
    before = sizes.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens"))
                          .alias("part_start"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = []
            for parts in batch.column("parts").to_pylist():
                value = parts[0]["crc"]
                for p in parts[1:]:
                    value = combined_crc(value, p["crc"], 4 * p["length"])
                crc.append(value)
            kept = [batch.column(c) for c in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(crc, pa.int64())],
                                             ["doc_id", "start", "n_tokens", "ids_crc32"])

    return (docs.join(before, "part").select("doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens",
                                             "parts")
            .mapInArrow(join, "doc_id long, start long, n_tokens long, ids_crc32 long"))
