"""Approximate nearest neighbours by collision counting.

Vectors are scaled to length 1 and projected on ``PROJECTIONS`` directions, random orthonormal bases one after another.
A block of vectors keeps one sorted array per direction. Around a query's own projection a window is opened in every
array; a vector collides as often as it lies in a window. Windows widen by virtual rehashing, each time by ``WIDEN``,
until enough vectors (``VERIFIED`` of the block, ``LEAST_VERIFIED`` at least) collide in ``THRESHOLD`` of the
arrays or the windows hold everything; those vectors are verified by their cosine. Every row is indexed; nothing is
fitted to the data.

The queries meet all vectors in blocks: each pair of a block of vectors and a chunk of queries is one group of bounded
size, and only its best ``k`` per query leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS, QUERY_ROWS = 16384, 2048
PROJECTIONS, FIRST_WIDTH, WIDEN, THRESHOLD, VERIFIED, LEAST_VERIFIED = 128, 0.9, 1.15, 0.72, 0.06, 200

SCHEMA = "query_id long, vec_id long, score double"


def directions(dim: int, count: int = PROJECTIONS, seed: int = 7) -> np.ndarray:
    """``dim`` rows and at least ``count`` unit columns."""
    rng = np.random.default_rng([seed, dim])
    return np.hstack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(-(-count // dim))])


class CollisionIndex:
    """Sorted projections of one block of vectors."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, self.norms = vectors, np.sqrt((vectors * vectors).sum(1))
        self.basis = directions(vectors.shape[1])
        spread = (vectors / self.norms[:, None]) @ self.basis
        self.order = np.argsort(spread, axis=0, kind="stable").T.astype(np.int32).copy()
        self.sorted = np.sort(spread, axis=0).T.copy()
        self.unit = 1 / np.sqrt(vectors.shape[1])  # the usual size of a projection

    def candidates(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that collide with the query often enough."""
        n, m = len(self.vectors), len(self.sorted)
        enough = min(n, max(k + 1, LEAST_VERIFIED, int(np.ceil(VERIFIED * n))))
        at = query / np.sqrt((query * query).sum()) @ self.basis
        count, width = np.zeros(n, np.int64), FIRST_WIDTH * self.unit
        low = high = None
        while True:
            new_low = [int(np.searchsorted(a, x - width)) for a, x in zip(self.sorted, at)]
            new_high = [int(np.searchsorted(a, x + width, side="right")) for a, x in zip(self.sorted, at)]
            if low is None:
                rings = [o[a:b] for o, a, b in zip(self.order, new_low, new_high)]
            else:
                rings = [o[a:b] for o, a, b in zip(self.order, new_low, low)]
                rings += [o[a:b] for o, a, b in zip(self.order, high, new_high)]
            count += np.bincount(np.concatenate(rings), minlength=n)
            low, high = new_low, new_high
            hits = np.flatnonzero(count >= THRESHOLD * m)
            if len(hits) >= enough or width > 2:  # projections lie between -1 and 1
                return hits
            width *= WIDEN

    def nearest(self, query_id: int, query: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        rows = self.candidates(query, k)
        rows = rows[ids[rows] != query_id]
        score = (self.vectors[rows] * query).sum(1) / (self.norms[rows] * np.sqrt((query * query).sum()))
        best = np.lexsort((ids[rows], -score))[:k]
        return ids[rows][best], score[best]


def _block(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    def read(table):
        ids = table.column("id").to_numpy()
        rows = np.array(table.column("x").to_pylist(), np.float64).reshape(len(ids), -1)
        order = np.lexsort((*rows.T[::-1], ids))
        keep = order[np.diff(ids[order], prepend=ids[order][:1] - 1) != 0]
        return ids[keep], rows[keep]

    out = ([], [], [])
    if left.num_rows and right.num_rows:
        ids, vectors = read(left)
        index = CollisionIndex(vectors)
        for query_id, query in zip(*read(right)):
            near, score = index.nearest(query_id, query, ids, k)
            out[0].append(np.full(len(near), query_id))
            out[1].append(near)
            out[2].append(score)
    columns = [np.concatenate([np.zeros(0, kind), *x]) for x, kind in zip(out, (np.int64, np.int64, np.float64))]
    return pa.table([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])


def usable(embeddings: DataFrame) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows that take part: an id, and a vector that isn't null, empty or
    zero and holds finite numbers alone."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (embeddings.select("vec_id", v.alias("vector")).filter("vec_id is not null and vector is not null")
            .filter(finite & F.exists("vector", lambda x: x != 0)))


def nearest(embeddings: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """For every row whose id ``every`` divides: ``query_id``, ``rank`` (from 1), ``vec_id``, ``score``; the ``k``
    nearest of all other rows found, by cosine, ties by id.

    Vectors of another length aren't comparable and count as no candidates. Of rows that repeat an id the smallest
    vector takes part. An empty table gives no rows; other columns are not read.
    """
    rows = usable(embeddings).withColumn("dim", F.size("vector"))
    queries = rows.filter(F.col("vec_id") % every == 0)
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"),
                                    F.ceil(F.count_if(F.col("vec_id") % every == 0) / QUERY_ROWS).cast("int")
                                    .alias("chunks")).filter("chunks > 0")

    def dealt(df, side, own, others):
        """Each row in its own part of its side, once for every part of the other side."""
        here = F.pmod(F.xxhash64("vec_id"), F.col(own)).cast("int")
        there = F.explode(F.sequence(F.lit(0), F.col(others) - 1))
        return df.join(sizes, "dim").select(F.col("dim").alias(f"dim_{side}"), here.alias(f"own_{side}"),
                                            there.alias(f"other_{side}"), F.col("vec_id").alias("id"),
                                            F.col("vector").alias("x"))

    left, right = dealt(rows, "v", "blocks", "chunks"), dealt(queries, "q", "chunks", "blocks")

    def block(a: pa.Table, b: pa.Table) -> pa.Table:
        return _block(a, b, k)

    best = (left.groupBy("dim_v", "own_v", "other_v").cogroup(right.groupBy("dim_q", "other_q", "own_q"))
            .applyInArrow(block, SCHEMA))
    by_score = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(by_score)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
