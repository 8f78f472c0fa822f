"""Near duplicates by MinHash with tensored banding; every link is verified on the full sets.

A table key of ordinary banding joins ``2 k`` minhashes. Here a document has two small collections of ``SIDE`` half keys
of ``k`` minhashes each, and the ``SIDE * SIDE`` tables are all pairs of a half key of the one and one of the other: at
a threshold of 0.85, where ``k`` is 4, 400 tables from 160 minhashes instead of 3,200. A pair of Jaccard ``j`` meets in
none with a probability below ``2 (1 - j^k)^SIDE`` (8 in 10 million at 0.85, 4 in 100 million at 0.9). Half keys that no other document has are
dropped before pairs are formed, so a document without near copies leaves no row in any table.

Buckets aren't expanded into pairs; ``groups`` says how links are found and verified in them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import mixed, settled, slices
from tessera.llm.graph import components
from tessera.llm.groups import by_document, grouped, hubs_of, possible, same_document, whole_sets
from tessera.llm.shingles import digests, ngram_sets

#: Half keys in each of the two collections.
SIDE = 20

#: Rows of all tables that a task makes and sorts, about.
TABLE_ROWS = 1 << 19


def width(t: float) -> int:
    """Minhashes in a half key: as many as leave a pair at the threshold about every second half key."""
    return max(1, math.floor(math.log(0.5) / math.log(t))) if t < 1 else 16


def half_keys(grams: list[np.ndarray], k: int, places: int = 2 * SIDE) -> np.ndarray:
    """One row of ``places`` half keys (64 bits, different for each place) per non-empty set of 64-bit hashes. A
    minhash is the least of ``a h + b`` over the upper 32 bits ``h`` of a set's hashes, ``a`` odd."""
    size = np.array([len(g) for g in grams])
    starts = np.cumsum(size) - size
    flat = (np.concatenate(grams) >> np.uint64(32)).astype(np.uint32)
    seeds = mixed(np.arange(1, 2 * k * places + 1, dtype=np.uint64)).astype(np.uint32).reshape(2, -1)
    out = np.empty((len(grams), places), np.uint64)
    for place in range(places):
        key = np.full(len(grams), place, np.uint64)
        for j in range(place * k, place * k + k):
            least = np.minimum.reduceat(flat * (seeds[0, j] | np.uint32(1)) + seeds[1, j], starts)
            key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, place] = key
    return out


def signed(docs: DataFrame, n: int, k: int) -> DataFrame:
    """Per document its set's size and digest, and the half keys (none for an empty set)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                grams = ngram_sets(part.column("text"), n)
                d1, d2 = digests(grams)
                size = np.array([len(g) for g in grams], np.int64)
                full = np.flatnonzero(size)
                keys = half_keys([grams[i] for i in full], k) if len(full) else np.zeros((0, 2 * SIDE), np.uint64)
                ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(size > 0))) * 2 * SIDE
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(size), pa.array(d1), pa.array(d2),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64)))],
                    ["doc_id", "n", "d1", "d2", "halves"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, halves array<long>")


def shared_halves(classes: DataFrame) -> DataFrame:
    """``x``, ``n`` and the half keys ``a`` and ``b`` of either collection that another set has, too; only sets that
    have some of both, as others meet nobody in any table."""
    halves = classes.select(F.col("node").alias("x"), "n", F.posexplode("halves").alias("place", "half"))
    shared = settled(halves.groupBy("half").agg(F.count("*").alias("c")).filter("c > 1").select("half"))
    mine = halves.join(shared, "half", "left_semi").groupBy("x", "n").agg(
        F.collect_list(F.when(F.col("place") < SIDE, F.col("half"))).alias("a"),
        F.collect_list(F.when(F.col("place") >= SIDE, F.col("half"))).alias("b"))
    return settled(mine.filter("size(a) > 0 and size(b) > 0"))


def table_pairs(mine: DataFrame, left: DataFrame) -> DataFrame:
    """``x`` and ``hub`` for the buckets of all tables. A set is up to ``SIDE * SIDE`` rows there, so the sets are dealt
    out by the rows that they become: their own few bytes would put millions of rows into a task."""
    own = settled(mine.join(left, "x"))
    rows = own.agg(F.sum(F.size("a") * F.size("b"))).first()[0] or 0
    tables = (own.repartition(rows // TABLE_ROWS + 1, "x").select("x", "n", "most", "b", F.explode("a").alias("a"))
              .select("x", "n", "most", "a", F.explode("b").alias("b"))
              .select("x", "n", "most", F.xxhash64("a", "b").alias("key")))
    return hubs_of(tables, ["key"])


def near_duplicates(docs: DataFrame, n: int = 5, t: float = 0.85) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_shingles``, ``component_id`` (smallest ``doc_id`` that links reach),
    ``class_id`` (smallest ``doc_id`` with the same set), ``kept`` (whether ``doc_id`` is the component's).

    Two documents link when the Jaccard of their sets of ``n``-word sequences (of the whole text with fewer words) is
    ``t`` (whole percents) or more. Null, empty and wordless texts have an empty set and link with nothing. Rows with
    one ``doc_id`` are one document: the links of each of its texts count for all of them; a wordless row stands alone.
    Rows without ``doc_id`` link with nothing, have null ids and are kept. An empty table gives no rows; other columns
    are not read, whatever their names. Texts may be of any length; one longer than a slice is handled alone.
    """
    p = round(t * 100)
    signs = settled(signed(docs, n, width(t)))
    classes = settled(signs.filter("n > 0 and doc_id is not null").groupBy("d1", "d2", "n")
                      .agg(F.min("doc_id").alias("doc"), F.first("halves").alias("halves"))
                      .withColumn("node", F.monotonically_increasing_id()))
    doc = F.col("doc_id")
    if classes.isEmpty():
        own = F.when(doc.isNotNull(), doc)
        return signs.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"),
                            own.alias("class_id"), F.lit(True).alias("kept"))
    mine = shared_halves(classes)
    wanted = settled(mine.select(F.col("x").alias("node")).join(classes.drop("halves"), "node"))
    texts = docs.select("doc_id", "text").join(wanted.select(F.col("doc").alias("doc_id")).distinct(), "doc_id",
                                               "left_semi")
    sets = settled(whole_sets(texts, n).join(wanted.select("d1", "d2", "n", "node"), ["d1", "d2", "n"])
                   .dropDuplicates(["node"]).select("node", "n", "grams"), large=True)
    left = possible(sets, p)

    groups = components(same_document(signs, classes))
    pairs = table_pairs(mine, left)
    groups = grouped(pairs, sets, left, groups, p)
    return by_document(signs.drop("halves"), classes, groups).withColumn(
        "kept", F.coalesce(doc == F.col("component_id"), F.lit(True)))


SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s GROUP BY doc_id),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY k) AS class_id FROM n),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM o JOIN n x ON o.a = x.doc_id JOIN n y ON o.b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a AS x, b AS y FROM l UNION ALL SELECT b, a FROM l),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.y, d.doc_id)) AS component_id,
       coalesce(c.class_id, d.doc_id) AS class_id, d.doc_id <= coalesce(m.y, d.doc_id) AS kept
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN m ON d.doc_id = m.x
"""
