"""Near duplicates: an exact n-gram Jaccard join by vertical partitioning, and its connected groups.

The global n-gram order (frequent n-grams last, else by hash) is cut into fragments, and every document's set into
the segments that fall into them. Two things are counted per fragment and summed per pair:

* For candidates only a document's prefix counts, the first n-grams of its set: somewhat more than the
  ``n - ceil(t n) + 1`` of which sets of Jaccard ``t`` or more share one, so that they share a known number of them. A
  prefix n-gram that several sets hold is a bucket of candidates; a set that is in fewer buckets links with none.
* For the overlap of a candidate pair, the segments of both sets are intersected fragment by fragment.

First the prefixes leave only sets that can link. Of these, sets with a MinHash key in common are compared with one of
them, which finds most groups; then a second prefix join, in the exact order of how many of the candidates hold an
n-gram, finds the links between groups. There the place of an n-gram in both sets bounds their overlap, so few pairs
are left to verify. Large buckets aren't expanded into pairs; ``groups`` says how links are found and verified in them.
Links that could join no groups are never computed; all others are. Equal sets are one class throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import settled, slices
from tessera.llm.graph import components
from tessera.llm.groups import (by_document, compared, grouped, hubs_of, merged, possible, same_document, whole_sets,
                                with_main)
from tessera.llm.shingles import digests, ngram_sets
from tessera.llm.tensored import half_keys
from tessera.llm.tensored import width as half_key_width

#: Text bytes that a task hashes at once.
SLICE = 4 << 20

#: An n-gram is frequent if the slices in which ``SLICE_LEAST`` sets or more hold it count it ``FREQUENT`` times. The
#: ``MOST_FREQUENT`` most frequent ones go last in the order (8 bytes each, to every task). The order decides how
#: much work there is, never which pairs are found.
SLICE_LEAST, FREQUENT, MOST_FREQUENT = 2, 20, 1_000_000

#: Percents of its n-grams that a set must share within its prefix, which is longer by as many: longer prefixes are more
#: to shuffle, but leave fewer candidates. They decide how much work there is, never which pairs are found.
EXTRA = 10

#: Bits of a prefix n-gram's hash that are shuffled. Others that fall together count as shared, so none is lost.
SHORT = 40

#: 64-bit words of the table of bits by which texts are left out before any is shuffled (16 bytes each, to every task).
#: With more candidates than bits it leaves out fewer.
WORDS = 1 << 18

#: MinHash keys a set by which most groups are found before the exact join looks for links between groups. They decide
#: how much work that has, never which links are found.
SKETCHES = 8

#: Sets of a prefix bucket outside its largest group that meet all others there whose sizes and places fit; in larger
#: buckets they meet a hub.
FEW = 1024


def prefix_size(n: int, p: int) -> int:
    """N-grams in the prefix of a set of ``n``. Of two linked sets, the larger one of ``N``, both prefixes hold the first
    ``max(1, N EXTRA // 100)`` n-grams that they share, as ``ceil(N p / 100)`` or more are shared and at most ``n`` less
    this are left out, which grows with ``n``."""
    return n - min(-(-(p - min(EXTRA, p)) * n // 100), -(-p * n // 100) - 1)


def survey(docs: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Per document its set's size and digest and its text's hash ``t``; and, per slice, n-grams that several of its
    sets hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                grams = ngram_sets(part.column("text"), n)
                d1, d2 = digests(grams)
                k = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["set"] * k), part.column("doc_id"), pa.array([len(g) for g in grams], pa.int64()),
                     pa.array(d1), pa.array(d2), part.column("t")], ["kind", "doc_id", "n", "d1", "d2", "t"])
                _, one_each = np.unique(d1, return_index=True)
                flat = np.sort(np.concatenate([grams[i] for i in one_each])) if k else np.zeros(0, np.uint64)
                heads = np.flatnonzero(np.diff(flat, prepend=~flat[:1]) != 0)
                count = np.diff(np.append(heads, len(flat)))
                often = count >= SLICE_LEAST
                m = int(often.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(["gram"] * m, pa.string()), pa.nulls(m, pa.int64()), pa.array(count[often], pa.int64()),
                     pa.array(flat[heads[often]].view(np.int64)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())],
                    ["kind", "doc_id", "n", "d1", "d2", "t"])

    out = settled(docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
                  .mapInArrow(run, "kind string, doc_id long, n long, d1 long, d2 long, t long"), partition_by="kind")
    return (out.filter("kind = 'set'").drop("kind"),
            out.filter("kind = 'gram'").select(F.col("d1").alias("gram"), "n"))


def frequent_grams(grams: DataFrame) -> np.ndarray:
    counted = grams.groupBy("gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= FREQUENT)
    rows = counted.orderBy(F.desc("n"), "gram").limit(MOST_FREQUENT).select("gram").toArrow()
    return np.sort(rows.column("gram").to_numpy().view(np.uint64))


def prefixes(docs: DataFrame, frequent: np.ndarray, n: int, p: int) -> DataFrame:
    """``gram`` (``SHORT`` bits) and ``d1`` for every n-gram of every set's prefix; equal sets of a slice once."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)  # at most MOST_FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                grams = ngram_sets(part.column("text"), n)
                d1, d2 = digests(grams)
                sizes = np.array([len(g) for g in grams], np.int64)
                _, one_each = np.unique(np.stack((d1, d2)), axis=1, return_index=True)
                kept, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
                for i in one_each[sizes[one_each] > 0]:
                    g = grams[i]
                    late = often[np.minimum(np.searchsorted(often, g), len(often) - 1)] == g if len(often) else g < 0
                    g = np.concatenate((g[~late], g[late]))[:prefix_size(len(g), p)] >> np.uint64(64 - SHORT)
                    kept.append(g)
                    owner.append(np.full(len(g), i))
                owner = np.concatenate(owner)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(kept).view(np.int64)), pa.array(d1[owner])], ["gram", "d1"])

    return docs.select("text").mapInArrow(run, "gram long, d1 long")


def candidates(docs: DataFrame, classes: DataFrame, frequent: np.ndarray, n: int, p: int) -> DataFrame:
    """The rows of ``classes`` but for those with too many prefix n-grams that no other set's prefix holds: the rest is
    fewer than any linked set shares (``prefix_size``)."""
    alone = (prefixes(docs, frequent, n, p).groupBy("gram").agg(F.min("d1").alias("d1"), F.max("d1").alias("high"))
             .filter("d1 = high").groupBy("d1").agg(F.count("*").alias("alone")))
    more = min(EXTRA, p)
    size = f"n - least((n * {p - more} + 99) div 100, (n * {p} + 99) div 100 - 1)"  # ``prefix_size``
    return settled(classes.join(alone, "d1", "left")
                   .filter(f"{size} - coalesce(alone, 0) >= greatest(1, n * {more} div 100)").drop("alone"), large=True)


def marked(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The ``rows`` that ``wanted`` may hold by ``doc`` and ``t``: all whose bit one of ``wanted`` has set."""
    at = F.pmod(F.xxhash64("doc", "t"), F.lit(64 * WORDS)).alias("at")
    words = (wanted.select(at).selectExpr("shiftright(at, 6) AS word", "shiftleft(1L, cast(at & 63 AS int)) AS bit")
             .groupBy("word").agg(F.bit_or("bit").alias("bits")))
    hit = "shiftright(at, 6) = word AND shiftright(bits, cast(at & 63 AS int)) & 1 = 1"
    return rows.select("*", at).join(F.broadcast(words), F.expr(hit), "left_semi").drop("at")  # WORDS rows at most


def sketch_pairs(sets: DataFrame, left: DataFrame, p: int) -> DataFrame:
    """``x`` and ``hub``: sets with one of ``keys`` in common, each with the one that has the least share of n-grams of
    its own, as most others link with that. Only sets whose sizes may link."""
    keyed = settled(left.join(sets.select(F.col("node").alias("x"), "n", F.explode("keys").alias("key")), "x"))
    hub = settled(keyed.groupBy("key").agg(F.max(F.struct(F.col("most") / F.col("n"), "x", "n")).alias("hub"),
                                           F.count("*").alias("c")).filter("c > 1").select("key", "hub.x", "hub.n")
                  .toDF("key", "hub", "n_hub"))
    return settled(keyed.join(hub, "key")
                   .filter(f"x <> hub and 100 * least(n, n_hub) >= {p} * greatest(n, n_hub)")
                   .select("x", "hub").distinct().withColumn("go_on", F.lit(False)))


def prefix_pairs(sets: DataFrame, left: DataFrame, groups: DataFrame, p: int) -> DataFrame:
    """Pairs ``x`` and ``hub`` to compare (with ``go_on``: a hub for the rounds of ``groups``), out of the prefixes of the
    candidates, the rarest n-grams among these first.

    At the first n-gram that two linked sets share in this order, both have enough n-grams left for the overlap they
    need; so each place in a prefix bounds how large a partner can be that is met there first. Buckets (``gram``) whose
    sets are all in one of ``groups`` are left out.
    """
    mine = left.join(groups.withColumnRenamed("node", "x"), "x", "left").select(
        "x", "most", F.coalesce("component", "x").alias("group"))
    grams = sets.select(F.col("node").alias("x"), F.explode(F.flatten("grams")).alias("gram")).join(mine, "x")
    shared = settled(grams.groupBy("gram").agg(F.count("*").alias("c"), F.min("group").alias("low"),
                                               F.max("group").alias("high")).filter("c > 1")
                     .select("gram", "c", F.expr("low <> high").alias("across")), large=True)
    order = F.array_sort(F.collect_list(F.struct("c", "gram", "across")))  # at most a set
    ordered = (grams.select("x", "gram").join(shared, "gram").groupBy("x").agg(order.alias("order"))
               .join(sets.select(F.col("node").alias("x"), "n"), "x")
               .withColumn("first", (F.col("n") - F.ceil(F.col("n") * p / 100 - 1e-9) + 1 - F.col("n")
                                     + F.size("order")).cast("int")))
    members = settled(
        ordered.filter("first > 0").select("x", "n", F.size("order").alias("in_all"),
                                           F.posexplode(F.slice("order", F.lit(1), F.col("first"))).alias("i", "at"))
        .filter("at.across").join(mine, "x")
        # ``in_all - i`` n-grams of the set aren't before this one; those of its own are.
        .select(F.col("at.gram").alias("gram"), "x", "n", "group", F.least(
            "most", F.floor((F.col("in_all") - F.col("i")) * (100 + p) / p + 1e-9) - F.col("n")).alias("most")),
        large=True)
    several = settled(members.groupBy("gram").agg(F.min("group").alias("low"), F.max("group").alias("high"))
                      .filter("low <> high").select("gram"))
    members = settled(with_main(settled(members.join(several, "gram", "left_semi")), "gram"))
    few = members.filter(F.col("outside") <= FEW)
    other = few.select("gram", F.col("x").alias("hub"), F.col("n").alias("n_y"), F.col("most").alias("most_y"),
                       F.col("group").alias("group_y"))
    both = (few.filter("group <> main").join(other, "gram")
            .filter("group <> group_y and (group_y = main or x > hub) and most >= n_y and most_y >= n")
            .select("x", "hub").withColumn("go_on", F.lit(False)))
    return settled(hubs_of(members.filter(F.col("outside") > FEW), ["gram"]).unionByName(both)
                   .groupBy("x", "hub").agg(F.max("go_on").alias("go_on")))


def near_duplicates(docs: DataFrame, n: int = 5, t: float = 0.75) -> DataFrame:
    """One row per document row: ``doc_id``, ``n_shingles``, ``component_id`` (smallest ``doc_id`` that links reach),
    ``class_id`` (smallest ``doc_id`` with the same set).

    Two documents link when the Jaccard of their sets is ``t`` (whole percents) or more. Null, empty and wordless texts
    have an empty set and link with nothing. Rows with one ``doc_id`` are one document: the links of each of its texts
    count for all of them; a wordless row stands alone. Rows without ``doc_id`` come back with their set's size and no
    ids. Ties need no rule. An empty table gives no rows; other columns are not read, whatever their names. Texts may
    be of any length; one longer than a slice is handled alone.
    """
    sets, grams = survey(docs, n)
    p = round(t * 100)
    classes = settled(sets.filter("n > 0 and doc_id is not null").groupBy("d1", "d2", "n")
                      .agg(F.min(F.struct("doc_id", "t")).alias("least"))
                      .select("d1", "d2", "n", F.col("least.doc_id").alias("doc"), F.col("least.t").alias("t"))
                      .withColumn("node", F.monotonically_increasing_id()))
    if classes.isEmpty():
        own = F.when(F.col("doc_id").isNotNull(), F.col("doc_id"))
        return sets.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"), own.alias("class_id"))
    with_id = docs.filter("doc_id is not null")
    # From here on a set is its class.
    wanted = candidates(with_id, classes, frequent_grams(grams), n, p)

    rows = with_id.select(F.col("doc_id").alias("doc"), "text", F.xxhash64("text").alias("t"))
    texts = marked(rows, wanted).join(wanted.select("doc", "t", "node"), ["doc", "t"]).dropDuplicates(["doc", "t"])
    width = half_key_width(t) + 1

    def keyed(grams: list[np.ndarray]) -> np.ndarray:
        return half_keys(grams, width, SKETCHES)

    full = settled(whole_sets(texts, n, keyed, named=True).select("node", "n", "grams", "keys"), large=True)
    left = possible(full, p, worth=0.5)  # ``candidates`` was a pass already
    groups = merged(components(same_document(sets, classes)), compared(sketch_pairs(full, left, p), full, p))
    groups = grouped(prefix_pairs(full, left, groups, p), full, left, groups, p)
    return by_document(sets, classes, groups)


def one_of_each(docs: DataFrame, n: int = 5, t: float = 0.75) -> DataFrame:
    """``docs``, all columns, with only the smallest ``doc_id`` of each group of near duplicates."""
    gone = settled(near_duplicates(docs, n, t).filter("component_id <> doc_id").select("doc_id").distinct())
    return docs.alias("d").join(gone.alias("g"), F.expr("d.doc_id = g.doc_id"), "left_anti").select("d.*")
