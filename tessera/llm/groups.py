"""Groups of near duplicates out of buckets, in which linked sets meet. Every link is verified on the full sets.

Sets that meet in a bucket mostly differ too much to link. Without looking at pairs, the number of n-grams that no other
candidate has bounds how large a set's partner can be; sets that no partner fits are candidates no more.

Buckets aren't expanded into pairs. Each is compared with its hub, the smallest set in it that can have a larger
partner: whoever links with the hub is in its group. If ``x`` doesn't, and ``y`` is as large as the hub or larger, ``x``
and ``y`` can only link if they share n-grams that the hub lacks; how many at least follows from the sizes. A set that
shares fewer with all others of the bucket is done there. The others keep so many of these n-grams, the rarest, that a
linked pair meets in one of them, and these are the buckets of the next round. Buckets of the same sets count once, and
those whose sets are all in one group by then are done. Where at most ``SMALL`` sets are outside the bucket's largest
group, these are compared with all others there; else the bucket again has a hub. Hubs grow from round to round, so
rounds come to an end. No link between groups is lost that the first buckets hold.

A comparison cuts both sets into ``FRAGMENTS`` ranges of the hashes, counts the overlap of each apart and sums them up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import settled, slices
from tessera.llm.graph import components
from tessera.llm.shingles import digests, ngram_sets

#: Sets outside a bucket's largest group that are compared with all others there: so many pairs a set at most.
SMALL = 32

#: Ranges of the hashes that a set is cut into.
FRAGMENTS = 8


def whole_sets(docs: DataFrame, n: int, keyed: Callable[[list[np.ndarray]], np.ndarray] | None = None,
               named: bool = False) -> DataFrame:
    """``n``, digest and ``grams`` (the set's hashes, an array for each of ``FRAGMENTS`` ranges) of each document,
    ``keys``, its row of what ``keyed`` makes of several sets, if that is given, and its ``node``, if ``named``."""
    edges = np.arange(FRAGMENTS, dtype=np.uint64) * np.uint64((1 << 64) // FRAGMENTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                grams = ngram_sets(part.column("text"), n)
                d1, d2 = digests(grams)
                starts = np.cumsum([0, *(len(g) for g in grams)])
                flat = np.concatenate([np.zeros(0, np.uint64), *grams]).view(np.int64)
                cuts = [s + np.searchsorted(g, edges) for s, g in zip(starts, grams)]
                ends = pa.array(np.append(np.concatenate(cuts), starts[-1]), pa.int32())
                parts = pa.ListArray.from_arrays(ends, pa.array(flat))
                whole = pa.array(np.arange(len(grams) + 1) * FRAGMENTS, pa.int32())
                columns = [pa.array(np.diff(starts)), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(whole, parts)]
                if keyed:
                    keys = keyed(grams)
                    ends = pa.array(np.arange(len(grams) + 1) * keys.shape[1], pa.int32())
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(keys.ravel().view(np.int64))))
                if named:
                    columns.append(part.column("node"))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = ["n", "d1", "d2", "grams", *["keys"] * bool(keyed), *["node"] * named]
    return docs.select("text", *["node"] * named).mapInArrow(
        run, "n long, d1 long, d2 long, grams array<array<long>>" + ", keys array<long>" * bool(keyed)
        + ", node long" * named)


def hubs_of(members: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct pairs ``x``, ``hub`` (``go_on``: true) of ``members`` (``keys``, ``x``, ``n``, ``most``): each with the hub of its bucket,
    if the hub isn't too large for it. In a linked pair the smaller set can have a larger partner, so smaller ones than
    the hub link with nothing here. The hubs are a written table, so that a join partition with a hot bucket can be
    split."""
    me = F.struct("n", "x")
    hub = settled(members.groupBy(*keys).agg(F.min(F.when(F.col("most") >= F.col("n"), me)).alias("hub"),
                                             F.max(me).alias("last")).filter("hub < last").select(*keys, "hub"))
    return settled(members.join(hub, keys).filter((me > F.col("hub")) & (F.col("most") >= F.col("hub.n")))
                   .select("x", F.col("hub.x").alias("hub")).distinct().withColumn("go_on", F.lit(True)))


def possible(sets: DataFrame, p: int, worth: float = 0.1) -> DataFrame:
    """``x`` and ``most``, the size of the largest partner that a set can link with, for the sets that can have one.

    Of its ``n`` n-grams, a set shares at most those that another one of ``sets`` has, too. Every pass leaves some sets
    out, whose n-grams then are nobody else's; passes go on while a share of ``worth`` goes.
    """
    now = sets.select(F.col("node").alias("x"), "n", "grams")
    before = now.count()
    while True:
        alone = (now.select("x", F.explode(F.flatten("grams")).alias("gram")).groupBy("gram")
                 .agg(F.count("*").alias("c"), F.min("x").alias("x")).filter("c = 1")
                 .groupBy("x").agg(F.count("*").alias("alone")))
        most = now.select("x", "n").join(alone, "x", "left").select("x", (F.floor(
            (F.col("n") - F.coalesce("alone", F.lit(0))) * (100 + p) / p + 1e-9) - F.col("n")).alias("most"),
            F.ceil(F.col("n") * p / 100 - 1e-9).alias("least"))
        left = settled(most.filter("most >= least").drop("least"), large=True)
        after = left.count()
        if after >= (1 - worth) * before:  # none of none, too
            return left
        now, before = now.join(left.select("x"), "x", "left_semi"), after


def with_main(members: DataFrame, key: str) -> DataFrame:
    """``members`` with ``main``, the largest ``group`` of their bucket ``key``, and how many are ``outside`` of it."""
    main = members.groupBy(key, "group").agg(F.count("*").alias("m")).groupBy(key).agg(
        F.max(F.struct("m", "group")).alias("main"), F.sum("m").alias("all"))
    return members.join(settled(main.select(key, "main.group", (F.col("all") - F.col("main.m")).alias("outside"))
                                .withColumnRenamed("group", "main")), key)


def next_pairs(own: DataFrame, left: DataFrame) -> DataFrame:
    """Pairs to compare after a round: ``own`` says which n-grams (``gram``) beyond its ``hub`` a set has, how many of
    them it must share (``need``), and its ``group`` so far."""
    def across(rows: DataFrame, *more) -> DataFrame:
        """Buckets (``hub``, ``gram``) that hold sets of several groups."""
        found = rows.groupBy("hub", "gram").agg(F.min("group").alias("low"), F.max("group").alias("high"),
                                                F.count("*").alias("c"), *more)
        return found.filter("low <> high").drop("low", "high")

    mine = Window.partitionBy("hub", "x")  # at most a set
    own = (own.join(settled(across(own)), ["hub", "gram"])
           .withColumn("shared", F.count("*").over(mine))
           .withColumn("place", F.row_number().over(mine.orderBy("c", "gram")))
           .filter("place <= shared - need + 1").drop("c", "shared", "place"))
    own = settled(own)
    buckets = across(own, F.bit_xor(F.xxhash64("x")).alias("s1"), F.bit_xor(F.xxhash64("x", F.lit(1))).alias("s2"))
    buckets = buckets.groupBy("c", "s1", "s2").agg(F.min(F.struct("hub", "gram")).alias("k"))
    buckets = settled(buckets.select("k.hub", "k.gram"))
    members = settled(own.join(buckets, ["hub", "gram"]).join(left, "x")
                      .select(F.xxhash64("hub", "gram").alias("bucket"), "x", "n", "most", "group"))
    members = with_main(members, "bucket")
    few = members.filter(F.col("outside") <= SMALL)
    own_buckets = few.groupBy("x").agg(F.collect_set("bucket").alias("buckets"))  # at most the n-grams of a set
    few = settled(few.join(own_buckets, "x"))
    other = few.select("bucket", F.col("x").alias("hub"), F.col("n").alias("n_y"), F.col("most").alias("most_y"),
                       F.col("group").alias("group_y"), F.col("buckets").alias("buckets_y"))
    # A pair is made once, in the least bucket that holds both.
    both = (few.filter("group <> main").join(other, "bucket")
            .filter("group <> group_y and (group_y = main or x > hub) and most >= n_y and most_y >= n"
                    " and bucket = array_min(array_intersect(buckets, buckets_y))")
            .select("x", "hub").withColumn("go_on", F.lit(False)))
    return (hubs_of(members.filter(F.col("outside") > SMALL), ["bucket"]).unionByName(both)
            .groupBy("x", "hub").agg(F.max("go_on").alias("go_on")))


def compared(pairs: DataFrame, sets: DataFrame, p: int) -> DataFrame:
    """``pairs`` with ``linked`` and, where they ``go_on``, ``own``: the n-grams of ``x`` that the hub lacks, if they are
    the ``need`` or more that another set of the bucket has to share to link with it."""
    x = sets.select(F.col("node").alias("x"), F.col("n"), F.col("grams").alias("grams_x"))
    h = sets.select(F.col("node").alias("hub"), F.col("n").alias("n_hub"), F.col("grams").alias("grams_hub"))
    both = F.col("n") - F.col("lacks")
    least = F.greatest(F.ceil(F.col("n") * p / 100 - 1e-9),
                       F.ceil((F.col("n") + F.col("n_hub")) * p / (100 + p) - 1e-9))
    need = F.greatest(F.lit(1), least - both)
    return (pairs.join(x, "x").join(h, "hub").withColumn("own", F.zip_with("grams_x", "grams_hub", F.array_except))
            .withColumn("lacks", F.aggregate("own", F.lit(0), lambda s, part: s + F.size(part)))
            .select("x", "hub", "n", need.alias("need"),
                    (100 * both >= p * (F.col("n") + F.col("n_hub") - both)).alias("linked"),
                    F.when(F.col("go_on") & (need <= F.col("lacks")), F.flatten("own")).alias("own")))


def merged(groups: DataFrame, done: DataFrame) -> DataFrame:
    """``groups`` after the ``linked`` pairs of ``done`` (``compared``)."""
    return components(groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
                      .unionByName(done.filter("linked").select(F.col("x").alias("a"), F.col("hub").alias("b"))))


def grouped(pairs: DataFrame, sets: DataFrame, left: DataFrame, groups: DataFrame, p: int) -> DataFrame:
    """``node`` and ``component`` after all links of Jaccard ``p`` percents or more: ``pairs`` are the sets and hubs of
    the first buckets, ``left`` the candidates (``possible``), ``groups`` those that are one already."""
    while not pairs.isEmpty():
        done = settled(compared(pairs, sets, p), large=True)
        groups = merged(groups, done)
        if pairs.filter("go_on").isEmpty():
            break
        own = (done.join(groups, done["x"] == groups["node"], "left")
               .select("hub", "x", "n", "need", F.coalesce("component", "x").alias("group"),
                       F.explode("own").alias("gram")))
        pairs = settled(next_pairs(own, left))
    return groups


def by_document(signs: DataFrame, classes: DataFrame, groups: DataFrame) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id``, ``class_id`` per row of ``signs`` (``doc_id``, ``n``, ``d1``,
    ``d2``), whose sets are ``classes`` (``node``, ``doc``). Rows without ``doc_id`` have no ids."""
    named = classes.join(groups, "node", "left").select("d1", "d2", "n", "doc",
                                                        F.coalesce("component", "node").alias("component"))
    least = settled(named.groupBy("component").agg(F.min("doc").alias("component_id")))
    named = settled(named.join(least, "component").select("d1", "d2", "n", F.col("doc").alias("class_id"),
                                                          "component_id"))
    doc = F.col("doc_id")
    return (signs.join(named, ["d1", "d2", "n"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(doc.isNotNull(), F.coalesce("component_id", doc)).alias("component_id"),
                    F.when(doc.isNotNull(), F.coalesce("class_id", doc)).alias("class_id")))


def same_document(signs: DataFrame, classes: DataFrame) -> DataFrame:
    """Links ``a``, ``b`` between the sets of one ``doc_id`` where rows repeat it with different texts."""
    rows = signs.filter("n > 0 and doc_id is not null").select("doc_id", "d1", "d2", "n")
    several = settled(rows.groupBy("doc_id").agg(F.min("d1").alias("low"), F.max("d1").alias("high"))
                      .filter("low <> high").select("doc_id"))
    own = settled(rows.join(several, "doc_id", "left_semi").distinct()
                  .join(classes.select("d1", "d2", "n", "node"), ["d1", "d2", "n"]).select("doc_id", "node"))
    least = settled(own.groupBy("doc_id").agg(F.min("node").alias("b")))
    return own.join(least, "doc_id").select(F.col("node").alias("a"), "b")
