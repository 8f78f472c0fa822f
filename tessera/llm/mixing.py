"""Mixing sources to target weights by whole and hash-seeded extra copies.

Words are summed per source, a target per source gives its repetition rate, and each document is taken
``floor(rate)`` times plus once more with probability ``rate - floor(rate)``, decided by a hash of its id. Of eight
draws that one sha256 gives, each source uses the one whose total comes nearest its target, so a source with few or
very uneven documents isn't left to one draw's luck.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import WORD, settled

WEIGHTS = (5, 2, 1)
MOST = 3
DRAWS = 8


def draws(doc_id: Column, seed: str) -> Column:
    """Eight numbers in [0, 1) per id: the 32-bit words of a sha256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}|"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("double") / F.lit(2.0 ** 32)
                     for i in range(DRAWS)])


def targets(sizes: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: ``source_size`` and ``target``. Sources by code point, null last, weigh ``weights``, repeating, and
    share all words; a target stops at ``most`` times its source's size and the excess goes to the others by weight.

    Filled like vessels: sources in order of the level at which they are full, the common level is what the full ones
    leave over, by the weight of the others. One row per source: the windows see that many rows.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("w", weight).withColumn("cap", most * F.col("source_size"))
    level = [F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source").cast("binary")]
    upto = Window.orderBy(*level).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    per = (per.withColumn("full", F.coalesce(F.sum("cap").over(upto), F.lit(0)))
           .withColumn("w_full", F.coalesce(F.sum("w").over(upto), F.lit(0.0)))
           .withColumn("total", F.sum("source_size").over(everything))
           .withColumn("w_all", F.sum("w").over(everything)))
    # The level if exactly the sources before this one are full; it holds where this source is not full itself.
    own = (F.col("total") - F.col("full")) / (F.col("w_all") - F.col("w_full"))
    per = per.withColumn("level", F.when(own * F.col("w") <= F.col("cap"), own))
    common = F.max_by("level", F.when(F.col("level").isNotNull(), -F.col("w_full"))).over(everything)
    return per.withColumn("common", common).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("common") * F.col("w")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long"))


def rates(sizes: DataFrame, seed: str, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """Per source: ``source_size``, ``target``, ``rate`` and the number of the ``draw`` that comes nearest."""
    per = targets(sizes, weights, most).withColumn(
        "rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)))
    per = settled(per)
    j = sizes.join(per, sizes["source"].eqNullSafe(per["source"])).select(per["source"], "size", "rate", "target",
                                                                         draws(F.col("doc_id"), seed).alias("u"))
    share = F.col("rate") - F.floor("rate")
    totals = j.groupBy("source").agg(*[
        F.sum(F.col("size") * (F.floor("rate") + F.when(F.col("u")[i] < share, 1).otherwise(0))).alias(f"t{i}")
        for i in range(DRAWS)], F.min("target").alias("_target"))
    off = F.array(*[F.struct(F.abs(F.col(f"t{i}") - F.col("_target")).alias("off"), F.lit(i).alias("draw"))
                    for i in range(DRAWS)])
    best = totals.select(F.col("source").alias("_s"), F.array_min(off)["draw"].alias("draw"))
    return settled(per.join(best, per["source"].eqNullSafe(best["_s"]), "left").drop("_s")
                   .withColumn("draw", F.coalesce("draw", F.lit(0))))


def copies(rate: Column, draw: Column, doc_id: Column, seed: str) -> Column:
    extra = draws(doc_id, seed)[draw] < rate - F.floor(rate)
    return (F.floor(rate) + F.when(extra, 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per document: ``doc_id``, ``size`` (words), ``source_size``, ``target``, ``taken`` (words with
    repeats), ``copies``. Null texts have no words; a null source is a source like others, last in order; sources
    without words have rate 0. Repeated rows with one id share its draw. An empty table gives no rows."""
    sizes = settled(sized(docs).select("doc_id", "source", "size"))
    per = rates(sizes, seed, weights, most)
    j = sizes.alias("d").join(per.alias("s"), F.expr("d.source <=> s.source"))
    j = j.withColumn("copies", copies(F.col("rate"), F.col("draw"), F.col("doc_id"), seed))
    return j.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"),
                    "copies")


def repeated(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """``docs`` with each row as many times as ``mix`` takes it; all columns stay."""
    per = rates(settled(sized(docs).select("doc_id", "source", "size")), seed, weights, most)
    j = docs.alias("d").join(per.select(F.col("source").alias("_s"), "rate", "draw").alias("s"),
                             F.expr("d.source <=> s._s"))
    n = copies(F.col("s.rate"), F.col("s.draw"), F.col("d.doc_id"), seed)
    return (j.select(F.struct("d.*").alias("_doc"), n.alias("_n")).filter("_n > 0")
            .select("_doc", F.explode(F.sequence(F.lit(1), "_n"))).select("_doc.*"))
