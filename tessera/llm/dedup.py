"""Exact dedup of texts that are equal without their white space, by content-defined chunk recipes.

Each normalised text is cut into chunks at places that its own content decides, and described by its recipe, the list
of its chunks' 64-bit hashes. Chunk texts are moved once: reduced to distinct ones, they show whether each hash stands
for one text alone, which makes it a verified identifier. From then on only recipes are compared, as whole lists. A
document that holds a hash of two different texts is compared by its whole text instead.

All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE, settled

#: A chunk is 256 characters and on up to the next boundary, 2048 at most. A boundary follows one of these letters
#: and stands before one of those, which is one place in about 50 of the Latin-script texts tested; a text without
#: any is cut every 2048 characters, which is as exact and only shares fewer chunks.
CHUNK = r"(?s).{256,2047}?[bcfgkpvwxyz](?=[aeiou])|.{1,2048}"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE}+", "")


def recipes(docs: DataFrame, chunk_hash=F.xxhash64) -> DataFrame:
    """Per document: ``n_chars`` of the original text, ``text_sha256`` of the normalised one and ``recipe``."""
    d = docs.select("doc_id", "text", normalised(F.col("text")).alias("_norm"))
    return d.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n_code_points"),
                    F.sha2(F.col("_norm").cast("binary"), 256).alias("text_sha256"),
                    F.transform(F.regexp_extract_all("_norm", F.lit(CHUNK), F.lit(0)), lambda c: chunk_hash(c))
                    .alias("recipe"))


def ambiguous_hashes(docs: DataFrame, chunk_hash=F.xxhash64) -> DataFrame:
    """``hash`` of chunks with more than one text; empty unless 64-bit hashes collide."""
    chunks = docs.select(F.explode(F.regexp_extract_all(normalised(F.col("text")), F.lit(CHUNK), F.lit(0)))
                         .alias("chunk"))
    distinct = chunks.select(chunk_hash(F.col("chunk")).alias("hash"), "chunk").distinct()
    return distinct.groupBy("hash").count().filter("count > 1").select("hash")


def exact_duplicates(docs: DataFrame, chunk_hash=F.xxhash64) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id`` (of the row that stays of its equal texts: most code points in
    the original text, then smallest ``doc_id``), ``group_size``, ``kept``, ``text_sha256``.

    Null texts count as empty and equal each other and texts of white space alone. Rows that repeat with the same
    ``doc_id`` are a group too; the first of them by (code points, id) is the one that stays, and ``kept`` is true for
    exactly one row of a group, whatever repeats. A null ``doc_id`` comes last among ties. An empty table gives no
    rows; other columns are not read. ``chunk_hash`` is replaced in tests to force collisions.
    """
    rows = recipes(docs, chunk_hash).withColumn("_row", F.monotonically_increasing_id())
    rows = settled(rows)
    doubtful = settled(ambiguous_hashes(docs, chunk_hash), large=True)
    no_text = F.lit(None).cast("string")
    if doubtful.isEmpty():
        keyed = rows.withColumn("_text", no_text)
    else:
        named = rows.select("_row", F.explode("recipe").alias("hash")).join(doubtful, "hash", "left_semi")
        named = named.select("_row").distinct().withColumn("_doubt", F.lit(True))
        whole = docs.select(normalised(F.col("text")).alias("_norm"), F.xxhash64("doc_id").alias("_id")).distinct()
        keyed = rows.join(named, "_row", "left").withColumn("_id", F.xxhash64("doc_id"))
        plain = keyed.filter("_doubt is null").withColumn("_text", no_text).drop("_doubt", "_id")
        doubt = (keyed.filter("_doubt").withColumn("_sha", F.col("text_sha256"))
                 .join(whole.withColumn("_sha", F.sha2(F.col("_norm").cast("binary"), 256)), ["_id", "_sha"])
                 .withColumn("_text", F.col("_norm")).select(plain.columns))
        keyed = settled(plain.unionByName(doubt))
    # Most rows stand alone: only groups of two and more are written and joined back. The written table lets the
    # join split a group of any size over tasks; the digest only deals out, lists and texts are compared whole.
    digest = F.xxhash64("recipe", "_text").alias("_digest")
    first = F.struct((-F.col("n_code_points")).alias("n"), F.col("doc_id").isNull().alias("z"), "doc_id", "_row")
    groups = settled(keyed.groupBy(digest, "recipe", "_text").agg(F.count("*").alias("group_size"),
                                                                 F.min(first).alias("_first"))
                     .filter("group_size > 1"))
    k, g = keyed.withColumn("_digest", digest).alias("k"), groups.alias("g")
    same = (F.expr("k._digest = g._digest") & F.expr("k.recipe = g.recipe") & F.expr("k._text <=> g._text"))
    joined = k.join(g, same, "left")
    alone = F.col("g._first").isNull()
    return joined.select(
        F.col("k.doc_id").alias("doc_id"),
        F.when(alone, F.col("k.doc_id")).otherwise(F.col("g._first.doc_id")).alias("keep_id"),
        F.coalesce("g.group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("k._row") == F.col("g._first._row"))).alias("kept"),
        F.col("k.text_sha256").alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs``, all columns, without the rows that ``exact_duplicates`` doesn't keep."""
    found = settled(exact_duplicates(docs))
    sha = F.sha2(normalised(F.col("d.text")).cast("binary"), 256)
    gone = found.filter("not kept and not (doc_id <=> keep_id)").select("doc_id", "text_sha256").distinct()
    out = docs.alias("d").join(gone.alias("g"), F.expr("d.doc_id <=> g.doc_id") & (sha == F.col("g.text_sha256")),
                               "left_anti")
    if found.filter("not kept and doc_id <=> keep_id").isEmpty():
        return out.select("d.*")
    # Rows that repeat an id and a text: the first of them by what decides within a group.
    text = F.coalesce("_doc.text", F.lit(""))
    rows = out.select(F.struct("d.*").alias("_doc")).withColumn(
        "_sha", F.sha2(normalised(F.col("_doc.text")).cast("binary"), 256))
    order = Window.partitionBy("_doc.doc_id", "_sha").orderBy(F.length(text).desc(), text)
    return rows.withColumn("_k", F.row_number().over(order)).filter("_k = 1").select("_doc.*")
