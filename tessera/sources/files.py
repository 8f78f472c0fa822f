"""File-level sources: whole-text documents (S17), SHA-256 fingerprints (S18, S19) and
manifest comparison (S20, A9, A10).

``binaryFile`` lists the files. The digest of a file below ``WHOLE_BYTES`` is the built-in
``sha2`` over its content; a larger one (a row can't hold 2 GB) is read in blocks by the
task that has its row, so memory stays at one block whatever the file's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.columns import base_name, is_hex64
from tessera.sources import fs


def whole_text(spark: SparkSession, path: str, universal_newlines: bool = True,
               drop_undecodable: bool = True) -> DataFrame:
    """One row per file: (path, name, text).

    ``universal_newlines`` turns CR LF and lone CR into LF; ``drop_undecodable`` removes
    bytes that are not valid UTF-8 (the reader yields U+FFFD for them) - together the
    text equals a tolerant text-mode read of the file.
    """
    df = spark.read.text(path, wholetext=True)
    text = F.col("value")
    if drop_undecodable:
        text = F.regexp_replace(text, "\uFFFD", "")
    if universal_newlines:
        text = F.regexp_replace(text, "\r\n?", "\n")
    return df.select(F.col("_metadata.file_path").alias("path"), base_name(F.col("_metadata.file_path")).alias("name"),
                     text.alias("text"))


#: Files up to this size are hashed as one row by ``sha2``; larger ones by blocks of ``BLOCK_BYTES``.
WHOLE_BYTES, BLOCK_BYTES = 256 << 20, 8 << 20


def file_hashes(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """S18 + S19: (source_name, path, sha256, size) for every file under ``path``, of any size.

    Keyed by base name, as the reference's multi-file fingerprint is.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    listed = reader.load(path)
    small = listed.filter(F.col("length") <= WHOLE_BYTES).select(
        "path", F.sha2(F.col("content"), 256).alias("sha256"), F.col("length").alias("size"))
    large = listed.filter(F.col("length") > WHOLE_BYTES).select("path", F.col("length").alias("size"))
    # Spark lists no files without content; their digest is that of nothing.
    empty = spark.createDataFrame([(p,) for p in fs.empty_files(spark, path, glob or "*")], "path string").select(
        "path", F.sha2(F.lit(""), 256).alias("sha256"), F.lit(0).cast("long").alias("size"))
    found = small.unionByName(block_hashes(large)).unionByName(empty)
    return found.select(base_name(F.col("path")).alias("source_name"), "path", "sha256", "size")


def block_hashes(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``path``, ``sha256``, ``size`` of the listed files (``path``, ``size``), each read in blocks through the file
    system of its URI. A file is one task's work, as its digest depends on all bytes in order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib
        from urllib.parse import urlsplit

        from pyarrow import fs as afs
        for batch in batches:
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                if urlsplit(path).scheme in ("", "file"):
                    store, name = afs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)
                else:
                    store, name = afs.FileSystem.from_uri(path)
                digest = hashlib.sha256()
                with store.open_input_stream(name, buffer_size=0) as stream:
                    while block := stream.read(block_bytes):
                        digest.update(block)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path]), pa.array([digest.hexdigest()]), pa.array([size], pa.int64())],
                    ["path", "sha256", "size"])

    return files.select("path", "size").mapInArrow(run, "path string, sha256 string, size long")


def manifest_diff(current: DataFrame, expected: DataFrame, name: str = "name", sha: str = "sha") -> DataFrame:
    """S20 for whole manifests: full outer join on name.

    state = new (only current) / missing (only expected) / invalid_expected (expected
    is not 64 hex characters) / unchanged (exact, case-sensitive match) / changed.
    """
    c = current.select(F.col(name).alias("_n"), F.col(sha).alias("sha"))
    e = expected.select(F.col(name).alias("_m"), F.col(sha).alias("expected_sha"))
    j = c.join(e, c["_n"] == e["_m"], "full_outer")
    state = (F.when(F.col("_m").isNull(), "new").when(F.col("_n").isNull(), "missing")
             .when(~is_hex64(F.col("expected_sha")), "invalid_expected")
             .when(F.col("sha") == F.col("expected_sha"), "unchanged").otherwise("changed"))
    return j.select(F.coalesce(F.col("_n"), F.col("_m")).alias(name), state.alias("state"), "sha", "expected_sha")


def latest_load(manifest: DataFrame) -> DataFrame:
    """A9 + A10: one row: most recent load time and the name -> sha map (bounded by the
    number of source files)."""
    return manifest.agg(F.max("loaded_at").alias("loaded_at"),
                        F.map_from_entries(F.collect_list(F.struct("source_name", "sha256"))).alias("csv_shas"))


def manifest_newest_first(manifest: DataFrame) -> DataFrame:
    """Manifest rows, most recent load first."""
    return manifest.orderBy(F.desc("loaded_at"), F.asc("source_name"))
