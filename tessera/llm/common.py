"""What several operators share: table access, scratch tables and columnar text helpers.

The text helpers run inside Spark tasks on Arrow batches. A batch is cut into slices of at most ``SLICE_BYTES`` of
text (one longer text makes a slice of its own), so a task's memory follows the slice and not the partition.
"""

from __future__ import annotations

import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task handles at once.
SLICE_BYTES = 4 << 20

#: The white space of the contracts, as a regular expression class and its complement.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def ship(spark: SparkSession) -> None:
    """Hands this package to the Python workers, once per Spark application: they may have neither the driver's
    folder nor its ``PYTHONPATH``."""
    global _shipped
    if _shipped != spark.sparkContext.applicationId:
        package = Path(__file__).resolve().parent.parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        spark.sparkContext.addPyFile(archive)
        _shipped = spark.sparkContext.applicationId


_shipped: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared ``spark.checkpoint.dir``; an error if the session names none."""
    from tessera.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"


def settled(df: DataFrame, partition_by: str | None = None, large: bool = False) -> DataFrame:
    """``df`` written as a Parquet table in the shared scratch folder and read back: its lineage is cut, a lost
    executor costs only running tasks, and later joins see the table's true size. ``large``: its shuffles moved a good
    part of the corpus, so the JVM is asked to collect garbage, on which Spark's cleaner drops the shuffle files that
    nothing refers to any more (it takes the second call, after the listeners have seen the query end)."""
    spark, path = df.sparkSession, scratch_dir(df.sparkSession)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    if large:
        for _ in range(2):
            time.sleep(0.5)
            spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the files of ``settled`` tables that nothing will read again."""
    for df in tables:
        jvm, path = df.sparkSession.sparkContext._jvm, df.scratch_path
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def slices(batch: pa.RecordBatch, text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """``batch`` cut into runs of rows with at most ``limit`` bytes in ``text`` (one row at least)."""
    if batch.num_rows == 0:
        return
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words (``WORD``) of each text, null as empty: word codes of all rows one after another, row offsets into
    them, and the vocabulary that the codes point into."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    words = lists.flatten().dictionary_encode()
    codes, vocab = words.indices.to_numpy(zero_copy_only=False), words.dictionary
    offsets = offsets - offsets[0]
    empty = pc.equal(pc.binary_length(vocab), 0).to_numpy(zero_copy_only=False)
    if empty.any():
        full = ~empty[codes]
        offsets = np.concatenate(([0], np.cumsum(full)))[offsets]
        codes = codes[full]
    return codes, offsets, vocab


def hash_words(vocab: pa.Array) -> np.ndarray:
    """64-bit hash of each vocabulary entry."""
    if len(vocab) == 0:
        return np.zeros(0, np.uint64)
    return pd.util.hash_array(np.asarray(vocab.to_pylist(), dtype=object), categorize=False)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser: spreads the bits of ``x`` evenly."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive entries of ``words`` (64-bit word hashes)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = words[:n].copy()
    for i in range(1, width):
        out *= np.uint64(0x9E3779B97F4A7C15)
        out += words[i:i + n]
    return mixed(out)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of each entry that ``offsets`` delimit."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts; one aggregate over the column."""
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
