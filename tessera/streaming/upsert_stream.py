"""Keyed last-write-wins upsert of arriving CSV files (S9 as a streaming sink).

Each micro-batch is merged with the latest published version and written as a new
version directory named by the batch id, so a replayed batch (after a failure)
rewrites the same version: the sink is idempotent and the checkpoint gives
exactly-once progress. The checkpoint lives under the session's
``spark.checkpoint.dir`` unless a location is given.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.columns import strip_or_empty
from tessera.operators.upsert import upsert
from tessera.sources import fs
from tessera.session import checkpoint_dir


def _versions(spark: SparkSession, out_dir: str) -> list[int]:
    """Complete versions (their writer left ``_SUCCESS``), oldest first."""
    return sorted(int(n[2:]) for n in fs.list_names(spark, out_dir)
                  if n.startswith("v=") and fs.exists(spark, fs.join(out_dir, n, "_SUCCESS")))


def latest_snapshot(spark: SparkSession, out_dir: str) -> DataFrame | None:
    """The newest complete version of the table, or None before the first batch."""
    vs = _versions(spark, out_dir)
    return spark.read.parquet(fs.join(out_dir, f"v={vs[-1]}")) if vs else None


def start_upsert_stream(spark: SparkSession, in_dir: str, columns: Sequence[str], keys: Sequence[str],
                        out_dir: str, checkpoint: str | None = None, available_now: bool = True) -> StreamingQuery:
    """Watch ``in_dir`` for CSV files with header ``columns`` and upsert them by ``keys``.

    Within a batch, later files and later rows win (file name, then row position);
    ``created_at`` keeps the first time a key was seen.
    """
    schema = ", ".join(f"`{c}` string" for c in columns)
    stream = (spark.readStream.schema(schema).option("header", True).option("escape", '"').csv(in_dir)
              .select(*[strip_or_empty(F.col(c)).alias(c) for c in columns],
                      F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")))
    ckpt = checkpoint or fs.join(checkpoint_dir(spark), "upsert_stream", out_dir.rstrip("/").split("/")[-1])

    def apply(batch: DataFrame, batch_id: int) -> None:
        cur = latest_snapshot(spark, out_dir)
        inc = batch.select(*columns, F.current_timestamp().alias("created_at"), F.lit(batch_id + 1).alias("_s"),
                           "_f", "_b", F.monotonically_increasing_id().alias("_i"))
        if cur is not None:
            cur = cur.select(*columns, "created_at", F.lit(0).alias("_s"), F.lit("").alias("_f"),
                             F.lit(0).cast("long").alias("_b"), F.lit(0).cast("long").alias("_i"))
        merged = upsert(cur, inc, keys, ["_s", "_f", "_b", "_i"], created_col="created_at")
        merged.select(*columns, "created_at").write.mode("overwrite").parquet(fs.join(out_dir, f"v={batch_id}"))

    w = stream.writeStream.foreachBatch(apply).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()
