"""Keyed snapshots: tables that are upserted bucket by bucket and looked up by key.

    <root>/data/<v>-<random>/bucket=<b>/*.parquet   files are never changed
    <root>/commits/<v>.json                         keys, schema and, per bucket, the folder that holds it

Rows are dealt to buckets by a hash of their key. An upsert reads and rewrites only the buckets that its rows fall
into, in a folder of its own, and then publishes by creating one commit file; a commit by someone else in between
makes that creation fail, and readers of older versions are not disturbed. All other buckets keep their files.

Within a file rows are sorted by key, row groups are small and carry Bloom filters on the key, so that a lookup opens
one bucket's files and in them the row group that holds the key.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tessera.operators.upsert import upsert
from tessera.sources import fs

#: Bytes of a row group: what a lookup decodes at least.
ROW_GROUP_BYTES = 16 << 20

_SEQ = "_write"


@dataclass(frozen=True)
class Snapshot:
    spark: SparkSession
    root: str
    version: int
    keys: tuple[str, ...]
    buckets: int
    schema: StructType
    live: dict[int, str]  # bucket -> folder of its files; buckets without rows are absent
    row_group_bytes: int

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        at = sorted(b for b in (self.live if buckets is None else set(buckets)) if b in self.live)
        if not at:
            return self.spark.createDataFrame([], self.schema)
        paths = [f"{self.root}/data/{self.live[b]}/bucket={b}" for b in at]
        return self.spark.read.schema(self.schema).parquet(*paths)

    def lookup(self, *wanted) -> DataFrame:
        """Rows whose key is one of ``wanted`` (values, or tuples for a key of several columns; NULL parts are
        matched to NULL). Only the buckets of these keys are listed, and the key is compared in the scan."""
        if not wanted:
            return self.read([])
        rows = [w if isinstance(w, tuple) else (w,) for w in wanted]
        types = [self.schema[k].dataType.simpleString() for k in self.keys]
        args = {f"k{i}_{j}": v for i, row in enumerate(rows) for j, v in enumerate(row)}
        values = ", ".join("(" + ", ".join(f"CAST(:k{i}_{j} AS {t})" for j, t in enumerate(types)) + ")"
                           for i in range(len(rows)))
        names = ", ".join(f"`{k}`" for k in self.keys)
        at = self.spark.sql(f"SELECT * FROM VALUES {values} AS t({names})", args=args).select(
            bucket_of(self.keys, self.buckets).alias("b")).distinct().collect()  # at most one per wanted key
        hit = F.lit(False)
        if len(self.keys) == 1 and all(r[0] is not None for r in rows):
            hit = F.col(self.keys[0]).isin([F.lit(r[0]).cast(types[0]) for r in rows])
        else:
            for r in rows:
                same = F.lit(True)
                for k, v, t in zip(self.keys, r, types):
                    same = same & (F.col(k).isNull() if v is None else F.col(k) == F.lit(v).cast(t))
                hit = hit | same
        return self.read([r["b"] for r in at]).filter(hit)

    def upsert(self, incoming: DataFrame, order: Sequence[str] = (), created_col: str | None = None) -> Snapshot:
        """The snapshot after last-write-wins over its rows, then ``incoming``.

        ``incoming`` may hold a key several times: the greatest ``order`` tuple wins (``order`` may name columns that
        the snapshot lacks; without it a key must come once). ``created_col`` keeps the first version's value. An
        empty ``incoming`` returns the snapshot as it is. Only touched buckets are read and written."""
        cols = [f.name for f in self.schema]
        ranks = [F.col(o).alias(f"_o{i}") for i, o in enumerate(order)]
        rows = incoming.select(*[F.col(f.name).cast(f.dataType) for f in self.schema], *ranks)
        rows = rows.withColumn("bucket", bucket_of(self.keys, self.buckets))
        touched = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # at most self.buckets numbers
        if not touched:
            return self
        orders = [_SEQ, *(f"_o{i}" for i in range(len(order)))]
        old = self.read(touched).withColumn("bucket", bucket_of(self.keys, self.buckets)).withColumn(_SEQ, F.lit(0))
        merged = upsert(old, rows.withColumn(_SEQ, F.lit(1)), [*self.keys, "bucket"], orders, created_col)
        return _publish(self, merged.select(*cols, "bucket"), touched)


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def create(df: DataFrame, root: str, keys: Sequence[str], buckets: int = 64,
           row_group_bytes: int = ROW_GROUP_BYTES) -> Snapshot:
    """First version of a snapshot at ``root``, which must hold none. ``buckets`` is fixed for its life: choose it so
    that a bucket is a few files (thousands for tables of many terabytes)."""
    spark = df.sparkSession
    none = Snapshot(spark, root.rstrip("/"), 0, tuple(keys), buckets, df.schema, {}, row_group_bytes)
    if fs.list_names(spark, f"{none.root}/commits"):
        raise ValueError(f"{root} already holds a snapshot")
    return _publish(none, df.withColumn("bucket", bucket_of(keys, buckets)), None)


def open_snapshot(spark: SparkSession, root: str, version: int | None = None) -> Snapshot:
    """A snapshot's last version, or an earlier one."""
    root = root.rstrip("/")
    if version is None:
        found = [int(n[:-5]) for n in fs.list_names(spark, f"{root}/commits") if n.endswith(".json")]
        if not found:
            raise FileNotFoundError(f"no snapshot at {root}")
        version = max(found)
    c = json.loads(fs.read_text(spark, f"{root}/commits/{version:010d}.json"))
    return Snapshot(spark, root, version, tuple(c["keys"]), c["buckets"], StructType.fromJson(c["schema"]),
                    {int(b): name for b, name in c["live"].items()}, c["row_group_bytes"])


def _publish(old: Snapshot, rows: DataFrame, touched: Sequence[int] | None) -> Snapshot:
    spark, version = old.spark, old.version + 1
    name = f"{version:010d}-{uuid.uuid4().hex[:8]}"
    folder = f"{old.root}/data/{name}"
    if fs.exists(spark, f"{old.root}/commits/{version:010d}.json"):
        raise RuntimeError(f"version {version} of {old.root} has been published by someone else; read it and try again")
    writer = (rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", *old.keys)
              .write.partitionBy("bucket")
              .option("parquet.block.size", old.row_group_bytes))
    for k in old.keys:
        writer = writer.option(f"parquet.bloom.filter.enabled#{k}", "true")
    writer.parquet(folder)
    written = [int(n.split("=")[1]) for n in fs.list_names(spark, folder) if n.startswith("bucket=")]
    live = {b: v for b, v in old.live.items() if touched is not None and b not in set(touched)}
    live |= {b: name for b in written}
    commit = {"keys": list(old.keys), "buckets": old.buckets, "schema": json.loads(old.schema.json()),
              "live": {str(b): live[b] for b in sorted(live)}, "row_group_bytes": old.row_group_bytes}
    fs.create_text(spark, f"{old.root}/commits/{version:010d}.json", json.dumps(commit))
    return Snapshot(spark, old.root, version, old.keys, old.buckets, old.schema, live, old.row_group_bytes)


def vacuum(snapshot: Snapshot) -> list[str]:
    """Deletes the bucket folders below ``data/`` that ``snapshot``, its last version, doesn't use, and returns their
    names; older versions can't be read any more."""
    spark, gone = snapshot.spark, []
    if open_snapshot(spark, snapshot.root).version != snapshot.version:
        raise ValueError("vacuum needs the last version")
    for name in fs.list_names(spark, f"{snapshot.root}/data"):
        if int(name.split("-")[0]) > snapshot.version:
            continue  # someone is writing the next version
        for b in fs.list_names(spark, f"{snapshot.root}/data/{name}"):
            if b.startswith("bucket=") and snapshot.live.get(int(b.split("=")[1])) != name:
                fs.delete(spark, f"{snapshot.root}/data/{name}/{b}")
                gone.append(f"{name}/{b}")
    return gone
