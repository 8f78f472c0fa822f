"""File fingerprints of any size, manifests, byte-order marks and the audit of a snapshot."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import hierarchy as H
from tessera.plans import ingest as I
from tessera.sources import files, snapshots

from domain_fixture import FILES, write


def test_hash_of_a_file_beyond_two_gigabytes(spark, tmp_path):
    size = 3 << 30
    with open(tmp_path / "big.bin", "wb") as f:  # sparse: takes no space
        f.truncate(size)
        f.seek(size - 5)
        f.write(b"tail!")
    (tmp_path / "small file.csv").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "empty.csv").write_bytes(b"")
    want = hashlib.sha256()
    block = bytes(1 << 24)
    for _ in range(size // len(block) - 1):
        want.update(block)
    want.update(block[:-5] + b"tail!")
    got = {r["source_name"]: (r["sha256"], r["size"]) for r in files.file_hashes(spark, str(tmp_path)).collect()}
    assert got == {"big.bin": (want.hexdigest(), size),
                   "small file.csv": (hashlib.sha256(b"a,b\n1,2\n").hexdigest(), 8),
                   "empty.csv": (hashlib.sha256(b"").hexdigest(), 0)}


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_blocks_of_any_size_give_one_digest(spark, tmp_path, block):
    data = os.urandom(5000)
    (tmp_path / "x").write_bytes(data)
    listed = spark.createDataFrame([(f"file:{tmp_path}/x", 5000), (f"file://{tmp_path}/x", 5000)],
                                   "path string, size long")
    assert {r["sha256"] for r in files.block_hashes(listed, block).collect()} == {hashlib.sha256(data).hexdigest()}


def test_manifest_follows_every_ingest(spark, tmp_path):
    """One row per loaded file; a file that is loaded again replaces its row, others stay."""
    src = write(str(tmp_path / "in"))
    I.ingest(spark, src, str(tmp_path / "s1"))
    first = {r["source_name"]: r for r in spark.read.parquet(str(tmp_path / "s1/metadata_versions")).collect()}
    assert set(first) == set(I.LOAD_ORDER)
    for name, row in first.items():
        data = open(os.path.join(src, name), "rb").read()
        assert row["sha256"] == hashlib.sha256(data).hexdigest()
        assert row["rows_loaded"] == len(FILES[name]) - 1
    with open(os.path.join(src, "substrates.csv"), "a") as f:
        f.write("Q,QUARTZ\n")
    os.remove(os.path.join(src, "chemicals.csv"))
    I.ingest(spark, src, str(tmp_path / "s2"), prev_dir=str(tmp_path / "s1"))
    second = {r["source_name"]: r for r in spark.read.parquet(str(tmp_path / "s2/metadata_versions")).collect()}
    assert second["substrates.csv"]["rows_loaded"] == 4
    assert second["substrates.csv"]["sha256"] != first["substrates.csv"]["sha256"]
    assert second["chemicals.csv"] == first["chemicals.csv"]  # not loaded this time
    assert second["materials_map.csv"]["loaded_at"] > first["materials_map.csv"]["loaded_at"]


def test_byte_order_marks(spark, tmp_path):
    """S3: a UTF-8 byte-order mark is no part of the first column's name or value."""
    src = write(str(tmp_path / "in"))
    plain = I.ingest(spark, src, str(tmp_path / "s1"))
    for name in FILES:
        path = os.path.join(src, name)
        data = open(path, "rb").read()
        open(path, "wb").write(b"\xef\xbb\xbf" + data)
    marked = I.ingest(spark, src, str(tmp_path / "s2"))
    assert marked.status == "success"
    for t in ("substrates", "finish_codes", "chemicals", "material_chemicals"):
        a, b = (r.tables[t].drop("created_at") for r in (plain, marked))
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, t


def test_audit_of_a_published_snapshot(spark, tmp_path):
    """Q14: the audit reads what has been published."""
    out = str(tmp_path / "s1")
    I.ingest(spark, write(str(tmp_path / "in")), out)
    issues, report = I.audit(spark, out)
    assert issues.count() == 0 and report.first()["status"] == "pass"
    links = spark.read.parquet(f"{out}/sft_material_links")
    spoiled = links.unionByName(links.limit(1).withColumn("sft_code", F.lit("ST-GONE")))
    spoiled.write.parquet(str(tmp_path / "copy"))
    spark.read.parquet(str(tmp_path / "copy")).write.mode("overwrite").parquet(f"{out}/sft_material_links")
    issues, report = I.audit(spark, out)
    assert [(r["table"], r["issue"], r["n"]) for r in issues.collect()] == [("sft_material_links", "orphan_fk", 1)]
    assert report.first()["status"] == "errors"


def test_trees_of_a_code_list(spark, tmp_path):
    """A list of codes goes into every level's scan; the trees are those of a table of codes."""
    t = I.ingest(spark, write(str(tmp_path / "in")), str(tmp_path / "s1")).tables
    codes = t["finish_codes"].select("code")
    for wanted in (["KM41"], ["TE35", "KM41", "NO"], []):
        have = {r["finish_code"]: r for r in H.hierarchy(t, wanted).collect()}
        want = {r["finish_code"]: r for r in H.hierarchy(t, codes.filter(F.col("code").isin(wanted))).collect()}
        assert have.keys() == want.keys() == set(wanted) - {"NO"}
        for c in have:
            assert have[c].asDict(True).__repr__() == want[c].asDict(True).__repr__()


def test_tree_lookup_skips_row_groups(spark, tmp_path):
    from test_snapshots import scan_metrics
    steps = spark.range(300_000).select(F.concat(F.lit("C"), F.lpad((F.col("id") % 30_000).cast("string"), 6, "0"))
                                        .alias("finish_code"), F.lit("").alias("program"),
                                        F.sha2(F.col("id").cast("string"), 256).alias("sft_code"),
                                        F.col("id").alias("step_order"))
    snap = snapshots.create(steps, str(tmp_path / "s"), ["finish_code", "sft_code"], buckets=1,
                            row_group_bytes=1 << 20)
    rows, seen = scan_metrics(snap.read().filter(F.col("finish_code").isin(["C000123"])))
    assert len(rows) == 10 and seen["numOutputRows"] <= 30_000, seen
