"""Keyed snapshots: upserts by bucket, commits, lookups that skip row groups."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tessera.sources import snapshots


def scan_metrics(df):
    """Sum of the scans' metrics after the query has run."""
    rows = df.collect()
    out, todo = {"numFiles": 0, "numOutputRows": 0}, [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        if "FileSourceScan" in plan.getClass().getSimpleName():
            for k in out:
                out[k] += plan.metrics().get(k).get().value()
        kids = plan.children()
        todo += [kids.apply(i) for i in range(kids.size())]
    return rows, out


def files(root):
    return {str(p.relative_to(root)): (p.stat().st_mtime_ns, p.read_bytes()) for p in Path(root).rglob("*.parquet")}


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    root = str(tmp_path / "snap")
    base = spark.range(400).select(F.concat(F.lit("k"), "id").alias("code"), (F.col("id") % 7).alias("v"),
                                   F.lit(1).alias("created_at"))
    first = snapshots.create(base, root, ["code"], buckets=16)
    before = files(root)
    assert len({p.split("/")[2] for p in before}) == 16
    rng, want = random.Random(3), {r.code: (r.v, 1) for r in base.collect()}
    new = [(f"k{rng.choice([5, 17, 400, 401])}", rng.randrange(10 ** 6), 2, n) for n in range(30)]
    for code, v, c, _ in new:
        want[code] = (v, want.get(code, (0, 2))[1])
    second = first.upsert(spark.createDataFrame(new, "code string, v long, created_at int, seq int"), ["seq"],
                          created_col="created_at")
    assert {r.code: (r.v, r.created_at) for r in second.read().collect()} == want
    after = files(root)
    assert all(after[p] == before[p] for p in before)  # nothing was changed in place
    touched = {b for b in second.live if second.live[b] != first.live.get(b)}
    assert 1 <= len(touched) <= 4 and len(second.live) == 16
    assert {p.split("/")[2] for p in after.keys() - before.keys()} == {f"bucket={b}" for b in touched}
    assert snapshots.open_snapshot(spark, root).live == second.live
    assert first.read().count() == 400 and snapshots.open_snapshot(spark, root, 1).read().count() == 400
    assert second.upsert(spark.createDataFrame([], base.schema)) is second
    gone = snapshots.vacuum(second)
    assert len(gone) == len(touched) and second.read().count() == len(want)


def test_a_second_writer_fails(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    first = snapshots.create(df, str(tmp_path / "s"), ["k"], buckets=4)
    second = first.upsert(spark.createDataFrame([("a", 5)], "k string, v int"))
    with pytest.raises(RuntimeError):
        first.upsert(spark.createDataFrame([("b", 6)], "k string, v int"))
    assert sorted(map(tuple, snapshots.open_snapshot(spark, str(tmp_path / "s")).read().collect())) == \
        [("a", 5), ("b", 2)] == sorted(map(tuple, second.read().collect()))
    with pytest.raises(ValueError):
        snapshots.create(df, str(tmp_path / "s"), ["k"])


def test_keys_with_null_and_several_columns(spark, tmp_path):
    df = spark.createDataFrame([("a", None, 1), ("a", "x", 2), (None, None, 3)], "b string, v string, n int")
    snap = snapshots.create(df, str(tmp_path / "s"), ["b", "v"], buckets=5)
    snap = snap.upsert(spark.createDataFrame([("a", None, 10), ("z", "y", 4)], "b string, v string, n int"))
    assert sorted(r.n for r in snap.read().collect()) == [2, 3, 4, 10]
    assert [r.n for r in snap.lookup(("a", None)).collect()] == [10]
    assert sorted(r.n for r in snap.lookup((None, None), ("z", "y"), ("q", "q")).collect()) == [3, 4]
    assert snap.lookup().count() == 0
    empty = snapshots.create(df.limit(0), str(tmp_path / "e"), ["b"])
    assert empty.read().count() == 0 and empty.lookup("a").count() == 0
    assert [r.n for r in empty.upsert(df.filter("n = 2")).lookup("a").collect()] == [2]


def test_lookup_opens_one_row_group(spark, tmp_path):
    base = spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("code"),
                                       F.sha2((-F.col("id")).cast("string"), 512).alias("payload"))
    snap = snapshots.create(base, str(tmp_path / "s"), ["code"], buckets=4, row_group_bytes=1 << 20)
    code = base.first().code
    rows, seen = scan_metrics(snap.lookup(code))
    assert [r.code for r in rows] == [code]
    _, whole = scan_metrics(snap.read())
    assert whole["numOutputRows"] == 200_000
    assert seen["numFiles"] <= whole["numFiles"] / 2 and seen["numOutputRows"] <= 8_000, (seen, whole)
    rows, seen = scan_metrics(snap.lookup("0" * 64 + "x"))
    assert rows == [] and seen["numOutputRows"] <= 8_000
