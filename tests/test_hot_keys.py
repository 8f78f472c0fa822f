"""Joins on a key that holds most rows: the key's rows are dealt over several tasks, and no result is lost."""

import pytest
from pyspark.sql import functions as F

from tessera.operators.joins import SALTS, hot_keys, resolve, salted
from tessera.operators.textjobs import enrich_lists


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def largest_share(df):
    n = [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    return max(n) / sum(n)


def test_resolve_spreads_a_hot_key(no_broadcast):
    spark = no_broadcast
    child = spark.range(20000).select("id", F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id") % 100).alias("k"))
    parent = spark.range(100).select(F.col("id").alias("pk"), (F.col("id") * 2).alias("v")).filter("pk <> 99")
    resolved, rejects = resolve(child, parent, [("k", "pk")], take=[("v", "v")])
    assert largest_share(resolved) < 0.6
    assert resolved.count() == 20000 - rejects.count() and rejects.count() == 200
    assert resolved.filter("v <> 2 * k").count() == 0
    assert {r["reason"] for r in rejects.select("reason").distinct().collect()} == {"missing_parent"}


def test_only_hot_keys_are_repeated(no_broadcast):
    spark = no_broadcast
    key = F.col("k")
    child = spark.range(30000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 5000).alias("k"))
    hot = hot_keys(child, key)
    parent = spark.range(5000).select(F.col("id").alias("k"))
    copies = {r["k"]: r["count"] for r in salted(parent, hot, key).groupBy("k").count().collect()}
    assert copies.pop(7) == SALTS and set(copies.values()) == {1}
    even = spark.range(30000).select((F.col("id") % 5000).alias("k"))
    assert salted(parent, hot_keys(even, key), key).count() == 5000
    assert salted(parent, hot_keys(even.limit(0), key), key).count() == 5000


def test_resolve_with_maps_other_types_and_hot_nulls(no_broadcast):
    spark = no_broadcast
    child = spark.range(6000).select("id", F.create_map(F.lit("a"), "id").alias("m"), F.when(
        F.col("id") % 2 == 0, F.col("id") % 50).cast("int").alias("k"))
    parent = spark.range(50).select(F.col("id").cast("double").alias("pk"), F.col("id").alias("v"))
    parent = parent.unionAll(spark.createDataFrame([(None, -1)], "pk double, v long"))
    resolved, rejects = resolve(child, parent, [("k", "pk")], take=[("v", "v")])
    assert resolved.count() == 3000 and resolved.filter("k <> v").count() == 0 and rejects.count() == 3000
    assert "m" in resolved.columns
    resolved, rejects = resolve(child, parent, [("k", "pk")], take=[("v", "v")], null_safe=["k"])
    assert rejects.count() == 0 and resolved.filter("v = -1").count() == 3000
    assert largest_share(resolved) < 0.5


def test_enrich_spreads_hot_and_blank_elements(no_broadcast):
    spark = no_broadcast
    rows = spark.range(3000).select("id", F.concat(F.lit("hot,, hot ,x"), F.col("id")).alias("t"))
    mapping = spark.createDataFrame([("hot", "hot 1"), ("", "never")], "spec string, full string").groupBy("spec").agg(
        F.max("full").alias("full"))
    out = enrich_lists(rows, ["id"], "t", mapping)
    assert out.filter(F.col("enriched") != F.concat(F.lit("hot 1,,hot 1,x"), F.col("id"))).count() == 0
    assert out.filter("n_replaced <> 2").count() == 0 and out.count() == 3000
