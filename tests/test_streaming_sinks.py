"""Streaming upsert (idempotent per batch) and sinks."""

import os

from pyspark.sql import functions as F

from tessera.sources import sinks
from tessera.streaming import latest_snapshot, start_upsert_stream


def _csv(path, rows):
    with open(path, "w") as f:
        f.write("\n".join(rows) + "\n")


def test_upsert_stream(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    _csv(src / "a.csv", ["code,description", "B,BRASS", "S,STEEL", "B,BRASS2"])
    q = start_upsert_stream(spark, str(src), ["code", "description"], ["code"], str(out),
                            checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    snap = {r["code"]: r["description"] for r in latest_snapshot(spark, str(out)).collect()}
    assert snap == {"B": "BRASS2", "S": "STEEL"}
    first = {r["code"]: r["created_at"] for r in latest_snapshot(spark, str(out)).collect()}
    _csv(src / "b.csv", ["code,description", "S,STAINLESS", "A,ALUMINUM"])
    q = start_upsert_stream(spark, str(src), ["code", "description"], ["code"], str(out),
                            checkpoint=str(tmp_path / "ck"))
    q.awaitTermination()
    snap2 = latest_snapshot(spark, str(out)).collect()
    assert {r["code"]: r["description"] for r in snap2} == {"B": "BRASS2", "S": "STAINLESS", "A": "ALUMINUM"}
    assert {r["code"]: r["created_at"] for r in snap2}["S"] == first["S"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("X", 2, ["a", "b"], ["c"])], "spec string, usage_count int, sft_codes array<string>, "
                                                              "finish_codes array<string>")
    sinks.write_catalogue_csv(df, str(tmp_path / "cat"))
    back = spark.read.option("header", True).csv(str(tmp_path / "cat")).first()
    assert back.asDict() == {"specification": "X", "usage_count": "2", "sft_codes": "a;b", "finish_codes": "c"}
    nested = spark.createDataFrame([(1, [("a", 2)])], "id int, items array<struct<k:string,v:int>>")
    sinks.write_documents(nested, str(tmp_path / "docs"))
    assert spark.read.text(str(tmp_path / "docs")).first()["value"] == '{"id":1,"items":[{"k":"a","v":2}]}'
    try:
        sinks.write_csv(df.select("spec"), str(tmp_path / "cat"), source=str(tmp_path / "cat"))
        raise AssertionError("expected refusal")
    except ValueError:
        pass


def test_catalogue_csv_document_form(spark, tmp_path):
    from tessera.operators.catalogue import catalogue_csv
    lists = spark.createDataFrame([("X", ["S1", "S2", "S3", "S4", "S5", "S6"], ["A", "B", "C", "D", "E", "F"], 6)],
                                  "spec string, sft_codes array<string>, finish_codes array<string>, usage_count int")
    row = catalogue_csv(lists).first()
    assert row["sft_codes"] == "S1;S2;S3;S4;S5;S6" and row["finish_codes"] == "A;B;C;D;E..."


def test_table_json_and_manifest_order(spark, tmp_path):
    from tessera.sources.files import latest_load, manifest_newest_first
    df = spark.createDataFrame([("a.csv", "s1", 1), ("b.csv", "s2", 3), ("c.csv", "s3", 2)],
                               "source_name string, sha256 string, loaded_at long")
    for mode, n in (("overwrite", 3), ("append", 6), ("overwrite", 3)):
        sinks.write_table(df, str(tmp_path / "t"), mode)
        assert spark.read.parquet(str(tmp_path / "t")).count() == n
    sinks.write_json(df, str(tmp_path / "j"))
    assert {r["source_name"] for r in spark.read.json(str(tmp_path / "j")).collect()} == {"a.csv", "b.csv", "c.csv"}
    assert [r["source_name"] for r in manifest_newest_first(df).collect()] == ["b.csv", "c.csv", "a.csv"]
    assert latest_load(df).first()["csv_shas"]["c.csv"] == "s3"


def test_odd_quote_lines_of_files_by_line(spark, tmp_path):
    from tessera.sources.csv import odd_quote_file_lines
    (tmp_path / "a.csv").write_text('h"ead\n' + 'x,"y"\n' * 5 + 'bad"\n' + "z\n" * 3 + '"\n')
    assert [(r["name"], r["line_no"]) for r in odd_quote_file_lines(spark, str(tmp_path)).orderBy("line_no").collect()] \
        == [("a.csv", 7), ("a.csv", 11)]
