"""Trees streamed at code grain: equal to the nested form, and of any size."""

import json

from pyspark.sql import functions as F

from tessera.operators import hierarchy as H
from tessera.operators import trees
from tessera.plans.ingest import ingest
from tessera.schemas import DDL

from domain_fixture import FILES, write


def documents(folder):
    """All JSON documents of the text files, each file read as one stream of documents."""
    out, decoder = [], json.JSONDecoder()
    for path in sorted(folder.glob("part-*")):
        text, at = path.read_text(), 0
        while at < len(text.rstrip()):
            while text[at].isspace():
                at += 1
            doc, at = decoder.raw_decode(text, at)
            out.append(doc)
    return out


def test_json_equals_the_nested_form(spark, tmp_path):
    more = {"finish_codes.csv": FILES["finish_codes.csv"] + [["NG07", "no steps", "N", "G", "07", ""]],
            "sft_material_links.csv": FILES["sft_material_links.csv"] + [["ST-WASH", "FX-100", "", "again"],
                                                                         ["ST-WASH", "FX-200", "GRADE 2", ""]]}
    t = ingest(spark, write(str(tmp_path / "in"), overrides=more), str(tmp_path / "s")).tables
    trees.write_trees(t, str(tmp_path / "out"))
    got = {d["finish_code"]: d for d in documents(tmp_path / "out")}
    want = {r["finish_code"]: r for r in H.hierarchy(t).collect()}
    assert got.keys() == want.keys() == {"KM41", "TE35", "NG07"}
    assert got["NG07"]["steps"] == []
    for code, w in want.items():
        g = got[code]
        assert g["parsed"] == w["parsed"].asDict(True) and g["direct_specs"] == w["direct_specs"]
        assert len(g["steps"]) == len(w["steps"])
        for a, b in zip(g["steps"], w["steps"]):
            assert (a["sft_code"], a["step_order"], a["notes"]) == (b["sft_code"], b["step_order"], b["notes"])
            assert [(m["base_spec"], m["variant"]) for m in a["materials"]] == [
                (m["base_spec"], m["variant"]) for m in b["materials"]]
            for m, n in zip(a["materials"], b["materials"]):
                assert [(c["name"], c["pct_wt_high"], c["hazard_flags"]["signal_word"]) for c in m["chemicals"]] == [
                    (c["name"], c["pct_wt_high"], c["hazard_flags"].toPython()["signal_word"]) for c in n["chemicals"]]
    assert [m["base_spec"] for m in got["KM41"]["steps"][0]["materials"]] == ["FX-100", "FX-100", "FX-200"]


def test_a_code_of_half_a_million_rows(spark, tmp_path):
    n = 500_000
    t = {name: spark.createDataFrame([], ddl) for name, ddl in DDL.items() if name != "metadata_versions"}
    t["substrates"] = spark.createDataFrame([("K", "COPPER", None, "", None)], DDL["substrates"])
    t["finish_applied"] = spark.createDataFrame([("M", "MATTE", None, "", None, None)], DDL["finish_applied"])
    t["finish_codes"] = spark.createDataFrame([("KM1", "", "K", "M", 1, None, None, None, None, None)],
                                              DDL["finish_codes"])
    ids = spark.range(n).select(F.concat(F.lit("S"), "id").alias("sft_code"), F.col("id").cast("int").alias("o"))
    null = F.lit(None).cast("string")
    t["sft_steps"] = ids.select("sft_code", *[null.alias(c) for c in (
        "parent_group", "description", "associated_specs", "source_doc", "last_review", "notes")])
    t["finish_code_steps"] = ids.select(F.lit("KM1").alias("finish_code"), F.lit("").alias("program"), "sft_code",
                                        F.col("o").alias("step_order"))
    out = trees.tree_digests(trees.tree_rows(t), F.coalesce("sft_code", F.lit("-"))).collect()
    assert [(r["finish_code"], r["n_steps"], r["n_materials"]) for r in out] == [("KM1", n, 0)]
    lines = trees.json_pieces(trees.tree_rows(t)).agg(F.count("*").alias("n"), F.max(F.length("value")).alias("w")).first()
    assert lines["n"] == n + 2 and lines["w"] < 400
