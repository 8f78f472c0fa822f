"""Goldens on the 28-row fixture: ingest, audit, hierarchy, catalogue, lookups."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import catalogue as C
from tessera.operators import hierarchy as H
from tessera.plans.ingest import ingest

from domain_fixture import write


@pytest.fixture(scope="module")
def loaded(spark, tmp_path_factory):
    src = write(str(tmp_path_factory.mktemp("in")))
    out = str(tmp_path_factory.mktemp("snap") / "s1")
    return ingest(spark, src, out), src, out


def test_ingest_status_and_rows(loaded):
    res, _, _ = loaded
    assert res.status == "success"
    rows = {r["source_name"]: r["rows"] for r in res.files.collect()}
    assert rows == {"substrates.csv": 3, "finish_applied.csv": 3, "finish_codes.csv": 2, "sft_steps.csv": 3,
                    "finish_code_steps.csv": 3, "materials_map.csv": 3, "chemicals.csv": 3,
                    "sft_material_links.csv": 3, "material_chemicals.csv": 5}
    rep = res.report.first()
    assert (rep["validation_status"], rep["error_count"], rep["warning_count"]) == ("pass", 0, 0)
    assert all(len(r["sha256"]) == 64 for r in res.files.collect())


def test_tree_of_a_code(loaded):
    res, _, _ = loaded
    doc = H.hierarchy(res.tables, res.tables["finish_codes"].filter(F.col("code") == "KM41").select("code")).first()
    p = doc["parsed"]
    assert (p["substrate"]["code"], p["substrate"]["description"]) == ("K", "COPPER")
    assert (p["finish_applied"]["code"], p["finish_applied"]["description"]) == ("M", "MATTE LACQUER")
    assert p["seq_id"] == 41
    steps = doc["steps"]
    assert [(s["sft_code"], s["step_order"]) for s in steps] == [("ST-WASH", 1), ("ST-LACQUER", 2)]
    m1 = steps[0]["materials"]
    assert [(m["base_spec"], m["variant"]) for m in m1] == [("FX-100", None)]
    chems = [(c["name"], c["pct_wt_low"], c["pct_wt_high"], c["default_hazard_level"]) for c in m1[0]["chemicals"]]
    assert chems == [("Lye Blend", 12.0, 22.0, 4), ("Rinse Oil", 40.0, 60.0, 1)]
    assert [c["name"] for c in steps[1]["materials"][0]["chemicals"]] == ["Iron Salt"]
    assert steps[1]["materials"][0]["chemicals"][0]["hazard_flags"].toPython()["categories"] == ["IRRITANT"]
    assert doc["provenance"]["csv_shas"]["substrates.csv"]
    assert doc["direct_specs"] == [] and doc["finish_applied_specs"] == []


def test_tree_with_variant(loaded):
    res, _, _ = loaded
    doc = H.hierarchy(res.tables).filter(F.col("finish_code") == "TE35").first()
    (step,) = doc["steps"]
    assert step["sft_code"] == "ST-ETCH"
    (mat,) = step["materials"]
    assert (mat["base_spec"], mat["variant"]) == ("FX-200", "GRADE 2")
    assert [(c["name"], c["pct_wt_low"], c["pct_wt_high"]) for c in mat["chemicals"]] == [
        ("Iron Salt", 8.0, 15.0), ("Rinse Oil", 65.0, 85.0)]


def test_step_documents(loaded):
    res, _, _ = loaded
    rows = {(r["finish_code"], r["sft_code"]): r for r in H.step_documents(res.tables).collect()}
    assert set(rows) == {("KM41", "ST-WASH"), ("KM41", "ST-LACQUER"), ("TE35", "ST-ETCH")}
    assert [c["name"] for c in rows[("KM41", "ST-WASH")]["materials"][0]["chemicals"]] == ["Lye Blend", "Rinse Oil"]


def test_code_list_and_lookup(loaded):
    res, _, _ = loaded
    assert [r["code"] for r in H.code_list(res.tables).collect()] == ["KM41", "TE35"]
    req = res.tables["finish_codes"].sparkSession.createDataFrame([("ZZ99",), ("TE35",)], "code string")
    rows = {r["requested"]: r for r in H.lookup(res.tables, req).collect()}
    assert rows["ZZ99"]["error"] == "Finish code not found"
    assert rows["ZZ99"]["available_codes"] == ["KM41", "TE35"]
    assert rows["TE35"]["error"] is None and rows["TE35"]["steps"][0]["sft_code"] == "ST-ETCH"


def test_hazard_filter(loaded):
    res, _, _ = loaded
    assert [r["name"] for r in H.chemicals_by_hazard(res.tables["chemicals"], 4).collect()] == [
        "Iron Salt", "Lye Blend"]
    assert [r["name"] for r in H.chemicals_by_hazard(res.tables["chemicals"], 1).collect()] == [
        "Iron Salt", "Lye Blend", "Rinse Oil"]
    with pytest.raises(ValueError):
        H.chemicals_by_hazard(res.tables["chemicals"], 6)


def test_tag_exposure(loaded):
    res, _, _ = loaded
    got = {r["finish_code"]: r["tagged_count"] for r in H.tag_exposure(res.tables, "IRRITANT").collect()}
    assert got == {"KM41": 2, "TE35": 1}
    assert H.tag_exposure(res.tables, "CARCINOGEN").count() == 0


def test_catalogue_and_code_specs(loaded):
    res, _, _ = loaded
    t = res.tables
    cat = C.spec_usage(t["sft_steps"], t["finish_code_steps"]).collect()
    assert [(r["spec"], r["usage_count"], r["step_count"]) for r in cat] == [
        ("FX-100", 1, 1), ("FX-200", 1, 1), ("FX-300", 1, 1)]
    rows = C.spec_catalogue(t["sft_steps"], t["finish_code_steps"]).filter("spec = 'FX-100'").collect()
    assert {(r["kind"], r["value"]) for r in rows} == {("step", "ST-WASH"), ("code", "KM41")}
    assert C.total_specs(t["sft_steps"]).first()["total_specs"] == 3
    lists = {r["spec"]: r for r in C.catalogue_lists(t["sft_steps"], t["finish_code_steps"]).collect()}
    assert lists["FX-100"]["finish_codes"] == ["KM41"]
    cs = C.code_specs(t["sft_steps"], t["finish_code_steps"]).filter(F.col("code") == "KM41") \
        .orderBy("step_order").collect()
    assert [r["sft_code"] for r in cs] == ["ST-WASH", "ST-LACQUER"]
    assert all(r["spec_count"] == 2 for r in cs)
    assert all(len(r["description"]) == 80 and r["description"].endswith("...") for r in cs)
    sets = {r["code"]: r["specifications"] for r in C.code_spec_sets(
        C.code_specs(t["sft_steps"], t["finish_code_steps"])).collect()}
    assert sets["KM41"] == ["FX-100", "FX-300"]


def test_flat_and_code_chemicals(loaded):
    res, _, _ = loaded
    flat = H.flat_tree(res.tables).filter(F.col("finish_code") == "KM41").collect()
    assert sorted((r["sft_code"], r["chemical_name"]) for r in flat) == [
        ("ST-LACQUER", "Iron Salt"), ("ST-WASH", "Lye Blend"), ("ST-WASH", "Rinse Oil")]
    cc = H.code_chemicals(res.tables).filter(F.col("finish_code") == "TE35").collect()
    assert sorted(r["name"] for r in cc) == ["Iron Salt", "Rinse Oil"]


def test_reingest_is_idempotent(spark, loaded, tmp_path_factory):
    res, src, out = loaded
    out2 = str(tmp_path_factory.mktemp("snap") / "s2")
    res2 = ingest(spark, src, out2, prev_dir=out)
    assert res2.status == "success"
    for t in ("substrates", "finish_codes", "finish_code_steps", "materials", "sft_material_links", "chemicals",
              "material_chemicals"):
        a = res.tables[t].drop("created_at")
        b = res2.tables[t].drop("created_at")
        assert a.count() == b.count(), t
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, t
    # created_at survives the upsert
    c1 = {r["code"]: r["created_at"] for r in res.tables["finish_codes"].collect()}
    c2 = {r["code"]: r["created_at"] for r in res2.tables["finish_codes"].collect()}
    assert c1 == c2


def test_code_specs_lookup(loaded, spark):
    res, _, _ = loaded
    req = spark.createDataFrame([("KM41",), ("NOPE",)], "code string")
    rows = {r["requested"]: r for r in C.code_specs_lookup(res.tables, req).collect()}
    assert rows["KM41"]["specifications"] == ["FX-100", "FX-300"] and rows["KM41"]["spec_count"] == 2
    assert rows["NOPE"]["error"] == "Finish code not found" and rows["NOPE"]["available_codes"] == ["KM41", "TE35"]
