"""Text jobs over document tables."""

from tessera.operators import textjobs as X


def test_segment_documents(spark):
    df = spark.createDataFrame([(1, "junk BP27  brass passivate SFT0102 x SFT0001 SA12 steel")], "id int, t string")
    rows = X.segment_documents(df, ["id"], "t", clean=True).orderBy("seg_no").collect()
    assert [(r["finish_code"], r["finish_code_description"], r["sft_steps"]) for r in rows] == [
        ("BP27", "brass passivate", ["SFT0001", "SFT0102"]), ("SA12", "steel", [])]
    assert rows[0]["sft_steps_json"] == '["SFT0001", "SFT0102"]'
    assert (rows[0]["substrate_code"], rows[0]["finish_applied_code"], rows[0]["seq_id"]) == ("B", "P", "27")


def test_enrich_lists_and_changes(spark):
    types = spark.createDataFrame([("AMS2460", "Class 2", 1), ("MIL-A-8625", "-", 2), ("AMS2460", "Class 3", 3),
                                   ("P5", "", 4)], "specification string, `Type / Class / Grade` string, o int")
    m = X.spec_type_map(types, order=["o"])
    got = {r["spec"]: r["full"] for r in m.collect()}
    assert got == {"AMS2460": "AMS2460 Class 3", "MIL-A-8625": "MIL-A-8625", "P5": "P5"}
    docs = spark.createDataFrame([(1, "AMS2460, X,,MIL-A-8625"), (2, "  "), (3, "Y"), (4, None)],
                                 "id int, specs string")
    out = {r["id"]: (r["enriched"], r["n_replaced"], r["changed"])
           for r in X.enrich_lists(docs, ["id"], "specs", m).collect()}
    assert out == {1: ("AMS2460 Class 3,X,,MIL-A-8625", 1, True), 2: ("  ", 0, False), 3: ("Y", 0, False),
                   4: (None, 0, False)}
    # enriching again changes nothing (an enriched spec is not a dictionary key)
    again = X.enrich_lists(spark.createDataFrame([(1, out[1][0])], "id int, specs string"), ["id"], "specs", m)
    assert X.changed_rows(again).count() == 0
    # stripping alone is a change: "A , B" becomes "A,B"
    spaced = X.enrich_lists(spark.createDataFrame([(1, "Y , Z")], "id int, specs string"), ["id"], "specs", m)
    assert [(r["enriched"], r["changed"]) for r in spaced.collect()] == [("Y,Z", True)]


def test_extract_spec_column(spark):
    df = spark.createDataFrame([(1, "Clean per ASTM B-600 then seal IAW MIL-A-8625")], "id int, description string")
    assert X.extract_spec_column(df).first()["associated_specs"] == "ASTMB-600,MIL-A-8625"


def test_odd_quote_lines(spark):
    df = spark.createDataFrame([("f", 'h\nA,"ok"\nB,"bad\nC')], "name string, text string")
    rows = X.odd_quote_lines(df, ["name"], "text", skip_header=True).collect()
    assert [(r["line_no"], r["n_quotes"]) for r in rows] == [(3, 1)]


def test_quote_profile(spark):
    df = spark.createDataFrame([("f", 'h\nA,"ok"\r\nB,"bad\nC')], "name string, text string")
    r = X.quote_profile(df, ["name"], "text").first()
    assert (r["n_lines"], r["n_quotes"], r["n_odd_lines"]) == (4, 3, 1)


def test_text_file_jobs(spark, tmp_path):
    from tessera.plans.textfiles import enrich_step_specs, finish_codes_from_rtf, with_extracted_specs
    rtf = tmp_path / "spec.rtf"
    rtf.write_text(r"{\rtf1 intro {\b AA01} hard anodize SFT0103 SFT0901 0000 none SFT0001}")
    rows = [r.asDict() for r in finish_codes_from_rtf(spark, str(rtf)).collect()]
    assert rows == [
        {"finish_code": "AA01", "substrate_code": "A", "finish_applied_code": "A", "seq_id": "01",
         "finish_code_description": "HARD ANODIZE", "sft_steps": '["SFT0103", "SFT0901"]'},
        {"finish_code": "0000", "substrate_code": "0", "finish_applied_code": "0", "seq_id": "00",
         "finish_code_description": "NONE", "sft_steps": '["SFT0001"]'}]
    steps = spark.createDataFrame([("S1", "CLEAN IAW LMA-PG101, P57004 OR MIL-DTL-5002"), ("S2", "DRY")],
                                  "sft_code string, description string")
    got = {r["sft_code"]: r["associated_specs"] for r in with_extracted_specs(steps).collect()}
    assert got == {"S1": "P57004,LMA-PG101,MIL-DTL-5002", "S2": ""}
    types = spark.createDataFrame([("P57004", "Type II")], "specification string, `Type / Class / Grade` string")
    out, changed = enrich_step_specs(with_extracted_specs(steps), types)
    assert {r["sft_code"]: r["associated_specs"] for r in out.collect()}["S1"] == \
        "P57004 Type II,LMA-PG101,MIL-DTL-5002"
    assert [(r["sft_code"], r["new"]) for r in changed.collect()] == [("S1", "P57004 Type II,LMA-PG101,MIL-DTL-5002")]
