"""The shipped sample inputs, read as data: catalogue and step goldens (FIXTURES.md
section 3), the malformed CSV sample, and the RTF source segmented back into its 259
finish codes. Point ``TESSERA_SAMPLE_INPUTS`` at the folder holding them."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import array_text
from tessera.functions.text import clean_rtf
from tessera.operators import catalogue as C
from tessera.operators.textjobs import segment_documents
from tessera.plans.ingest import ingest
from tessera.schemas import CONTRACT_BY_FILE
from tessera.sources.csv import odd_quote_file_lines, scan
from tessera.sources.files import whole_text

INPUTS = os.environ.get("TESSERA_SAMPLE_INPUTS", "")
pytestmark = pytest.mark.skipif(not INPUTS or not os.path.isdir(INPUTS), reason="TESSERA_SAMPLE_INPUTS not set")


def _one(pattern):
    (path,) = glob.glob(os.path.join(INPUTS, pattern))
    return path


def test_real_inputs_catalogue(spark, tmp_path):
    res = ingest(spark, INPUTS, str(tmp_path / "snap"))
    assert res.status == "partial"  # 4 of the 9 files ship
    t = res.tables
    assert t["finish_codes"].count() == 259 and t["sft_steps"].count() == 111
    assert t["finish_code_steps"].count() == 1052
    cat = C.spec_catalogue(t["sft_steps"], t["finish_code_steps"]).collect()
    assert len(cat) == 46 and all(r["usage_count"] > 0 for r in cat)
    assert [(r["spec"], r["usage_count"], r["step_count"]) for r in cat[:6]] == [
        ("LMA-PJ013", 219, 6), ("LMA-PJ264", 197, 41), ("LMA-PJ100", 190, 13), ("P57004", 171, 6),
        ("LMA-MR003 Class 2 Grade A", 163, 4), ("MIL-DTL-5002", 142, 6)]
    hist = t["finish_code_steps"].groupBy("finish_code").count().groupBy("count").count().collect()
    assert sorted((r[0], r[1]) for r in hist) == [(1, 7), (2, 19), (3, 48), (4, 72), (5, 72), (6, 26), (7, 5),
                                                  (8, 3)]
    assert res.report.first()["validation_status"] == "pass"


def test_malformed_sample(spark):
    p = _one("*.backup")
    c = CONTRACT_BY_FILE["finish_codes.csv"]
    on = scan(spark, p, c, multiline=True)
    assert sorted(r["_raw"].split(",")[0] for r in on.too_long.collect()) == ["FW07", "LA01", "LB01", "PP02"]
    off = scan(spark, p, c, multiline=False)  # D14: quotes do not span lines, LP01 survives
    assert sorted(r["_raw"].split(",")[0] for r in off.too_long.collect()) == ["FW07", "LA01", "PP02"]
    assert off.rows.filter(F.col("finish_code").isin("LB01", "LP01")).count() == 2
    assert [r["line_no"] for r in odd_quote_file_lines(spark, p).collect()] == [161, 162, 165, 195]


def test_rtf_segments_back_to_codes(spark):
    w = whole_text(spark, _one("*.rtf"))
    r = w.select(F.length("text").alias("n"),
                 F.regexp_extract_all("text", F.lit(r"(?i)\bSFT\d{4}\b"), 0).alias("k")).first()
    assert r["n"] == 158815 and len(r["k"]) == 1061 and len(set(r["k"])) == 100
    seg = segment_documents(w.select("name", clean_rtf("text").alias("t")), ["name"], "t")
    csv = scan(spark, os.path.join(INPUTS, "finish_codes.csv"), CONTRACT_BY_FILE["finish_codes.csv"]).rows
    c = csv.select(F.col("finish_code").alias("code"), F.array_sort(array_text("sft_steps")).alias("s2"),
                   F.col("substrate_code").alias("s"), F.col("finish_applied_code").alias("f"),
                   F.col("seq_id").alias("q"))
    j = seg.join(c, seg["finish_code"] == c["code"], "full_outer").cache()
    assert j.count() == 259 and j.filter(F.col("code").isNull() | F.col("finish_code").isNull()).count() == 0
    assert j.filter((F.col("substrate_code") == F.col("s")) & (F.col("finish_applied_code") == F.col("f"))
                    & (F.col("seq_id") == F.col("q"))).count() == 259
    assert j.filter(F.col("sft_steps") == F.col("s2")).count() >= 254  # the CSV was hand-corrected since
