"""The nested hierarchy (A11) on driver-derived tables agrees with the relational
summary and the flat tree for the same codes."""

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import hierarchy as H
from tessera.plans.driver import QUERIES
from tessera.plans.roles import domain_tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver test data not present")


def test_nested_matches_summary(spark):
    t = domain_tables(spark, SF)
    codes = t["finish_codes"].select("code").orderBy("code").limit(5)
    docs = {r["finish_code"]: r for r in H.hierarchy(t, codes).collect()}
    summ = {r["finish_code"]: r for r in QUERIES["hierarchy_summary"](spark, SF)
            .join(codes, F.col("finish_code") == F.col("code"), "left_semi").collect()}
    assert set(docs) == set(summ) and len(docs) == 5
    for code, d in docs.items():
        s = summ[code]
        steps = d["steps"]
        assert len(steps) == s["n_steps"]
        if steps:
            assert steps[0]["sft_code"] == s["first_step"] and steps[-1]["sft_code"] == s["last_step"]
            keys = [(x["step_order"], x["sft_code"]) for x in steps]
            assert keys == sorted(keys)
        assert sum(len(x["materials"]) for x in steps) == s["n_links"]
        chems = {c["cas"] for x in steps for m in x["materials"] for c in m["chemicals"]}
        assert len(chems) == s["n_chemicals"]
        for x in steps:
            for m in x["materials"]:
                lv = [(-(c["default_hazard_level"]) if c["default_hazard_level"] is not None else 1 << 31, c["name"])
                      for c in m["chemicals"]]
                assert lv == sorted(lv)  # level desc, NULL last, then name
