"""Joins and arrays of the hierarchy carry only the columns that a query returns."""

import datetime

import pytest

from tessera.operators import hierarchy as H
from tessera.plans.driver import QUERIES
from tessera.plans.roles import domain_tables

DAY = datetime.date(2020, 1, 2)
TABLES = {
    "region": ("r_regionkey long, r_name string", [(0, "ASIA")]),
    "nation": ("n_nationkey long, n_name string, n_regionkey long", [(7, "NATION_7", 0)]),
    "customer": ("c_custkey long, c_name string, c_nationkey long, c_mktsegment string",
                 [(1, "One", 7, "AUTO"), (2, "Two", 7, "AUTO"), (3, "Nowhere", 99, "AUTO")]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey long, s_acctbal double",
                 [(4, "S4", 7, 9000.0), (5, "S5", 7, 100.0), (8, "S8", 7, -1.0)]),
    "part": ("p_partkey long, p_name string, p_type string", [(10, "Ten", "T"), (11, "Eleven", "T")]),
    # Order 102 has no lines, 103 belongs to a customer of no nation.
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string, o_orderdate date",
               [(100, 1, "F", "1-HIGH", DAY), (101, 2, "O", "5-LOW", DAY), (102, 2, "O", "5-LOW", DAY),
                (103, 3, "O", "5-LOW", DAY)]),
    # Suppliers 4 and 8 give one material without variant; supplier 6 and part 12 are unknown.
    "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_discount double, l_tax double",
                 [(100, 10, 4, 0.01, 0.02), (100, 10, 5, 0.03, 0.04), (101, 10, 8, 0.05, 0.06), (101, 11, 6, 0.0, 0.0),
                  (101, 12, 5, 0.0, 0.0), (103, 10, 5, 0.01, 0.08)])}


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("narrow")
    for name, (schema, rows) in TABLES.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return str(d)


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_steps_gather_only_what_they_write(spark, sf):
    df = QUERIES["hierarchy_steps"](spark, sf)
    assert "un_number" not in plan(df)  # the hazard text
    assert {(r["finish_code"], r["sft_code"]): r["materials"] for r in df.collect()} == {
        (1, 100): "10/[S4,S8];10/V5[S5]", (2, 101): "10/[S4,S8];11/V6[]", (2, 102): "", (3, 103): "10/V5[S5]"}


def test_fields_of_the_nested_levels(spark, sf):
    t = domain_tables(spark, sf)
    whole = {r["sft_code"]: r["materials"] for r in H.step_documents(t).collect()}
    some = {r["sft_code"]: r["materials"]
            for r in H.step_documents(t, material=("notes", "variant"), chemical=("cas", "hazard_flags_raw")).collect()}
    assert set(whole[100][0].asDict()) == {*H.MATERIAL, "chemicals"}
    assert set(whole[100][0]["chemicals"][0].asDict()) == set(H.CHEMICAL)
    assert some == {k: [type(m)(notes=m["notes"], variant=m["variant"], chemicals=[
        type(m)(cas=c["cas"], hazard_flags_raw=c["hazard_flags_raw"]) for c in m["chemicals"]]) for m in ms]
        for k, ms in whole.items()}


def test_profiles_gather_only_what_they_return(spark, sf):
    df = QUERIES["material_profiles"](spark, sf)
    assert "un_number" not in plan(df)  # the hazard text
    assert sorted((tuple(r) for r in df.collect()), key=str) == [
        (10, "V5", 1, "S5", 1, 8.0), (10, None, 2, "S4,S8", 5, 8.0), (12, "V5", 1, "S5", 1, 0.0)]


def test_flat_tree_joins_the_chemicals_last(spark, sf):
    df = QUERIES["hierarchy_flat"](spark, sf)
    first = next(line for line in plan(df).splitlines() if "Join" in line)
    assert "LeftOuter" in first and "cas" in first  # the hazard text goes through no other join
    rows = [(r["finish_code"], r["sft_code"], r["base_spec"], r["variant"], r["chemical_name"], r["cas"],
             r["pct_wt_low"]) for r in df.collect()]
    assert sorted(rows, key=str) == sorted([
        (1, 100, 10, None, "S4", 4, 1.0), (1, 100, 10, None, "S8", 8, 5.0), (1, 100, 10, "V5", "S5", 5, 1.0),
        (2, 101, 10, None, "S4", 4, 1.0), (2, 101, 10, None, "S8", 8, 5.0), (2, 101, 11, "V6", None, None, 0.0),
        (2, 101, None, None, None, None, None), (2, 102, None, None, None, None, None)], key=str)
