"""Fault-seeded audits: one seed per rule (V1-V12) and the roll-up."""

from pyspark.sql import functions as F

from tessera.operators import audit as A
from tessera.schemas import DDL, domain_rules


def tables(spark, **rows):
    return {t: spark.createDataFrame(rows.get(t, []), DDL[t]) for t in DDL}


def test_clean_tables_pass(spark):
    t = tables(spark)
    rep = A.report(A.issues(spark, t, domain_rules())).first()
    assert (rep["status"], rep["error_count"], rep["warning_count"]) == ("pass", 0, 0)


def test_fault_seeds(spark):
    t = tables(
        spark,
        substrates=[("B", "BRASS", None, "", None)],
        finish_applied=[("P", "PASS", None, "", None, None)],
        finish_codes=[("BP7", "", "B", "P", 7, None, None, None, None, None),      # unpadded: accepted
                      ("XX99", "", "B", "P", 99, None, None, None, None, None),    # mismatch
                      ("BP27", "", "Z", "P", 27, None, None, None, None, None),    # orphan substrate
                      ("BP27", "", "B", "P", 27, None, None, None, None, None)],   # duplicate key
        sft_steps=[("S1", None, None, None, None, None, None, None)],            # NULL description
        finish_code_steps=[("BP7", "", "S1", 1, None), ("BP7", "", "S2", 1, None)],  # orphan step, dup order
        materials=[("M", None, "", "", None), ("M", None, "", "", None)],        # NULL-variant duplicate
        sft_material_links=[("S1", "M", None, None, None), ("S1", "Q", None, None, None)],  # one orphan
        chemicals=[("A", "50-00-0", "{bad", 0, "50-00-0", None), ("B", "abc", None, 6, "abc", None),
                   ("C", "7732-18-5", '{"ghs":[]}', 3, "7732-18-5", None)],
        material_chemicals=[("M", None, "7732-18-5", 30.0, 20.0, None, None),
                            ("M", None, "abc", 10.0, 80.5, None, None)],
    )
    iss = A.issues(spark, t, domain_rules()).cache()
    got = {(r["table"], r["issue"]) for r in iss.collect()}
    expected = {
        ("finish_codes", "orphan_fk"), ("finish_code_steps", "orphan_fk"), ("sft_material_links", "orphan_fk"),
        ("sft_steps", "null_value"), ("finish_codes", "duplicate_key"), ("finish_code_steps", "duplicate_key"),
        ("materials", "duplicate_key"), ("chemicals", "invalid_cas_format"), ("chemicals", "invalid_json"),
        ("chemicals", "out_of_range"), ("material_chemicals", "invalid_range"),
        ("material_chemicals", "exceeds_100_percent"), ("finish_codes", "code_mismatch"),
    }
    assert expected - got == set(), expected - got
    mism = {r["row_key"] for r in iss.filter(F.col("issue") == "code_mismatch").collect()}
    assert mism == {"XX99|", "BP27|"}  # BP7 (seq 7, unpadded) is accepted
    cas = {r["row_key"] for r in iss.filter(F.col("issue") == "invalid_cas_format").collect()}
    assert cas == {"A", "B"}
    lv = {r["row_key"] for r in iss.filter(F.col("issue") == "out_of_range").collect()}
    assert lv == {"A", "B"}
    rep = A.report(iss).first()
    assert rep["status"] == "errors" and rep["summary"].startswith("Validation FAILED")
    counts = A.issue_counts(spark, t, domain_rules())
    direct = {tuple(r[:5]): r["n_issues"] for r in counts.collect()}
    grouped = {tuple(r[:5]): r["count"] for r in iss.groupBy(*A.COUNT_KEYS).count().collect()}
    assert direct == grouped
    assert A.report_from_counts(counts).first().asDict() == rep.asDict()


def test_missing_parent_table_and_nulls_in_parent(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,), (None,)], "k int")
    from tessera.operators.joins import orphan_count
    assert orphan_count(child, ["k"], parent, ["k"]).first()["orphan_count"] == 1  # NULL parent hides nothing
    rules = A.Rules(foreign_keys=[A.ForeignKey("c", ("k",), "p", ("k",))])
    iss = A.issues(spark, {"c": child}, rules).collect()
    assert [r["issue"] for r in iss] == ["missing_parent_table"]


def test_sum_exactly_100_is_fine(spark):
    df = spark.createDataFrame([("M", 60.0), ("M", 40.0), ("N", 60.0), ("N", 40.5), ("P", 60.0), ("P", 40.004)],
                               "m string, v double")
    rules = A.Rules(sum_limits=[A.SumLimit("t", ("m",), "v", 100.0)])
    got = {r["row_key"]: r["details"] for r in A.issues(spark, {"t": df}, rules).collect()}
    assert got == {"N": "total 100.5", "P": "total 100.0"}  # compared exactly, shown rounded


def test_step_sequence_rule(spark):
    df = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1), ("B", 3), ("C", 2), ("D", 1), ("D", 1)],
                               "code string, step_order int")
    rules = A.Rules(sequences=[A.StepSequence("s", ("code",), "step_order")])
    assert sorted(r["row_key"] for r in A.issues(spark, {"s": df}, rules).collect()) == ["B", "C", "D"]


def test_foreign_keys_compare_values_in_a_common_type(spark):
    t = {"child": spark.createDataFrame([(1, "1", "a\x1fb"), (2, "2", "a"), (3, "x", None)], "i int, s string, u string"),
         "doubles": spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "d double"),
         "longs": spark.createDataFrame([(1,), (2,)], "l long"),
         "pairs": spark.createDataFrame([("a", "b\x1fc"), (None, "c")], "p string, q string"),
         "twos": spark.createDataFrame([("a\x1fb", "c"), ("a", "c"), (None, "c"), (None, None)], "p string, q string")}
    fks = [A.ForeignKey("child", ("i",), "doubles", ("d",)), A.ForeignKey("child", ("i",), "longs", ("l",)),
           A.ForeignKey("child", ("s",), "longs", ("l",)),
           A.ForeignKey("twos", ("p", "q"), "pairs", ("p", "q")),
           A.ForeignKey("twos", ("p", "q"), "pairs", ("p", "q"), null_safe=("p",)),
           A.ForeignKey("twos", ("p", "q"), "pairs", ("p", "q"), null_safe=("p", "q"))]
    got = {r["rule"]: r["orphan_count"] for r in A.orphan_counts(t, fks).collect()}
    assert got == {1: 1, 2: 1, 3: 2, 4: 2, 5: 3}


def test_unique_counts_and_counts_equal_issue_rows(spark):
    t = {"a": spark.createDataFrame([(1, "x", 2), (1, "x", 3), (1, None, 4), (1, None, 5), (2, "y", None)],
                                    "k int, s string, v int"),
         "b": spark.createDataFrame([(1,), (1,), (9,)], "k long"), "e": spark.createDataFrame([], "k date")}
    rules = A.Rules(foreign_keys=[A.ForeignKey("b", ("k",), "a", ("k",)), A.ForeignKey("b", ("k",), "gone", ("k",))],
                    required=[A.Required("a", ("s", "v", "k")), A.Required("gone", ("x",))],
                    unique=[A.Unique("a", ("k", "s")), A.Unique("a", ("v",)), A.Unique("b", ("k",)),
                            A.Unique("e", ("k",)), A.Unique("gone", ("x",))],
                    row_checks=[A.range_check("a", "v", 3, 4, ["k"])])
    got = {r["rule"]: (r["duplicate_keys"], r["surplus_rows"]) for r in A.unique_counts(t, rules.unique[:4]).collect()}
    assert got == {0: (2, 2), 1: (0, 0), 2: (1, 1)}
    counted = {tuple(r) for r in A.issue_counts(spark, t, rules).collect()}
    rows = A.issues(spark, t, rules).groupBy(A.COUNT_KEYS).count()
    assert counted == {tuple(r) for r in rows.collect()} and len(counted) == 7


def test_audit_counts_read_each_table_once(spark, tmp_path):
    from tessera.plans.driver import _all_rules, _audit_tables
    t = _audit_tables(spark, "/root/testdata/sf0.001")
    rules = _all_rules()
    rules.sum_limits = []
    plan = A.issue_counts(spark, t, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert len(set(t)) == len(t) and "orders" in t and t.get("none") is None
    # Derived tables (joins, filtered copies) read their sources, too.
    assert plan.count("Relation [") <= len(rules_tables(rules)) + 10


def rules_tables(rules):
    return ({x for fk in rules.foreign_keys for x in (fk.child, fk.parent)} | {r.table for r in rules.required}
            | {u.table for u in rules.unique} | {c.table for c in rules.row_checks}
            | {c.table for c in rules.compositions})
