"""Runs of a user function: rules for its results, and stopping at the first failure."""

import numpy as np
import pandas as pd

from meshtide.operators import ensemble

SCHEMA = "case_id long, depth double, u double, v double, mass_error double, cfl double, converged boolean"


def test_each_rule_has_a_failing_case(spark):
    def solver(rows):
        k = int(rows["case_id"].iloc[0])
        r = pd.DataFrame({"case_id": [k, k], "depth": [0.0, 1.0], "u": 1.0, "v": 2.0, "mass_error": 0.0, "cfl": 0.5, "converged": True})
        if k == 1:
            r.loc[1, "v"] = np.nan
        elif k == 2:
            r.loc[0, "depth"] = -1e-9
        elif k == 3:
            r["cfl"] = np.inf
        elif k == 4:
            r.loc[1, "converged"] = False
        elif k == 5:
            return r.drop(columns=["u", "v"])
        elif k == 6:
            return r.iloc[:0]
        elif k == 7:
            r.loc[0, "case_id"] = 8
        elif k == 8:
            return "text"
        return r

    got = ensemble.run_ensemble(spark.range(10).withColumnRenamed("id", "case_id"), solver, SCHEMA, rules=ensemble.FIELD_RULES).collect()
    reasons = {r["case_id"]: r["failure_reason"] for r in got if r["status"] == "failed"}
    assert reasons == {
        1: "ValueError: field is not finite", 2: "ValueError: negative depth", 3: "ValueError: diagnostics are not finite", 4: "ValueError: case did not converge",
        5: "ValueError: missing columns: u, v", 6: "ValueError: no rows", 7: "ValueError: rows of another case", 8: "TypeError: the result is no table"}
    assert sorted(r["case_id"] for r in got if r["status"] == "completed") == [0, 0, 9, 9]


def test_later_cases_do_not_begin(spark, tmp_path):
    begun = str(tmp_path)

    def solver(rows):
        k = int(rows["case_id"].iloc[0])
        open(f"{begun}/{k}", "w").close()
        if k == 5:
            raise ValueError("five")
        return pd.DataFrame({"case_id": [k]})

    cases = spark.range(40).withColumnRenamed("id", "case_id").coalesce(1)
    one_task = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        got = {r["case_id"]: r["status"] for r in ensemble.run_ensemble(cases, solver, "case_id long", fail_fast=True).collect()}
        every = ensemble.run_ensemble(cases, solver, "case_id long").count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", one_task)
    assert got == {k: "failed" if k == 5 else "completed" for k in range(6)} and every == 40
