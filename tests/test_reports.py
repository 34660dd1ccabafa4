"""Reports with known answers: steps, grades, field names, fronts, tiers, ranks, totals, normals, markers, masks, reasons, candidates."""

import random

import pytest
from pyspark.sql import functions as F

from meshtide.operators import ensemble, graph, mesh, quality, raster, series, web


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_step_diagnostics(spark):
    d = spark.createDataFrame([(1, 0, 1.0, 0.0, 0.0, 2.0), (1, 1, 1.0, 30.0, 40.0, 2.0), (1, 2, 1e-4, 0.0, 0.0, 2.0), (2, 0, 1e-4, 9.0, 9.0, 1.0), (2, 1, 1e-4, 0.0, 0.0, 1.0), (2, 2, 0.0, 9.0, 0.0, 1.0)], "cell long, step int, h double, hu double, hv double, area double")
    got = rows(series.step_diagnostics(series.regularised(series.hysteresis(d), 1e-3, 20.0)), "step")
    assert got[0] == (0, 1, 0, 0, 0, 1e-4, 1e-3, 0.0, 0.0)
    assert got[1] == pytest.approx((1, 1, 0, 0, 1, 1e-4, 1e-3, 50.0, 20.0))
    assert got[2] == pytest.approx((2, 0, 0, 1, 0, 2e-4, 3e-3, 0.0, 0.0))


def test_grades(spark):
    d = spark.createDataFrame([(80.0,), (79.9,), (65.0,), (50.0,), (49.9,), (None,)], "s double")
    assert {r.s: r.g for r in d.withColumn("g", series.grade(F.col("s"))).collect()} == {80.0: "A", 79.9: "B", 65.0: "B", 50.0: "C", 49.9: "D", None: None}


def test_field_names(spark):
    d = spark.createDataFrame([("a", '{"obsTime": 1, "rows": [{"Discharge": 2, "x": [1, [2]]}, {"流量": null}]}'), ("a", '{"rows": [], "stage": 3}'), ("b", '{"k": 1}'), ("c", "no json"), ("d", None)], "id string, j string")
    got = rows(series.field_names(web.flattened(d, "id", "j")), "id")
    assert got == [("a", ["Discharge", "obsTime", "rows", "stage", "x", "流量"], ["Discharge", "流量"]), ("b", ["k"], [])]


def test_front_errors(spark):
    fronts = spark.createDataFrame([(1, 5.0), (2, None), (3, 1.0)], "group int, front_max double")
    got = rows(quality.front_errors(fronts, spark.createDataFrame([(1, 7.0), (2, 1.0)], "group int, reference double"), 4.0), "group")
    assert got == [(1, 5.0, 7.0, 2.0, 0.5), (2, None, 1.0, None, None), (3, 1.0, None, None, None)]
    with pytest.raises(ValueError):
        quality.front_errors(fronts, fronts, 0.0)


GOOD = {"requested": 4, "completed": 4, "failed": 0, "listed": 0, "nan_count": 0, "negative_count": 0, "cfl": 0.5, "mass": -1e-9, "wall_s": 10.0, "memory": 5.0, "min_depth": 0.0}
FAULTS = {
    "fine": ({}, [], []), "requested": ({"requested": 5, "completed": 5}, ["requested"], []), "accounting": ({"completed": 3}, ["accounting"], ["completion"]), "failures": ({"listed": 1}, ["failures"], []),
    "finite": ({"cfl": float("nan")}, ["cfl"], ["cfl"]), "null": ({"mass": None}, ["mass"], ["mass"]), "nan": ({"nan_count": 1}, [], ["nan_count"]), "negative": ({"negative_count": 1}, [], ["negative_count"]),
    "cfl": ({"cfl": 0.96}, [], ["cfl"]), "mass": ({"mass": -2e-8}, [], ["mass"]), "wall": ({"wall_s": 11.0}, [], ["wall"]), "memory": ({"memory": 6.0}, [], ["memory"]), "depth": ({"min_depth": -1.0}, [], ["min_depth"]),
}


def test_every_limit_of_a_tier_has_a_failing_report(spark):
    types = {k: "long" if isinstance(v, int) else "double" for k, v in GOOD.items()}
    reports = spark.createDataFrame([(name, *{**GOOD, **change}.values()) for name, (change, _, _) in FAULTS.items()], "tier string, " + ", ".join(f"{k} {t}" for k, t in types.items()))
    order = [*FAULTS, "absent"]
    tiers = spark.createDataFrame([(name, ix, 4, 10.0, 5.0) for ix, name in enumerate(order)], "tier string, ix int, cases long, wall_s double, memory double")
    limits = {"completion": 1.0, "nan_count": 0, "negative_count": 0, "cfl": 0.95, "mass": 1e-8}
    got = {r["tier"]: r for r in quality.tier_report(reports, tiers, limits).collect()}
    assert {k: (r["problems"], r["failed"]) for k, r in got.items() if k != "absent"} == {k: (problems, failed) for k, (_, problems, failed) in FAULTS.items()}
    assert [k for k, r in got.items() if r["passed"]] == ["fine"] and got["fine"]["next_tier"] == "requested"
    assert got["absent"]["problems"][0] == "missing" and got["absent"]["next_tier"] is None


def test_messages_of_blockers(spark):
    d = spark.createDataFrame([(1, 5), (2, None), (3, 1)], "k int, v int")
    rules = [("low", "$.v", F.concat(F.lit("k"), F.col("k")), F.col("v") < 3), ("any", "$", "always", F.lit(True))]
    assert rows(quality.blockers(d, "k", rules), "k") == [(1, "low", "$.v", "k1"), (2, "low", "$.v", "k2")]


def test_ranks_without_one_window(spark):
    r = random.Random(3)
    values = [r.choice([None, *range(40)]) for _ in range(3000)] + [7] * 1500
    got = quality.ranked_by(spark.createDataFrame(list(enumerate(values)), "id long, s int"), "s").collect()
    high = sorted((-1 if v is None else v for v in values), reverse=True)
    first = {v: high.index(v) + 1 for v in set(high)}
    assert len(got) == len(values) and all(g["rank"] == first[-1 if g["s"] is None else g["s"]] for g in got)
    assert quality.ranked_by(spark.createDataFrame([], "id long, s int"), "s").collect() == []


def test_lists_of_objectives(spark):
    w = spark.createDataFrame([("x", 3.0), ("y", 1.0), ("z", 0.0)], "objective string, weight double")
    c = spark.createDataFrame([("a", "x", "full"), ("a", "y", "partial"), ("b", "y", "full"), ("c", "q", "full"), ("d", "z", "none"), ("d", "x", None)], "candidate string, objective string, capability string")
    got = {r["candidate"]: (round(r["score"], 9), r["unmet_objectives"], r["partial_objectives"], r["rank"]) for r in quality.suitability(c, w).collect()}
    assert got == {"a": (0.8375, [], ["y"], 1), "b": (0.25, ["x"], [], 2), "c": (0.0, ["x", "y"], [], 3), "d": (0.0, ["x", "y"], [], 3)}


def test_totals_of_rates_and_shares(spark):
    edges = spark.createDataFrame([(1, 1, 2, 2.0)], "edge_id long, left long, right long, w double")
    nodes = spark.createDataFrame([(1, 3.0), (2, 1.0)], "node_id long, value double")
    capacities = spark.createDataFrame([(1, 2.0), (2, 4.0)], "node_id long, capacity double")
    outside = spark.createDataFrame([(1, "dirichlet", 0.5, 1.0), (2, "flux", 0.0, 0.25)], "node_id long, kind string, coefficient double, value double")
    source = spark.createDataFrame([(2, 3.0)], "node_id long, source double")
    assert tuple(graph.rate_totals(graph.node_rate(edges, nodes, capacities, outside, sources=source), capacities).first()) == pytest.approx((3.0, 1.25, 1.75, 0.0))
    totals = spark.createDataFrame([("a", 9.0), ("b", 1.0), ("c", 5.0)], "id string, total double")
    shares = spark.createDataFrame([("a", 0, 4.0), ("a", 1, 5.0), ("c", 0, 4.9)], "id string, ix int, share double")
    assert rows(graph.share_sums(shares, totals), "id") == [("a", 9.0, 9.0, True), ("b", 1.0, None, False), ("c", 5.0, 4.9, False)]


def test_normals_and_markers(spark):
    v = spark.createDataFrame([(0, 0.0, 0.0), (1, 1.0, 0.0), (2, 1.0, 1.0), (3, 0.0, 1.0)], "vertex_id long, x double, y double")
    t = spark.createDataFrame([(0, 0, 1, 2), (1, 0, 2, 3)], "cell_id long, a long, b long, c long")
    e = mesh.edge_incidence(t)
    got = {(r["lo"], r["hi"]): (r["nx"], r["ny"]) for r in mesh.face_normals(e, v, mesh.triangle_geometry(t, v)).collect()}
    h = 0.5**0.5
    assert {k: pytest.approx(x) for k, x in got.items()} == {(0, 1): (0.0, -1.0), (1, 2): (1.0, 0.0), (2, 3): (0.0, 1.0), (0, 3): (-1.0, 0.0), (0, 2): (-h, h)}
    marks = spark.createDataFrame([(1, 0, "s"), (2, 1, "t"), (1, 2, "e"), (0, 2, "inner"), (1, 3, "none")], "a long, b long, marker string")
    assert rows(mesh.marked_boundary(e, marks), "lo", "hi") == [(0, 1, 0, "s", None), (0, 2, None, "inner", "interior"), (0, 3, 1, None, None), (1, 2, 0, "e", "duplicate"), (1, 3, None, "none", "unmatched"), (2, 3, 1, None, None)]


def test_masks_grids_and_details(spark):
    runs = spark.createDataFrame([(0, 0, 3), (1, 5, 6)], "row int, x0 int, x1 int")
    p = spark.createDataFrame([(0.5, 0.5), (3.9, 0.0), (4.0, 0.0), (5.0, 1.9), (None, 1.0), (float("nan"), 0.0), (1.0, float("-inf"))], "px double, py double")
    assert tuple(raster.mask_counts(p, runs).first()) == (7, 3, 1, 3)
    assert tuple(raster.mask_counts(p.limit(0), runs).first()) == (0, 0, 0, 0)
    spots = spark.createDataFrame([(float(k), 0.0) for k in range(30)] + [(None, 1.0), (float("inf"), 0.0)], "x double, y double")
    grid = raster.padded_grid(spots, 10.0)
    assert {tuple(r) for r in grid.collect()} == {(x, y, -30.0, -30.0, 10, 7) for x in range(2, 7) for y in range(2, 5)}
    assert raster.padded_grid(spots, 10.0, least=31).isEmpty() and raster.padded_grid(spots, 10.0, most_cells=69).isEmpty() and raster.padded_grid(spots.limit(0), 10.0).isEmpty()
    cell = spark.createDataFrame([(0, 1)], "ix long, iy long")
    assert rows(raster.region_outline(cell, (2, 2)), "dx", "dy") == [(0, 1, -1, 0, True), (0, 1, 0, -1, False), (0, 1, 0, 1, True), (0, 1, 1, 0, False)]
    a = spark.createDataFrame([(0, 0, True), (1, 0, None), (2, 1, True)], "ix int, iy int, flag boolean")
    b = spark.createDataFrame([(1, 0, True), (0, 1, True), (2, 1, True), (5, 5, False)], "ix int, iy int, flag boolean")
    assert [tuple(r) for r in raster.confusion_details(a, b).collect()] == [(0, 0, True, False), (1, 0, False, True), (0, 1, False, True)]
    assert raster.confusion_details(a, b, 1).count() == 1


def test_diagnostics_and_reasons_of_cases(spark):
    c = spark.createDataFrame([("completed", -3.0, 0.5), ("completed", 1.0, float("nan")), ("completed", 2.0, 0.7), ("completed", None, None), ("failed", 99.0, 9.0)], "status string, mass_error double, cfl double")
    assert tuple(ensemble.diagnostic_bounds(c).first()) == (4, 2.0, 3.0, 0.7)
    assert tuple(ensemble.diagnostic_bounds(c.limit(0)).first()) == (0, None, None, None)
    r = spark.createDataFrame([(1, "completed", "x"), (2, "failed", "b"), (3, "failed", None)], "case_id int, status string, failure_reason string")
    got = rows(ensemble.reconcile_cases(spark.createDataFrame([(1,), (2,), (4,)], "case_id int"), r), "case_id")
    assert got == [(1, 1, "ok", None), (2, 1, "failed", "b"), (3, 1, "unknown", "unspecified"), (4, 0, "missing", None)]


def test_first_values_and_candidates(spark):
    d = spark.createDataFrame([("g", "b", 1), ("g", "a", 2), ("g", "b", 3), ("g", "c", 4), ("h", None, 1), ("h", "z", 9), ("i", None, 1)], "g string, v string, pos int")
    assert rows(web.first_values(d, "g", "v", "pos", 2), "g") == [("g", ["b", "a"]), ("h", ["z"])]
    f = spark.createDataFrame([("s", 200, ["x", "y", "x"]), ("t", 404, ["y"]), ("t", 500, None), ("u", 404, [])], "station string, status int, candidates array<string>")
    need = spark.createDataFrame([("s",), ("t",), ("w",)], "station string")
    assert tuple(web.reach_report(f, need).first()) == ("partial", ["t", "w"], 3, 1, 2)
    assert tuple(web.reach_report(f, need.where("station = 's'")).first()) == ("passed", [], 3, 1, 2)
    assert rows(web.found_candidates(f), "candidate") == [("x", 1), ("y", 2)]


def test_identity_in_payloads(spark):
    e = spark.createDataFrame([(1, "ann", "rhine", "x 1"), (2, "bo", "elbe", None), (3, "cy", "oder", "y"), (4, None, "ems", "z")], "code int, name string, river string, address string")
    p = spark.createDataFrame([(1, '{"n":"ann","r":"rhine"}'), (1, "x 1"), (2, "bo"), (2, "elbe"), (2, None), (4, "ems z"), (9, "cy oder")], "code int, text string")
    got = rows(quality.payload_identity(p, e), "code")
    assert got == [(1, True, True, True, True), (2, True, True, False, False), (3, False, False, False, False), (4, False, True, True, False)]
    assert [r[1:] for r in rows(quality.payload_identity(p.limit(0), e), "code")] == [(False,) * 4] * 4
